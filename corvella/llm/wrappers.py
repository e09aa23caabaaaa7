"""Main text of web pages by inferring union-free wrappers, host by host.

A page's token stream, with the end tags that HTML implies filled in, is a nested list of labelled items and texts.
Repeats of neighbouring items fold into one repeated group. A host's wrapper starts as one page and is aligned with
page after page: items found in both are merged level by level, items only one side has become optional, runs of one
label become repeated groups, and texts that differ become slots. Partial wrappers of a host, from as many tasks as
hold its pages, are aligned with each other the same way. The finished wrapper tells where the host's pages keep
their article, and which parts of it are the host's own fixed text; every page is aligned with it to read the article out.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialize, release_memory, shuffle_width, table

# Elements and class words by their customary meaning.
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "object", "svg", "xmp", "noembed", "noframes", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILER_TAGS = frozenset("nav header footer aside form button select dialog menu head datalist audio video canvas map".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookiebar cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: A class such as comment-list or ad-box is its first word's box; post-header is the article's own; has-sidebar says nothing.
BOX_WORDS = frozenset("area articles bar block body box button buttons container content form holder inner item items links list posts section slot stories thread unit widget widgets wrap wrapper".split())
ARTICLE_WORDS = frozenset("article content entry page post single story title".split())
STATE_WORDS = frozenset("has hide is no not show with without".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MAIN_TAGS = frozenset(("article", "main"))
#: An opening tag (first) ends these open elements, looking up as far as the listed containers.
_FLOW = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, {"html"})}

#: Elements below this many others keep their end, their kind and their texts, but are no items of their own; boilerplate
#: is up to so many levels more.
MAX_DEPTH, MORE_DEPTH = 120, 40
#: An element that is boilerplate by its name holds the article all the same if there is nothing beside it; none of these.
NO_ARTICLE_WORDS = frozenset("ad ads advert adverts advertisement advertising comment comments consent cookie cookiebar cookies disqus gdpr related recommended replies reply respond sponsor sponsored".split())
_HEADINGS = frozenset("h1 h2 h3".split())
#: Fixed text inside an article is the host's own if so many pages have it alike.
TEMPLATE_PAGES = 3
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:_-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)",
    re.S | re.I,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

# A page item is a text (str) or a pair (label, items); labels are tag names with class words.
Item = Any


def _boiler_name(name: str) -> bool:
    """Whether a class or id names a kind of boilerplate."""
    parts = _WORD.findall(name)
    if not parts or not STATE_WORDS.isdisjoint(parts):
        return False
    if parts[-1] in BOILER_WORDS:
        return not (parts[-1] == "header" and parts[0] in ARTICLE_WORDS)
    return parts[0] in BOILER_WORDS and BOX_WORDS.issuperset(parts[1:])


def _label(tag: str, attrs: str, in_article: bool = False) -> tuple[str, str]:
    """(tag with class words, why it is boilerplate: tag, role, name or nothing)."""
    words: list[str] = []
    why = "tag" if tag in BOILER_TAGS and not (tag == "header" and in_article) else ""
    if attrs and "=" in attrs:
        for m in _ATTR.finditer(attrs):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                role = value.strip()
                why = why or ("role" if role in BOILER_ROLES else "")
                tag = "main" if role == "main" else tag
                continue
            names = value.split()
            if tag not in ("html", "body", "main") and any(map(_boiler_name, names[:1] if tag == "article" else names)):
                why = why or "name"
            if m[1].lower() == "class" and tag not in ("html", "body", "main", "article"):
                words = [w for w in dict.fromkeys(map("-".join, map(_WORD.findall, names))) if w]
    return ".".join([tag, *words]), why


def parse_page(page: str) -> list[Item]:
    """The page as nested items; text is decoded, with one space for white space, cut at block boundaries.

    Boilerplate has "!" before its label. A form, or an element that its class or id calls boilerplate, is none if it holds
    the page's main element or an article with a heading of the first level; a form neither if it holds such a heading. A
    header inside an article, a main element, a section or a box named as an article is the article's own. If nothing
    else is left of a page, such forms and elements are none if they hold a heading and a paragraph.
    """
    top: list[Item] = []
    stack: list[tuple[str, list[Item], list, int]] = [("", top, ["", top, ""], 0)]  # name, where its items go, [label, items, why], level
    open_: Counter[str] = Counter()
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                stack[-1][1].append(text)

    def close(name: str, stops: set[str] | frozenset[str] = frozenset()) -> None:
        if not open_[name]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                open_.subtract(x[0] for x in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in stops:
                return

    def absolve(upto: int, kinds: tuple[str, ...]) -> None:
        for name, _, node, _ in stack[1:upto]:
            if node[2] == "name" and "name" in kinds or name == "form" and node[2] == "tag":
                node[2] = ""

    def plain(start: int, end: int) -> None:
        if start < end:
            text = page[start:end]
            pieces.append(entities.unescape(text) if "&" in text else text)

    at = 0
    m = _MARKUP.search(page)
    while m:
        plain(at, m.start())
        at = m.end()
        name = (m["name"] or "").lower()
        if m["raw"]:
            if not page[m.start() : at].rstrip(">").endswith("/") or m["raw"].lower() not in ("svg", "math"):
                end = _RAW_END[m["raw"].lower()].search(page, at)
                at = end.end() if end else len(page)
        elif name and m["close"]:
            if name not in INLINE or open_[name]:
                flush()
                close(name)
        elif name:
            own_header = name == "header" and (open_["article"] or open_["section"] or any(x[2][0].split(".")[0] == "main" or not ARTICLE_WORDS.isdisjoint(x[2][0].split(".")[1:]) for x in stack))
            label, why = _label(name, m["attrs"], bool(own_header))
            if name == "br" or (name not in INLINE or (why and name not in VOID)):
                flush()
                if name in _FLOW:
                    close("p", {"button", "td", "th", "li", "article", "main", "section", "div", "body"})
                if name in _IMPLIED:
                    ends, stops = _IMPLIED[name]
                    for e in ends:
                        close(e, stops)
                if name == "h1" and open_["article"]:
                    absolve(max(k for k in range(len(stack)) if stack[k][0] == "article") + 1, ("name",))
                elif name == "h1":
                    absolve(len(stack), ())
                elif label == "main" or label.startswith("main."):
                    absolve(len(stack), ("name",))
                if name not in VOID and not m["attrs"].endswith("/"):
                    node, level = [label, [], why], stack[-1][3]
                    if level < MAX_DEPTH or why and level < MAX_DEPTH + MORE_DEPTH:
                        stack[-1][1].append(node)
                        level += 1
                    else:  # its items stand among those of the element around it
                        node[1] = stack[-1][1] if not why else []
                    stack.append((name, node[1], node, level))
                    open_[name] += 1
        m = _MARKUP.search(page, at)
    plain(at, len(page))
    flush()
    if not _plain_text(top):
        _absolve_boxes(top)
    return _named(top)


def _plain_text(items: list) -> bool:
    """Whether there is text outside boilerplate."""
    return any(isinstance(x, str) or not x[2] and _plain_text(x[1]) for x in items)


def _tags(items: list) -> set[str]:
    """Tags of what stands outside boilerplate."""
    return {t for x in items if not isinstance(x, str) and not x[2] for t in (x[0].split(".")[0], *_tags(x[1]))}


def _absolve_boxes(items: list) -> bool:
    """Outermost forms and named boxes that hold a heading and a paragraph of their own stop being boilerplate, and so does what holds them."""
    found = False
    for x in items:
        if isinstance(x, str):
            continue
        tag, *words = x[0].split(".")
        box = x[2] == "name" and NO_ARTICLE_WORDS.isdisjoint(w for c in words for w in c.split("-")) or x[2] == "tag" and tag == "form"
        if x[2] and not box:
            continue
        tags = _tags(x[1]) if box else set()
        if not _HEADINGS.isdisjoint(tags) and "p" in tags or _absolve_boxes(x[1]):
            x[2], found = "", True
    return found


def _named(items: list) -> list[Item]:
    """Items as (label, items), boilerplate marked in the label."""
    return [x if isinstance(x, str) else (("!" if x[2] else "") + x[0], _named(x[1])) for x in items]


# A wrapper node: {"l": label, "k": kids, "?": optional, "+": repeated, "m": characters of text below, "n": pages that have it}.
# A wrapper text: {"l": "#", "c": checksum of the text, or None for a slot, "?", "+", "m", "n"}.


def _lift(item: Item) -> dict:
    if isinstance(item, str):
        return {"l": "#", "c": zlib.crc32(item.encode("utf-8")), "?": 0, "+": 0, "m": len(item), "n": 1}
    kids = _fold([_lift(x) for x in item[1]])
    return {"l": item[0], "k": kids, "?": 0, "+": 0, "m": sum(k["m"] for k in kids), "n": 1}


def _unite(a: dict, b: dict) -> dict:
    """One node for two of the same tag; its label is what their labels share."""
    label = a["l"] if a["l"] == b["l"] else ".".join(w for w in a["l"].split(".") if w in b["l"].split("."))
    out = {"l": label, "?": a["?"] | b["?"], "+": a["+"] | b["+"], "m": a["m"] + b["m"], "n": a["n"] + b["n"]}
    if a["l"] == "#":
        out["c"] = a["c"] if a["c"] == b["c"] else None
    else:
        out["k"] = merge(a["k"], b["k"])
    return out


def _fold(items: list[dict]) -> list[dict]:
    """Neighbours of one label become a repeated group; so do repeats of two or three labels in turn."""
    out: list[dict] = []
    for x in items:
        if out and out[-1]["l"] == x["l"]:
            out[-1] = _unite(out[-1], x) | {"+": 1}
            continue
        out.append(x)
        for period in (2, 3):
            if len(out) >= 2 * period and all(out[-i]["l"] == out[-i - period]["l"] for i in range(1, period + 1)):
                tail = out[-period:]
                del out[-period:]
                for i in range(period):
                    out[i - period] = _unite(out[i - period], tail[i]) | {"+": 1}
                break
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence.

    One row of the table is the bits of one integer: bit y of row x is 0 where the subsequence of a[: x + 1] and b[: y + 1]
    is longer than that of a[: x + 1] and b[: y].
    """
    pairs: list[tuple[int, int]] = []
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        pairs.append((i, i))
        i += 1
    tail: list[tuple[int, int]] = []
    n, m = len(a), len(b)
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
        tail.append((n, m))
    if n > i and m > i:
        where: dict[str, int] = {}
        for y in range(i, m):
            where[b[y]] = where.get(b[y], 0) | 1 << (y - i)
        full = (1 << (m - i)) - 1
        rows, row = [full], full
        for x in range(i, n):
            both = row & where.get(a[x], 0)
            row = ((row + both) | (row - both)) & full
            rows.append(row)
        x, y = n - i, m - i
        middle = []
        while x and y:
            if rows[x] >> (y - 1) & 1:
                y -= 1
            elif not rows[x - 1] >> (y - 1) & 1:
                x -= 1
            else:
                x, y = x - 1, y - 1
                middle.append((x + i, y + i))
        pairs += middle[::-1]
    return pairs + tail[::-1]


def _family(label: str) -> str:
    """The label's tag and first class word."""
    return ".".join(label.split(".", 2)[:2])


def align_labels(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal labels and, between those, of labels with one tag and first class word."""
    pairs = align(a, b)
    out, x, y = [], 0, 0
    for i, j in [*pairs, (len(a), len(b))]:
        if i > x and j > y:
            out += [(x + p, y + q) for p, q in align([_family(k) for k in a[x:i]], [_family(k) for k in b[y:j]])]
        if i < len(a):
            out.append((i, j))
        x, y = i + 1, j + 1
    return out


def merge(a: list[dict], b: list[dict]) -> list[dict]:
    """The least wrapper this method finds for what either side matches."""
    out: list[dict] = []
    x = y = 0
    for i, j in [*align_labels([k["l"] for k in a], [k["l"] for k in b]), (len(a), len(b))]:
        out += [k | {"?": 1} for k in a[x:i]]
        out += [k | {"?": 1} for k in b[y:j]]
        if i < len(a):
            out.append(_unite(a[i], b[j]))
        x, y = i + 1, j + 1
    return _fold(out)


def page_wrapper(items: list[Item]) -> list[dict]:
    return _fold([_lift(x) for x in items])


def mark_main(kids: list[dict]) -> list[dict]:
    """Set "a" on the nodes that hold the article: article or main elements; without them, the innermost node that
    holds all of the text outside boilerplate, without what stands before or after it on every page alike. Where the wrapper
    shows that pages differ, slots count in full and constants not at all.
    """
    found = False

    def elements(nodes: list[dict]) -> None:
        nonlocal found
        for k in nodes:
            if k["l"] == "#" or k["l"].startswith("!"):
                continue
            if k["l"].split(".")[0] in MAIN_TAGS:
                k["a"] = found = True
            else:
                elements(k["k"])

    def mass(k: dict, slots: bool) -> int:
        if k["l"] == "#":
            return 0 if slots and k["c"] is not None else k["m"]
        return 0 if k["l"].startswith("!") else sum(mass(x, slots) for x in k["k"])

    def differs(nodes: list[dict]) -> bool:
        """A slot outside repeated groups: at least two pages were seen."""
        return any(not k["+"] and (k["c"] is None if k["l"] == "#" else not k["l"].startswith("!") and differs(k["k"])) for k in nodes)

    elements(kids)
    if not found:
        top = {"l": "", "k": kids}
        slots = differs(kids)
        while True:
            whole = mass(top, slots)
            inner = max((k for k in top["k"] if k["l"] != "#"), key=lambda k: mass(k, slots), default=None)
            if inner is None or not whole or mass(inner, slots) < whole or inner["+"]:
                break
            top = inner
        holds = [i for i, k in enumerate(top["k"]) if mass(k, slots)]
        for i, k in enumerate(top["k"]):
            if not k["l"].startswith("!") and (not slots or k["?"] or holds[0] <= i <= holds[-1]):
                k["a"] = True
    _mark_templates(kids, differs(kids))
    return kids


def _mark_templates(kids: list[dict], slots: bool) -> None:
    """Inside main nodes set "t" on elements with a class of their own whose text all pages that have it share, if there are
    TEMPLATE_PAGES of them, and "x" on what holds such elements.
    """

    def fixed(nodes: list[dict]) -> bool:
        return all(not k["+"] and (k["c"] is not None if k["l"] == "#" else fixed(k["k"])) for k in nodes)

    def inside(nodes: list[dict]) -> bool:
        found = False
        for k in nodes:
            if k["l"] == "#" or k["l"].startswith("!"):
                continue
            if "." in k["l"] and k["n"] >= TEMPLATE_PAGES and not k["+"] and k["m"] and fixed(k["k"]):
                k["t"] = found = True
            elif inside(k["k"]):
                k["x"] = found = True
        return found

    def outside(nodes: list[dict]) -> None:
        for k in nodes:
            if k["l"] == "#" or k["l"].startswith("!"):
                continue
            if not k.get("a"):
                outside(k["k"])
            elif inside(k["k"]):
                k["x"] = True

    if slots:
        outside(kids)


def _texts(items: list[Item], out: list[str]) -> None:
    for x in items:
        if isinstance(x, str):
            out.append(x)
        elif not x[0].startswith("!"):
            _texts(x[1], out)


def read_page(items: list[Item], wrapper: list[dict]) -> list[str]:
    """Texts of the page's items that align with main nodes of the wrapper, without boilerplate and the host's own text."""
    out: list[str] = []

    def walk(items: list[Item], kids: list[dict], inside: bool) -> None:
        labels, owners = [], []
        for i, x in enumerate(items):  # a run of one label is one repeated group
            label = "#" if isinstance(x, str) else x[0]
            if labels and labels[-1] == label:
                owners[-1].append(i)
            else:
                labels.append(label)
                owners.append([i])
        matched = {i: kids[j] for k, j in align_labels(labels, [k["l"] for k in kids]) for i in owners[k]}
        spare = {k["l"]: k for k in kids}  # repeats of several labels in turn
        for i, x in enumerate(items):
            label = "#" if isinstance(x, str) else x[0]
            node = matched.get(i)
            if label.startswith("!") or (node and node.get("t")):
                continue
            node = node or spare.get(label)
            if not inside and node is None:
                continue
            if inside or node.get("a"):
                if node is not None and node.get("x"):
                    walk(x[1], node["k"], True)
                else:
                    _texts([x], out)
            elif not isinstance(x, str):
                walk(x[1], node["k"], False)

    walk(items, wrapper, False)
    return out


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; pages without one form a group of their own."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _size(kids: list[dict]) -> int:
    return sum(1 + _size(k.get("k", [])) for k in kids)


_WRAPPER = "host string, part int, wrapper string"


def _wrappers(hosts: list[str], parts: list[int], wrappers: list[list[dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(parts, pa.int32()), pa.array([json.dumps(w) for w in wrappers], pa.string())], ["host", "part", "wrapper"])


def _merged(finish: bool):
    """Of rows sorted by host and part the wrapper of each, merged one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wrapper = None, None
        done = mark_main if finish else lambda w: w
        for b in batches:
            for h, k, w in zip(*(b.column(c).to_pylist() for c in ("host", "part", "wrapper")), strict=True):
                if (h, k) == key:
                    wrapper = merge(wrapper, json.loads(w))
                    continue
                if key is not None:
                    yield _wrappers([key[0]], [key[1]], [done(wrapper)])
                key, wrapper = (h, k), json.loads(w)
        if key is not None:
            yield _wrappers([key[0]], [key[1]], [done(wrapper)])

    return run


def infer(pages: DataFrame, max_nodes: int = 200_000, parts: int = 64) -> DataFrame:
    """(host, wrapper as JSON) from all pages (host, text).

    A task keeps partial wrappers of at most about ``max_nodes`` nodes at a time and passes them on before it takes more.
    Those of one host are merged in ``parts`` groups first, so that no task gets all of a large host's.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, list[dict]] = {}
        size = 0
        for b in batches:
            for host, page in zip(b.column("host").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = page_wrapper(parse_page(page))
                if host in open_:
                    size -= _size(open_[host])
                    own = merge(open_.pop(host), own)
                if size + _size(own) > max_nodes and open_:
                    yield _wrappers(list(open_), [0] * len(open_), list(open_.values()))
                    open_.clear()
                    size = 0
                open_[host] = own
                size += _size(own)
        if open_:
            yield _wrappers(list(open_), [0] * len(open_), list(open_.values()))
        release_memory()

    found = pages.select("host", "text").mapInArrow(partial, _WRAPPER).withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(parts)).cast("int"))
    some = found.repartition(shuffle_width(pages.sparkSession), "host", "part").sortWithinPartitions("host", "part", "wrapper").mapInArrow(_merged(False), _WRAPPER)
    whole = some.select("host", F.lit(0).alias("part"), "wrapper").repartition(shuffle_width(pages.sparkSession), "host").sortWithinPartitions("host", "wrapper")
    return whole.mapInArrow(_merged(True), _WRAPPER).select("host", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty html gives an empty text. A page of which nothing aligns with its host's article is read by a
    wrapper of its own. Null URLs and URLs without a host share one wrapper. Repeated rows give equal texts; further
    columns are not read.
    """
    named = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("text"))
    wrappers = materialize(infer(named), "wrappers")
    kind = pages.schema["page_id"].dataType.simpleString()
    cache: dict[int, list[dict]] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for page, wrapper in zip(batch.column("text").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            key = hash(wrapper)
            if key not in cache:
                if len(cache) > 500:
                    cache.clear()
                cache[key] = json.loads(wrapper)
            items = parse_page(page)
            texts.append(" ".join(read_page(items, cache[key]) or read_page(items, mark_main(page_wrapper(items)))))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    read = map_texts(named.join(wrappers, "host").select("page_id", "url", "text", "wrapper"), run, f"page_id {kind}, url string, text string")
    return read.withColumn("n_chars", F.length("text").cast("long"))


def op1_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
