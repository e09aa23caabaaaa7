import html
import random
import re

import pytest
from pyspark.sql import functions as F

from corvella.llm import wrappers

from .conftest import CLASHING


def _by_hand(page):
    """The article of the generated pages, cut out by their one element."""
    page = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", page or "", flags=re.S)
    m = re.search(r"<article>(.*?)</article>", page, re.S)
    blocks = re.split(r"</?(?:p|h1|br|div|li|ul)\b[^>]*>", m[1] if m else "")
    texts = [" ".join(html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", b)).split()) for b in blocks]
    return " ".join(t for t in texts if t)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    want = {p.page_id: (p.url, _by_hand(p.html), len(_by_hand(p.html))) for p in pages}
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in wrappers.op1_page_wrappers(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def _frame(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING))


def _site(k, template, texts):
    body = "".join(f"<p>{t}</p>" for t in texts)
    return template.format(k=k, body=body)


TEMPLATES = {
    "article": '<html><body><nav><ul><li>Home</li><li>News</li></ul></nav><article><h1>Title {k}</h1>{body}</article><aside>Other news</aside><section class="comments"><p>Reader {k} says no</p></section><footer>All rights</footer></body></html>',
    "divs": '<body><div class="top-menu"><a href="/">Home</a></div><div id="wrap"><div class="post-body"><h1>Title {k}</h1>{body}</div><div class="sidebar">Read also</div></div><div class="cookie-notice">We use cookies</div><form><label>Name</label><input></form></body>',
    "main": '<body><header>Site name</header><main><h1>Title {k}</h1>{body}<div class="advert">Buy {k}</div></main></body>',
}


@pytest.mark.parametrize("template", list(TEMPLATES))
def test_templates_without_boilerplate(spark, template):
    rng = random.Random(4)
    pages, want = [], {}
    for k in range(12):
        texts = [" ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randrange(99)) for _ in range(rng.randrange(8, 30))) for _ in range(1 + k % 4)]
        pages.append((k, f"https://{template}.example.org/{k}", _site(k, TEMPLATES[template], texts)))
        want[k] = " ".join([f"Title {k}", *texts])
    assert {r.page_id: r.text for r in wrappers.extract(_frame(spark, pages)).collect()} == want


def test_odd_pages(spark):
    pages = [
        (1, "http://a.example/", None), (2, "http://a.example/", ""), (3, None, "<article>one &amp; two&nbsp;&#233;</article>"), (4, "no url", "plain text only"),
        (5, "http://b.example/", "<article><p>x<script>var a='</p><p>no';</script> y<!-- gone --></p></article>"), (5, "http://b.example/", "<article><p>x<script>var a='</p><p>no';</script> y<!-- gone --></p></article>"),
        (6, "http://c.example/", "<article>" + "<div>" * 500 + "deep" + "</div>" * 500 + "</article>"), (7, "http://c.example/", "<article><p>open <b>bold<p>next"),
        (8, "http://d.example/", "<article><p>" + "long words " * 50_000 + "</p></article>"), (None, "http://d.example/", "<article><p>no id</p></article>"),
    ]
    rows = wrappers.extract(_frame(spark, pages)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert len(rows) == len(pages)
    assert got[1] == [""] and got[2] == [""] and got[3] == ["one & two é"] and got[4] == ["plain text only"]
    assert got[5] == ["x y", "x y"] and got[6] == ["deep"] and got[7] == ["open bold next"] and got[None] == ["no id"]
    assert got[8] == [("long words " * 50_000).strip()]


def test_empty_table(spark):
    assert wrappers.extract(_frame(spark, [(1, "http://a.example/", "x")]).where("page_id > 5")).count() == 0


def test_alignment_infers_optionals_repeats_and_slots():
    first = wrappers.page_wrapper(wrappers.parse_page("<div><h1>One</h1><p>a</p><p>b</p><hr></div>"))
    second = wrappers.page_wrapper(wrappers.parse_page("<div><h1>Two</h1><ul><li>x</ul><p>c</p></div>"))
    (div,) = wrappers.merge(first, second)
    kids = {k["l"]: k for k in div["k"]}
    assert kids["h1"]["k"][0]["c"] is None and not kids["h1"]["?"]  # a slot
    assert kids["p"]["+"] and not kids["p"]["?"]  # a repeated group
    assert kids["ul"]["?"]  # an optional


def test_longest_common_subsequences():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randrange(8))]
        b = [rng.choice("abc") for _ in range(rng.randrange(8))]
        pairs = wrappers.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert len(pairs) == table[-1][-1]


def _read_host(pages):
    wrapper = []
    for k, page in enumerate(pages):
        own = wrappers.page_wrapper(wrappers.parse_page(page))
        wrapper = wrappers.merge(wrapper, own) if k else own
    wrapper = wrappers.mark_main(wrapper)
    return [" ".join(wrappers.read_page(wrappers.parse_page(p), wrapper)) for p in pages]


@pytest.mark.parametrize("n_pages", [1, 5])
@pytest.mark.parametrize("paragraphs", [1, 3])
@pytest.mark.parametrize("shape", ["<h1>Title {k}</h1><div class='body'>{body}</div>", "<div class='lead'>Title {k}</div><div class='body'>{body}</div>", "<div><h1>Title {k}</h1>{body}</div>"])
def test_titles_and_leads_outside_the_body_stay(shape, paragraphs, n_pages):
    texts = [[f"page {k} text {i} " + "words " * 40 + "end" for i in range(paragraphs)] for k in range(n_pages)]
    pages = ["<body><nav>Home</nav>" + shape.format(k=k, body="".join(f"<p>{t}</p>" for t in texts[k])) + "<footer>Rights</footer></body>" for k in range(n_pages)]
    assert _read_host(pages) == [" ".join([f"Title {k}", *texts[k]]) for k in range(n_pages)]


def test_what_stands_outside_on_every_page_alike_goes():
    pages = [f"<body><div class='tagline'>The same line</div><h1>Title {k}</h1><div class='text'><p>Text {k}</p><h2>Sources</h2><p>List {k}</p></div></body>" for k in range(4)]
    assert _read_host(pages) == [f"Title {k} Text {k} Sources List {k}" for k in range(4)]


TEXT = "<h1>Title {k}</h1><p>Text {k} of the page</p>"


@pytest.mark.parametrize(
    "page",
    [
        "<body class='single has-sidebar'><article>" + TEXT + "</article></body>",
        "<html class='header-fixed'><body><article>" + TEXT + "</article></body></html>",
        "<body><article class='post has-comments'>" + TEXT + "</article></body>",
        "<body><main class='no-sidebar'>" + TEXT + "</main></body>",
        "<body><article><div class='entry-header'><h1>Title {k}</h1></div><p>Text {k} of the page</p></article></body>",
        "<body><article><h1>Title {k}</h1><section id='related-work'><p>Text {k} of the page</p></section></article></body>",
        "<body><form id='page'><div class='content'>" + TEXT + "</div></form></body>",
        "<body><div class='sidebar-left-layout sidebar'><main>" + TEXT + "</main></div></body>",
        "<body><article><header><h1>Title {k}</h1></header><p>Text {k} of the page</p><footer>by me</footer></article></body>",
        "<body><article class='post type-{w} tag-{w}'>" + TEXT + "</article><article class='comment even'>Reader {k}</article></body>",
        "<body><div class='post type-{w} tag-{w}'>" + TEXT + "</div><div class='comment-list'>Reader {k}</div><div class='related-posts'>More {k}</div></body>",
        "<body><article>" + TEXT + "<div class='promo-line-x'>The same offer on every page</div></article></body>",
        "<body><article>" + "<div>" * 200 + TEXT + "<div class='sidebar'>AD</div>" + "</div>" * 200 + "</article><div class='cookie-notice'>Cookies</div></body>",
    ],
)
def test_class_names_of_ordinary_pages(page):
    pages = [page.format(k=k, w="abcdefgh"[k]) for k in range(6)]
    assert _read_host(pages) == [f"Title {k} Text {k} of the page" for k in range(6)]
    assert _read_host(pages[:1]) == ["Title 0 Text 0 of the page" + (" The same offer on every page" if "offer" in page else "")]


@pytest.mark.parametrize(
    "page",
    [
        "<body><form id='aspnetForm'><div class='page'><h2>Title {k}</h2><p>Text {k} of the page</p></div></form></body>",
        "<body><main><header><h1>Title {k}</h1><p>Lead {k}</p></header><p>Text {k} of the page</p></main></body>",
        "<body><header><p>The site</p></header><div class='post'><header><h1>Title {k}</h1></header><p>Text {k} of the page</p></div></body>",
        "<body><main><h1>Title {k}</h1><section><header><h2>Part {k}</h2></header><p>Text {k} of the page</p></section></main></body>",
        "<body><div class='page-sidebar'><h2>Title {k}</h2><p>Text {k} of the page</p></div><footer>Rights</footer></body>",
        "<body><div id='search'><div><h1>Title {k}</h1><div class='ad'>Buy</div><p>Text {k} of the page</p></div></div></body>",
        "<body>" + "<div>" * 125 + "<div class='sidebar'><main>" + TEXT + "</main></div>" + "</div>" * 125 + "</body>",
        "<body><article>" + TEXT + "<div class='comment-thread'>Reader {k}</div><div class='share-buttons'>Send {k}</div><div class='sponsored-content'>Buy {k}</div></article><div class='cookiebar'>Cookies {k}</div></body>",
    ],
)
@pytest.mark.parametrize("n_pages", [1, 4])
def test_no_article_is_lost_in_a_box(page, n_pages):
    pages = [page.format(k=k) for k in range(n_pages)]
    lead, part = "Lead" in page, "Part" in page
    want = [" ".join([f"Title {k}", *[f"Lead {k}"] * lead, *[f"Part {k}"] * part, f"Text {k} of the page"]) for k in range(n_pages)]
    assert _read_host(pages) == want


def test_pages_of_boilerplate_alone_stay_empty():
    for page in ("<body><nav>Home</nav><div class='comments'><h2>Comments</h2><p>Reader</p></div></body>", "<body><form><input><p>Sign up</p></form></body>", "<body><div class='cookie-notice'><h2>Cookies</h2><p>We use them</p></div></body>"):
        assert _read_host([page]) == [""]


def test_long_lists_align_exactly():
    rng = random.Random(6)
    a, b = [[rng.choice("abcdefghij") for _ in range(300)] for _ in range(2)]
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    pairs = wrappers.align(a, b)
    assert len(pairs) == row[-1] and all(a[i] == b[j] for i, j in pairs)
    parts = [f"<{'h2' if rng.random() < 0.5 else 'p'} class='{rng.choice('abcd')}'>item {k}" for k in range(300)]
    pages = [f"<body><nav>Home</nav><div class='text'><h1>Title {k}</h1>{''.join(p + f' of {k}' for p in parts)}</div></body>" for k in range(3)]
    assert _read_host(pages) == [" ".join([f"Title {k}", *(f"item {i} of {k}" for i in range(300))]) for k in range(3)]


def test_deep_and_unclosed_elements_end():
    page = "<body><article>" + "<div><p>" * 30_000 + "deep" + "</div>" * 30_000 + "</article><footer>Rights</footer></body>"
    assert _read_host([page]) == ["deep"]


def test_partitions_change_nothing(spark):
    rng = random.Random(9)
    pages = []
    for k in range(60):
        texts = [" ".join(rng.choice("alpha beta gamma".split()) + str(rng.randrange(99)) for _ in range(12)) for _ in range(1 + k % 4)]
        name = list(TEMPLATES)[k % 3]
        pages.append((k, f"https://{name}.example.org/{k}", _site(k, TEMPLATES[name], texts)))
    df = _frame(spark, pages)
    got = [sorted((r.page_id, r.text) for r in wrappers.extract(x).collect()) for x in (df.repartition(1), df.repartition(17), df.orderBy(F.desc("page_id")))]
    assert got[0] == got[1] == got[2]
    few = wrappers.infer(df.select(wrappers.host_of(F.col("url")).alias("host"), F.col("html").alias("text")), max_nodes=5, parts=3)
    assert few.count() == 3
