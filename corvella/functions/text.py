"""Text expressions. All are built-in functions, so they stay in the JVM; null in gives null out unless noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as str.split() takes it; Java's own class lacks U+001C to U+001F.
SPACE = "(?U)[\\s\\x1c-\\x1f]+"

# Phrases and words that the predicates look for.
INJECTION_PHRASES = ("ignore previous instructions", "reveal system prompt", "bypass policy", "disable safety")
IMAGE_TERMS = ("image", "figure", "fig.", "fig ", "chart", "diagram", "graph", "table", "圖", "表")


#: The characters of SPACE.
_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def count_tokens(c: Column) -> Column:
    return F.size(words(c))


def normalize_query(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.array_join(words(c), " ")


def clean_db_text(c: Column) -> Column:
    """Control characters below U+0020 go, save line feed and tab."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0b-\\x1f]", "")


def detect_language(c: Column) -> Column:
    return F.when(c.rlike("[\\u4e00-\\u9fff]"), "zh").otherwise("en")


def contains_any(c: Column, terms: tuple[str, ...]) -> Column:
    lowered = F.lower(c)
    found = lowered.contains(terms[0])
    for t in terms[1:]:
        found = found | lowered.contains(t)
    return F.coalesce(found, F.lit(False))


def is_injection(c: Column) -> Column:
    return contains_any(c, INJECTION_PHRASES)


def wants_images(c: Column) -> Column:
    return contains_any(c, IMAGE_TERMS)


def first_non_empty(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def session_title(query: Column) -> Column:
    return first_non_empty(F.substring(normalize_query(query), 1, 80), F.lit("Untitled chat"))


def safe_int(c: Column) -> Column:
    """An integer, or 0 where the text is none."""
    text = c.cast("string")
    return F.coalesce(text.try_cast("int"), strip(text).try_cast("int"), F.lit(0))  # the cast takes off ASCII white space itself


def clamp_top_k(c: Column, default: int = 8, most: int = 20) -> Column:
    return F.greatest(F.lit(1), F.least(F.coalesce(strip(c.cast("string")).try_cast("int"), F.lit(default)), F.lit(most)))


def normalize_page(c: Column) -> Column:
    """Extracted page text: stripped lines, single blank lines, hyphenated words joined, wide gaps as two spaces.

    A line that ends in a hyphen takes the next one if that starts in lower case; the piece it takes keeps its gaps.
    """
    lines = F.split(clean_db_text(c), "\n", -1)

    def step(done: Column, line: Column) -> Column:
        now = strip(line)
        last = F.coalesce(F.get(done, F.size(done) - 1), F.lit(""))
        first = F.substring(now, 1, 1)
        lower = (F.lower(first) == first) & (F.upper(first) != first)
        start = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        gaps = F.regexp_replace(now, "[ \\t]{3,}", "  ")
        return (
            F.when((now == "") & ((F.size(done) == 0) | (last == "")), done)
            .when(now == "", F.concat(done, F.array(F.lit(""))))
            .when(last.endswith("-") & lower, F.concat(start, F.array(F.concat(F.substring(last, F.lit(1), F.length(last) - 1), now))))
            .otherwise(F.concat(done, F.array(gaps)))
        )

    folded = F.aggregate(lines, F.array().cast("array<string>"), step)
    return F.regexp_replace(F.array_join(folded, "\n"), "\\n+$", "")


def lines_of(c: Column) -> Column:
    """Lines as str.splitlines() cuts them."""
    ends = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
    return F.split(F.regexp_replace(c, f"(?:{ends})$", ""), ends, -1)


def is_table_line(line: Column) -> Column:
    """Two bars or more, or three columns or more apart by two white spaces or more."""
    text = strip(line)
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    columns = F.size(F.filter(F.split(text, "(?U)\\s{2,}"), lambda p: p != ""))
    return (bars >= 2) | (text.rlike("(?U)\\S\\s{2,}\\S") & (columns >= 3))


def table_row(line: Column) -> Column:
    """A table line with its cells between bars."""
    barred = F.transform(F.split(F.regexp_replace(line, "^[| ]+|[| ]+$", ""), "\\|", -1), strip)
    spaced = F.filter(F.transform(F.split(strip(line), "(?U)\\s{2,}", -1), strip), lambda p: p != "")
    cells = F.when(line.contains("|"), barred).otherwise(spaced)
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table_blocks(c: Column) -> Column:
    """Runs of two table lines or more, each as one string of rows."""
    step = lambda acc, line: F.when(
        is_table_line(line),
        F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(table_row(line))).alias("open")),
    ).otherwise(
        F.struct(
            F.when(F.size(acc["open"]) >= 2, F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n")))).otherwise(acc["done"]).alias("done"),
            F.array().cast("array<string>").alias("open"),
        )
    )
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("open"))
    # A last line that is no table row closes the last run.
    return F.aggregate(F.concat(lines_of(c), F.array(F.lit(""))), start, step, lambda acc: acc["done"])


FIELD = "^([A-Za-z][A-Za-z0-9 _/\\-]{1,40})(?U)\\s*[:\\uff1a]\\s*(.{1,120})$"


def field_entries(c: Column) -> Column:
    """(key, value) of every line ``Key: value``, in order."""
    might = F.filter(lines_of(c), lambda line: line.contains(":") | line.contains("\uff1a"))
    pairs = F.transform(
        might,
        lambda line: F.struct(
            strip(F.regexp_replace(F.regexp_extract(strip(line), FIELD, 1), "(?U)\\s+", " ")).alias("key"),
            strip(F.regexp_extract(strip(line), FIELD, 2)).alias("value"),
        ),
    )
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))


def field_list(c: Column) -> Column:
    """Fields as a mapping would keep them: a key at its first place, with its last value."""
    return F.aggregate(
        field_entries(c),
        F.array().cast("array<struct<key:string,value:string>>"),
        lambda acc, p: F.when(
            F.exists(acc, lambda x: x["key"] == p["key"]),
            F.transform(acc, lambda x: F.when(x["key"] == p["key"], F.struct(p["key"].alias("key"), p["value"].alias("value"))).otherwise(F.struct(x["key"].alias("key"), x["value"].alias("value")))),
        ).otherwise(F.concat(acc, F.array(F.struct(p["key"].alias("key"), p["value"].alias("value"))))),
    )


def structured_text(c: Column, tables: Column | None = None, fields: Column | None = None) -> Column:
    """Page text with the tables and fields found in it appended; blank pages become empty.

    ``tables`` and ``fields``: columns that hold ``table_blocks`` and ``field_list`` of the text already.
    """
    tables = table_blocks(c) if tables is None else tables
    fields = F.transform(field_list(c) if fields is None else fields, lambda f: F.concat(f["key"], F.lit(": "), f["value"]))
    body = F.concat_ws(
        "\n\n",
        strip(c),
        F.when(F.size(tables) > 0, F.concat(F.lit("[Detected tables]\n"), F.array_join(tables, "\n\n"))),
        F.when(F.size(fields) > 0, F.concat(F.lit("[Detected fields]\n"), F.array_join(fields, "\n"))),
    )
    return F.when(strip(c) == "", "").otherwise(body)


CAPTION = "(?iu)^\\s*(?:圖|Fig\\.?|Figure)\\s*[\\dA-Za-z一二三四五六七八九十IVXivx.\\-:：]*\\s+.+"


def captions(layout: Column) -> Column:
    """The stripped lines that caption a figure."""
    return F.filter(F.transform(lines_of(layout), strip), lambda line: line.rlike(CAPTION))


def caption_at(found: Column, ordinal: Column) -> Column:
    """The caption of the image with this number (from 1); images beyond the last caption share it."""
    return F.when(F.size(found) > 0, F.element_at(found, F.least(ordinal, F.size(found)).cast("int")))


def image_filename(page: Column, ordinal: Column, name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), "[^./](\\.[^./]+)$", 1))
    kept = F.when(suffix.isin(".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp"), suffix).otherwise(".png")
    return F.concat(F.format_string("page-%04d-image-%03d", page, ordinal), kept)


def json_object(c: Column) -> Column:
    """A map of the top-level fields of a JSON object; anything else, broken JSON included, gives an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def iso_timestamp(c: Column) -> tuple[Column, Column]:
    """(timestamp or null, whether a given value is malformed)."""
    parsed = F.try_to_timestamp(F.replace(c, F.lit("Z"), F.lit("+00:00")))
    return parsed, F.coalesce((F.nullif(c, F.lit("")).isNotNull()) & parsed.isNull(), F.lit(False))


def json_log_line(time: Column, level: Column, logger: Column, message: Column, exception: Column) -> Column:
    """A log record as one line of JSON, non-ASCII characters as they are; no exception, no such field.

    The time is UTC to the millisecond. A null among the others reads as the empty text.
    """
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(F.coalesce(c, F.lit("")))), "(?s)^\\[(.*)\\]$", 1)
    field = lambda name, c: F.concat(F.lit(f'"{name}": '), c)
    stamp = F.concat(F.lit('"'), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit('Z"'))
    failed = F.when(exception.isNotNull(), field("exception", quoted(exception)))
    return F.concat(F.lit("{"), F.concat_ws(", ", field("timestamp", stamp), field("level", quoted(level)), field("logger", quoted(logger)), field("message", quoted(message)), failed), F.lit("}"))


def sse_event(name: Column, payload: Column) -> Column:
    """One server-sent event from an event name and a struct."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))
