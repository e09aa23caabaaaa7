"""Keyword search by an inverted table of character grams, for many queries at once.

Every chunk's lower-case content is cut into its grams of one, two and three characters. The table lists, gram by gram, the
chunks that have it; a query's rarest grams are intersected, so only chunks that may contain it are read and compared with
the pattern. Chunks stand in bands by the size of their trigram set: a similarity is at most the query's set over the
chunk's, so bands are visited from the smallest, and a query is done when its results are above what later bands can give.
A batch of so many queries that their lists hold several times the chunks of some bands doesn't intersect them there: one
automaton of all its literals goes through those chunks once, which costs what the chunks are, however many ask.

Content is written once, by the tasks that read it, in parts of some thousand rows, and lists name a row by its part and its
number there, two bytes. Lists are never gathered: a row holds the numbers of one gram in one batch of a part, whatever is
frequent has many rows. Rounds keep only ids and scores; content is fetched for the results alone. Later chunks are appended.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.batches import bounded, slices
from ..functions.principal import Principal
from ..functions.vectors import WORD_GAP, trigrams
from ..plans.scratch import freed_shuffles, scratch_dir
from .search import in_bases
from .security import retrieval_filter

#: Directories of the table by a hash of the gram; rows of a part of the content, and at most.
BUCKETS, PART_ROWS, MAX_PART_ROWS = 32, 4096, 16_384
#: So many of a query's grams, the rarest, are intersected.
RAREST = 3
#: Candidates a query should have in the first round of bands; every round takes four times as many.
FIRST_CANDIDATES = 64
#: Bands whose chunks are asked for so many times by the rarest lists are read once by an automaton, if it has at most so many characters.
READ_ONCE, AUTOMATON_CHARS = 8, 2_000_000
#: A table of so many narrow rows may be sent to all tasks. Catalyst would judge by bytes on disk, which for ids are a tenth of what they take up.
SENT_ROWS = 30_000
#: So many matches a task of the automaton holds before it keeps each query's best.
HELD_MATCHES = 50_000
#: So many parts are named to the scan; beyond, all are read.
NAMED_PARTS = 1024
#: Bytes of content whose grams are listed together.
_BATCH = 8 << 20
#: The gram that every chunk has: a query of wildcards alone has no other.
ANY = 0


@dataclass(frozen=True)
class GramIndex:
    """Where an index lies: ``root``/content, ``root``/grams, ``root``/sizes and ``root``/ledger; ``rows``: of a part of the content."""

    root: str
    rows: int
    schema: StructType

    def content(self, spark: SparkSession) -> DataFrame:
        """The chunks of whole additions, also those without content."""
        done = [r[0] for r in spark.read.schema("add long").parquet(f"{self.root}/ledger").distinct().collect()]
        return spark.read.schema(self.schema).parquet(f"{self.root}/content").where(F.col("add").isin(done))

    def grams(self, spark: SparkSession) -> DataFrame:
        """(gram, band, part, at, add, bucket): the rows ``at`` of a part that have a gram."""
        return spark.read.schema("gram long, band int, part long, at array<smallint>, add long, bucket int").parquet(f"{self.root}/grams")

    def sizes(self, spark: SparkSession) -> DataFrame:
        """(gram, band, n, bucket): how many chunks of a band have a gram, in one row or, after additions, several."""
        return spark.read.schema("gram long, band int, n long, bucket int").parquet(f"{self.root}/sizes")


def gram_keys(text: str) -> np.ndarray:
    """The distinct grams of one to three characters as numbers, 21 bits a character, and ANY."""
    p = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64) + 1
    ones = p << 42
    twos = ones[:-1] | (p[1:] << 21)
    threes = np.unique(twos[:-1] | p[2:])
    # The shorter ones begin the longer ones, but for those at the end.
    twos = np.unique(np.concatenate([threes >> 21 << 21, twos[-1:]]))
    return np.concatenate([[ANY], np.unique(np.concatenate([twos >> 42 << 42, ones[-1:]])), twos, threes])


def query_grams(pattern: str) -> list[int]:
    """The grams that a text must have to match ``%pattern%``: the longest ones of what stands between wildcards.

    A backslash escapes a wildcard or another one; to take it for the end of a literal loses no match.
    """
    found: set[int] = set()
    for literal in re.split(r"[%_\\]", pattern):
        p = [ord(c) + 1 for c in literal]
        n = min(3, len(p))
        for i in range(len(p) - n + 1) if n else ():
            found.add(sum(x << (42 - 21 * k) for k, x in enumerate(p[i : i + n])))
    return sorted(found) or [ANY]


def band_of(n_trigrams: Column) -> Column:
    """Two bands a doubling."""
    return F.floor(2 * F.log2(n_trigrams + F.lit(1.0))).cast("int")


def _least(band: int) -> int:
    """The smallest set a band can hold, or one less."""
    return max(0, int(2 ** (band / 2)) - 2)


def _bucket(gram: str = "gram") -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _n_trigrams(padded: pa.Array) -> pa.Array:
    """How many trigrams texts of padded words have, null for null."""
    sizes: list[int | None] = []
    for start, n in slices(padded):
        for text in padded.slice(start, n).to_pylist():
            if text is None:
                sizes.append(None)
                continue
            p = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
            kept = (p[1:-1] != 32) | (p[2:] != 32)  # as in padded_trigrams
            sizes.append(len(np.unique(((p[:-2] << 42) | (p[1:-1] << 21) | p[2:])[kept])))
    return pa.array(sizes, pa.int32())


def _lists(content: DataFrame) -> DataFrame:
    """(gram, band, part, at) of content (part, at, band, said): a row per gram and band of each batch of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes, parts = np.cumsum([len(s) for s in whole.column("said").to_pylist()]), whole.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(sizes // _BATCH) != 0) | (np.diff(parts) != 0)) + 1).tolist(), whole.num_rows]
            for a, z in pairwise(cuts):
                if a == z:
                    continue
                band, at = whole.column("band").to_numpy()[a:z], whole.column("at").to_numpy()[a:z]
                by_band = np.lexsort((at, band))
                said = whole.column("said").slice(a, z - a).take(pa.array(by_band)).to_pylist()
                keys = [gram_keys(s) for s in said]
                row = np.repeat(by_band, [len(k) for k in keys])
                gram = np.concatenate(keys)
                order = np.argsort(gram, kind="stable")
                gram, row = gram[order], row[order]
                band, at = band[row], at[row]
                first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (band[1:] != band[:-1])]))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(row)]]).astype(np.int32)), pa.array(at, pa.int16()))
                yield pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(band[first], pa.int32()), pa.array(np.full(len(first), parts[a])), lists], ["gram", "band", "part", "at"])

    return content.mapInArrow(run, "gram long, band int, part long, at array<smallint>")


def build(chunks: DataFrame, root: str, parts: int | None = None) -> GramIndex:
    """Write an index of chunks (as in ``search``) under a folder that all executors share.

    Null content contains nothing and is not listed. Chunk ids must be unique. ``parts``: about so many of the content, of
    PART_ROWS rows each if it is not given.
    """
    rows = max(1, min(MAX_PART_ROWS, chunks.count() // parts if parts else PART_ROWS))
    index = GramIndex(root.rstrip("/"), rows, _stored(chunks, rows, 0).schema)
    add(index, chunks)
    return index


def _stored(chunks: DataFrame, rows: int, addition: int) -> DataFrame:
    """The rows of the content, each ``rows`` that a task reads one after another a part. Part and number are added up to one key."""
    sized = chunks.drop("embedding").withColumn("_row", F.monotonically_increasing_id()).withColumn("n_trigrams", F.arrow_udf(_n_trigrams, "int")(_padded(F.lower("content"))))
    nth = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    part = F.shiftleft(F.xxhash64(F.lit(addition), F.shiftright("_row", 33), F.floor(nth / rows)), 16)
    placed = sized.withColumn("band", band_of(F.col("n_trigrams"))).withColumn("at", F.pmod(nth, F.lit(rows)).cast("smallint"))
    return placed.withColumn("add", F.lit(addition).cast("long")).withColumn("part", part).drop("_row")


def add(index: GramIndex, chunks: DataFrame) -> None:
    """Append chunks with new ids; what is there already stays as it is.

    The ledger comes last: until it names an addition its rows match nothing, so one that was broken off can be repeated.
    """
    spark = chunks.sparkSession
    addition = secrets.randbits(62)
    # Tasks write what they read: nothing is shuffled.
    _stored(chunks, index.rows, addition).write.mode("append").partitionBy("add", "part").parquet(f"{index.root}/content")
    fresh = spark.read.schema(index.schema).parquet(f"{index.root}/content").where((F.col("add") == addition) & F.col("content").isNotNull())
    lists = _lists(fresh.select("part", "at", "band", F.lower("content").alias("said"))).withColumn("add", F.lit(addition).cast("long")).withColumn("bucket", _bucket())
    # Some tasks a bucket, by the gram: a sample for ranges would cut all grams twice.
    each = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    dealt = lists.repartitionById(BUCKETS * each, F.col("bucket") * each + F.pmod(F.hash("gram"), F.lit(each)))
    with freed_shuffles(spark):
        dealt.sortWithinPartitions("bucket", "gram", "band").write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{index.root}/grams")
        counts = index.grams(spark).where(F.col("add") == addition).groupBy("bucket", "gram", "band").agg(F.sum(F.size("at")).cast("long").alias("n"))
        counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{index.root}/sizes")
    spark.range(1).select(F.lit(addition).cast("long").alias("add")).write.mode("append").parquet(f"{index.root}/ledger")


def _wanted(queries: DataFrame) -> DataFrame:
    """(query_id, gram) of the queries (query_id, query): what a match must have."""
    rows = queries.select("query_id", F.lower("query").alias("said"))
    kind = rows.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [query_grams(s) for s in b.column("said").to_pylist()]
            own = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(own, pa.int64())), pa.array([g for some in grams for g in some], pa.int64())], ["query_id", "gram"])

    return rows.mapInArrow(run, f"query_id {kind}, gram long")


def _fits_automaton(queries: DataFrame) -> bool:
    return (queries.agg(F.sum(F.length("query"))).first()[0] or 0) <= AUTOMATON_CHARS


def _padded(said: Column) -> Column:
    """The words of a lower-case text laid end to end, each padded as for trigrams."""
    return F.concat(F.lit("  "), F.regexp_replace(said, WORD_GAP, "   "), F.lit(" "))


def padded_trigrams(padded: str) -> set[str]:
    """The trigrams of padded words laid end to end: all but those that begin with the end of a word's padding."""
    return {padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " " or padded[i + 2] != " "}


def _readable_rows(content: DataFrame, ready: DataFrame) -> DataFrame:
    """(_word, _bits): which rows of the content are of ready documents, 64 rows of a part in one: a fortieth of what their ids take up."""
    at = F.col("at").cast("int")
    rows = content.select("document_id", (F.col("part") + F.shiftright(at, 6)).alias("_word"), F.expr("shiftleft(1L, cast(at as int) & 63)").alias("_bit"))
    return rows.join(ready, "document_id").groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def _only(content: DataFrame, readable_rows: DataFrame) -> DataFrame:
    """The rows of the content that ``_readable_rows`` has."""
    at = F.col("at").cast("int")
    marked = content.withColumn("_word", F.col("part") + F.shiftright(at, 6)).join(F.broadcast(readable_rows), "_word")
    return marked.where(F.expr("shiftright(_bits, cast(at as int) & 63) & 1 = 1")).drop("_word", "_bits")


def _read_once(content: DataFrame, queries: DataFrame, top_k: int) -> tuple[DataFrame, Broadcast]:
    """(query_id, chunk_id, document_id, part, _score): the chunks that hold a query, all of which are free of wildcards.

    A task keeps the best ``top_k`` of a query's matches: it lets go of others whenever it holds HELD_MATCHES.
    """
    said = F.lower("query")
    asked = queries.select("query_id", said.alias("said"), _padded(said).alias("padded")).toArrow()
    asking: dict[str, tuple[str, list]] = {}
    for query_id, literal, padded in zip(*(asked.column(c).to_pylist() for c in ("query_id", "said", "padded")), strict=True):
        asking.setdefault(literal, (padded, []))[1].append(query_id)
    sent = queries.sparkSession.sparkContext.broadcast(asking)
    kinds = [to_arrow_type(queries.schema["query_id"].dataType), *(to_arrow_type(content.schema[c].dataType) for c in ("chunk_id", "document_id", "part"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for literal, (padded, who) in sent.value.items():
            automaton.add_word(literal, (literal, padded, who))
        automaton.make_automaton()
        best: dict = {}
        held = 0

        def rows() -> pa.RecordBatch:
            flat = [(q, *rest, 0.0 - less) for q, found in best.items() for less, *rest in found]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], kind) for i, kind in enumerate((*kinds, pa.float64()))], _FOUND)

        for b in bounded(batches, "said"):
            for *ids, said, words, n in zip(*(b.column(c).to_pylist() for c in ("chunk_id", "document_id", "part", "said", "padded", "n_trigrams")), strict=True):
                for padded, who in {literal: (padded, who) for _, (literal, padded, who) in automaton.iter(said)}.values():
                    grams = padded_trigrams(padded)
                    shared = sum(g in words for g in grams)
                    either = n + len(grams) - shared
                    match = (-shared / either if either else 0.0, *ids)
                    for q in who:
                        best.setdefault(q, []).append(match)
                    held += len(who)
                if held >= HELD_MATCHES:
                    for found in best.values():
                        found.sort(key=lambda m: m[:2])
                        del found[top_k:]
                    held = sum(map(len, best.values()))
                    if 2 * held >= HELD_MATCHES:
                        yield rows()
                        held = 0
        for found in best.values():
            found.sort(key=lambda m: m[:2])
            del found[top_k:]
        yield rows()

    rows = content.select("chunk_id", "document_id", "part", "n_trigrams", F.lower("content").alias("said")).withColumn("padded", _padded(F.col("said")))
    types = [queries.schema["query_id"].dataType, *(content.schema[c].dataType for c in ("chunk_id", "document_id", "part"))]
    return rows.mapInArrow(run, ", ".join(f"{c} {t.simpleString()}" for c, t in zip(_FOUND, types, strict=False)) + ", _score double"), sent


#: Columns of what rounds find.
_FOUND = ["query_id", "chunk_id", "document_id", "part", "_score"]


def _sized(rows: DataFrame, n: int) -> DataFrame:
    """One side of a join, sent to all tasks if it is small by its rows and else dealt out."""
    return F.broadcast(rows) if n <= SENT_ROWS else rows.hint("merge")


def _distinct_ints(df: DataFrame, column: str) -> list[int]:
    """The values of a column that has few: buckets, parts or bands."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


def _write(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    where = scratch_dir(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def with_content(index: GramIndex, hits: DataFrame) -> DataFrame:
    """hits (chunk_id, part or not, any others) with document_id, content and metadata of their chunks; the hits are written once."""
    hits = _write(hits, "gram-hits")
    spark = hits.sparkSession
    stored = index.content(spark)
    if "part" in hits.columns:
        stored, hits = _named(stored, hits), hits.drop("part")
    rows = stored.withColumn("metadata", F.struct("metadata.*", "confidential_level")).select("chunk_id", "document_id", "content", "metadata")
    return rows.join(_sized(hits, hits.count()), "chunk_id")


def _named(content: DataFrame, rows: DataFrame) -> DataFrame:
    """The content's parts that rows (part) name, if they are few."""
    parts = [r[0] for r in rows.select("part").distinct().limit(NAMED_PARTS + 1).collect()]
    return content.where(F.col("part").isin(parts)) if len(parts) <= NAMED_PARTS else content


def keyword_search_batch(index: GramIndex, queries: DataFrame, documents: DataFrame, permissions: DataFrame, kb_ids: Sequence[str] | None, top_k: int, principal: Principal | None, reads: list[dict] | None = None) -> DataFrame:
    """``search.keyword_search`` for a table of queries (query_id, query): its columns after query_id, ``ord`` from 1.

    Blank and null queries find nothing; a query's wildcards keep their meaning, and one that is no valid pattern is an
    error, as in the scan. Query ids must be unique. ``reads`` gets,
    for every round of bands, how many candidates there were, and how many rows the parts of the content hold that were read.
    """
    found = with_content(index, ranked_chunks(index, queries, documents, permissions, kb_ids, top_k, principal, reads).drop("document_id"))
    score = F.col("_score")
    return found.select("query_id", "chunk_id", "document_id", "content", F.lit(0.0).alias("vector_score"), score.alias("keyword_score"), score.alias("final_score"), "metadata", "ord")


def ranked_chunks(index: GramIndex, queries: DataFrame, documents: DataFrame, permissions: DataFrame, kb_ids: Sequence[str] | None, top_k: int, principal: Principal | None, reads: list[dict] | None = None) -> DataFrame:
    """(query_id, chunk_id, document_id, part, _score, ord): ``keyword_search_batch`` without the chunks."""
    spark = queries.sparkSession
    asked = queries.where(F.trim("query") != "").select("query_id", "query", trigrams(F.col("query")).alias("asked")).withColumn("own", F.size("asked"))
    asked = _write(asked, "gram-asked")
    n_asked = asked.count()
    ready = _write(retrieval_filter(documents.where("status = 'ready'"), permissions, principal).select("document_id"), "gram-ready")
    ready = _sized(ready, ready.count())
    wanted = _write(_wanted(asked).withColumn("bucket", _bucket()), "gram-queries")
    buckets = _distinct_ints(wanted, "bucket")
    n_grams = wanted.count()
    sizes = index.sizes(spark).where(F.col("bucket").isin(buckets)).join(_sized(wanted.select("gram").distinct(), n_grams), "gram")
    sizes = _write(sizes.groupBy("gram", "band").agg(F.sum("n").alias("n")), "gram-sizes")
    total = wanted.join(_sized(sizes.groupBy("gram").agg(F.sum("n").alias("total")), n_grams), "gram", "left")
    known = Window.partitionBy("query_id")
    ranked = total.withColumn("nth", F.row_number().over(known.orderBy("total", "gram"))).withColumn("missing", F.max(F.col("total").isNull()).over(known))
    chosen = _write(ranked.where((F.col("nth") <= RAREST) & ~F.col("missing")).withColumn("bit", F.expr("shiftleft(1, nth - 1)")).withColumn("need", F.bit_or("bit").over(known)).select("query_id", "gram", "bucket", "nth", "bit", "need"), "gram-chosen")

    rarest = sizes.join(_sized(chosen.where("nth = 1"), n_asked), "gram").groupBy("band").agg(F.sum("n").alias("n"))
    held = {r["band"]: r["n"] for r in index.sizes(spark).where(F.col("gram") == ANY).groupBy("band").agg(F.sum("n").alias("n")).collect()}
    plan = [(r["band"], r["n"]) for r in rarest.orderBy("band").collect()]
    found = _nothing(index, spark, asked)
    readable_rows = None
    answerable = _sized(chosen.select("query_id").distinct(), n_asked)
    open_queries, goal, at = asked.join(answerable, "query_id", "left_semi"), FIRST_CANDIDATES * max(1, n_asked), 0
    while at < len(plan):
        bands, size = [], 0
        while at < len(plan) and (not bands or size < goal):
            bands.append(plan[at][0])
            size += plan[at][1]
            at += 1
        goal *= 4
        once = size >= READ_ONCE * sum(held[b] for b in bands) and _fits_automaton(open_queries)
        if once and readable_rows is None:
            readable_rows = _write(_readable_rows(index.content(spark), ready), "gram-readable")
        found = _round(index, open_queries, chosen, bands, readable_rows if once else None, found, ready, kb_ids, top_k, reads)
        if at < len(plan):
            least = F.lit(float(_least(plan[at][0])))
            worst = found.groupBy("query_id").agg(F.count("*").alias("k"), F.min("_score").alias("worst"))
            bound = F.least(F.lit(1.0), F.col("own") / F.greatest(least, F.lit(1.0)))
            still = asked.join(_sized(worst, n_asked), "query_id", "left").where((F.coalesce("k", F.lit(0)) < top_k) | (F.col("worst") <= bound))
            open_queries = _write(still.join(answerable, "query_id", "left_semi").select("query_id", "query", "asked", "own"), "gram-open")
            if open_queries.isEmpty():
                break
    order = Window.partitionBy("query_id").orderBy(F.col("_score").desc_nulls_first(), "chunk_id")
    return found.withColumn("ord", F.row_number().over(order))


def _nothing(index: GramIndex, spark: SparkSession, asked: DataFrame) -> DataFrame:
    """An empty table of results."""
    c = index.content(spark).where(F.lit(False))
    return c.select(F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), "chunk_id", "document_id", "part", F.lit(0.0).alias("_score"))


def _round(index: GramIndex, queries: DataFrame, chosen: DataFrame, bands: list[int], readable_rows: DataFrame | None, found: DataFrame, ready: DataFrame, kb_ids: Sequence[str] | None, top_k: int, reads: list[dict] | None) -> DataFrame:
    """The best results so far and of some bands, of open queries; closed queries keep what they have.

    With ``readable_rows`` one automaton reads those of the bands once.
    """
    spark = queries.sparkSession
    stored = index.content(spark).where(F.col("band").isin(bands) & in_bases(kb_ids))
    once = readable_rows is not None
    # A pattern without wildcards is just contained; any other is compiled for every pair.
    wild = F.rlike("query", F.lit(r"[%_\\]"))
    listed = queries.where(wild) if once else queries
    fresh, sent, seen = found.where(F.lit(False)), None, {"bands": bands, "candidates": 0, "rows_read": 0}
    if once:
        matches, sent = _read_once(_only(stored, readable_rows), queries.where(~wild), top_k)
        fresh = fresh.unionByName(matches)
        if reads is not None:  # of all rows, readable or not
            seen = {"bands": bands, "candidates": _read_once(stored, queries.where(~wild), 1 << 62)[0].count(), "rows_read": stored.count()}
    if not once or not listed.isEmpty():
        mine = _write(chosen.join(_sized(listed.select("query_id"), listed.count()), "query_id", "left_semi"), "gram-mine")
        rows = index.grams(spark).where(F.col("bucket").isin(_distinct_ints(mine, "bucket")) & F.col("band").isin(bands))
        hits = rows.join(_sized(mine.drop("bucket"), mine.count()), "gram").select("query_id", "bit", "need", "part", F.explode("at").alias("at"))
        candidates = hits.groupBy("query_id", "part", "at").agg(F.bit_or("bit").alias("had"), F.first("need").alias("need")).where("had = need")
        candidates = _write(candidates.select("query_id", "part", (F.col("part") + F.col("at")).alias("_row")), "gram-candidates")
        n, content = candidates.count(), _named(stored, candidates)
        if reads is not None:
            seen = {"bands": bands, "candidates": seen["candidates"] + n, "rows_read": seen["rows_read"] + content.count()}
        asking = candidates.drop("part").join(_sized(listed, listed.count()), "query_id")
        pairs = content.withColumn("_said", F.lower("content")).withColumn("_row", F.col("part") + F.col("at")).join(_sized(asking, n), "_row")
        same = F.when(wild, F.ilike("content", F.concat(F.lit("%"), "query", F.lit("%")))).otherwise(F.contains("_said", F.lower("query")))
        # Padded words laid end to end hold a trigram of a padded word just where a word has it.
        shared = F.size(F.filter("asked", lambda g: F.contains(F.col("_padded"), g)))
        score = F.coalesce(F.try_divide(shared.cast("double"), (F.col("n_trigrams") + F.col("own") - shared).cast("double")), F.lit(0.0))
        fresh = fresh.unionByName(pairs.where(same).withColumn("_padded", _padded(F.col("_said"))).withColumn("_score", score).select(*_FOUND))
    if reads is not None:
        reads.append(seen)
    best = Window.partitionBy("query_id").orderBy(F.col("_score").desc_nulls_first(), "chunk_id")
    best_of = lambda rows: rows.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= top_k).drop("_nth")
    readable = (best_of(fresh) if once and listed.isEmpty() else fresh).join(ready, "document_id").select(*_FOUND)
    merged = best_of(found.unionByName(readable))
    try:
        return _write(merged, "gram-found")
    finally:
        if sent is not None:
            sent.destroy()


def keyword_search(index: GramIndex, documents: DataFrame, permissions: DataFrame, query: str, kb_ids: Sequence[str] | None, top_k: int, principal: Principal | None) -> DataFrame:
    """``search.keyword_search`` by the index."""
    one = documents.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    return keyword_search_batch(index, one, documents, permissions, kb_ids, top_k, principal).drop("query_id")

