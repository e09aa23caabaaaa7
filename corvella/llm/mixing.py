"""Mixing sources to target weights over packed blocks of words.

The documents of a source are laid end to end in hash order and cut into blocks of ``block_words`` words. Each
source gets as many block slots as its target needs; a multinomial draw deals them to the output shards, without
replacement from what is left of each source, so that the totals come out exact. Slot numbers of a source are
mapped through pseudorandom permutations of its block numbers, one per pass over the source, and joined with
the blocks by number. No source takes more than three passes, so no document is taken more than three times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, shuffle_width, table, text_chunks, unused, whole_text, with_offsets

BLOCK_WORDS = 64
OUTPUT_SHARDS = 64
MAX_PASSES = 3
#: The draws go down in two steps, to so many groups of sources on the driver and to a group's sources in a task.
SOURCE_GROUPS = 1 << 10
_SLOTS_A_ROW = 1 << 16


def numbered_sources(sized: DataFrame) -> DataFrame:
    """(source, source_size, source_no): sources in code-point order, null last, numbered from 0 without a gap.

    Sources are sorted by ranges and numbered within each; only the counts of the ranges are summed in one task.
    """
    spark = sized.sparkSession
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # A range's number is in the upper bits of the id, the place within it in the lower 33.
    placed = materialize(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    spread = placed.select("source", "source_size", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND((1 << 33) - 1).alias("nth"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = spread.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return spread.join(bases, "range").select("source", "source_size", (F.col("base") + F.col("nth")).alias("source_no"))


def share_unit(sources: DataFrame, passes: int = MAX_PASSES) -> float:
    """What a weight of 1 is worth: sources (source_size, weight) share all sizes, none above passes times its own.

    Each round takes what is above out and shares the excess out again. A round is one sum over the sources;
    the worth only rises, so those above stay above and rounds end when no source joins them.
    """
    size, weight = F.col("source_size"), F.col("weight")
    unit, above = 0.0, -1
    while True:
        full = F.lit(unit) * weight > passes * size
        found = sources.where("source_size > 0").agg(
            F.count(F.when(full, 1)).alias("above"), F.sum(size).alias("total"), F.sum(F.when(full, passes * size)).alias("given"), F.sum(F.when(~full, weight)).alias("open")
        ).first()
        if found.total is None or not found.open or found.above == above:
            return unit
        unit, above = (found.total - (found.given or 0)) / found.open, found.above


def plan_sources(sized: DataFrame, block_words: int) -> DataFrame:
    """(source_no, source, source_size, target, blocks, slots), written once. Weights run 1, 2, 3, 1, 2, ..."""
    sources = materialize(numbered_sources(sized).withColumn("weight", 1 + F.col("source_no") % 3), "mix-weights")
    size, target = F.col("source_size"), F.col("target")
    wanted = sources.withColumn("target", F.least(F.lit(share_unit(sources)) * F.col("weight"), (MAX_PASSES * size).cast("double")))
    # Whole passes take the source's words exactly; the rest of the target is counted in blocks.
    passes = F.when(size > 0, F.least(F.floor(target / size), F.lit(MAX_PASSES))).otherwise(0)
    blocks = F.ceil(size / block_words).cast("long")
    slots = F.least(passes * blocks + F.rint((target - passes * size) / block_words).cast("long"), MAX_PASSES * blocks)
    return materialize(wanted.select("source_no", "source", "source_size", "target", blocks.alias("blocks"), slots.alias("slots")), "mix-plan")


def even_shares(total: int, shards: int) -> list[int]:
    """total dealt to shards, counts at most one apart."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def deal_slots(slots: np.ndarray, wants: Sequence[int], seed: int) -> Iterator[np.ndarray]:
    """For every shard how many slots it takes of each source: multinomial draws from what is left, shard after shard."""
    rng = np.random.default_rng(seed)
    left = slots.astype(np.int64)
    for shard, want in enumerate(wants):
        drawn = np.zeros(len(left), np.int64)
        while shard < len(wants) - 1 and (short := want - int(drawn.sum())) > 0:
            room = left - drawn
            drawn += np.minimum(rng.multinomial(short, room / room.sum()), room)
        drawn = drawn if shard < len(wants) - 1 else left.copy()
        left -= drawn
        yield drawn


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(n), by four Feistel rounds; values outside the range walk on until inside."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    bits += ((np.uint64(1) << (2 * bits)) < n.astype(np.uint64)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo].astype(np.uint64)
        high, low = out[todo] >> b, out[todo] & m
        for r in range(4):
            x = (low + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            high, low = low, high ^ ((x >> np.uint64(29)) & m)
        out[todo] = high << b | low
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def dealt_slots(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, source_no, blocks, first, last): which slots of a source go to which shard.

    Sources are put into SOURCE_GROUPS groups by number. The groups' draws are made on the driver (groups x
    shards numbers at any size), those within a group in a task that holds one number a source.
    """
    spark = plan.sparkSession
    grouped = plan.where("slots > 0").select("source_no", "blocks", "slots", (F.col("source_no") % SOURCE_GROUPS).cast("int").alias("grp"))
    totals = sorted((r.grp, r.slots) for r in grouped.groupBy("grp").agg(F.sum("slots").alias("slots")).collect())
    sums = np.array([n for _, n in totals], np.int64)
    dealt = np.array(list(deal_slots(sums, even_shares(int(sums.sum()), shards), seed)))
    wants = spark.createDataFrame([(g, dealt[:, i].tolist()) for i, (g, _) in enumerate(totals)], "grp int, wants array<long>")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_no", ignore_index=True)
        first, parts = np.zeros(len(rows), np.int64), []
        for shard, drawn in enumerate(deal_slots(rows["slots"].to_numpy(), rows["wants"][0].tolist(), seed + 1 + int(rows["grp"][0]))):
            some = drawn > 0
            parts.append(rows.loc[some, ["source_no", "blocks"]].assign(shard=shard, first=first[some], last=(first + drawn)[some]))
            first = first + drawn
        return pd.concat(parts)[["shard", "source_no", "blocks", "first", "last"]]

    return grouped.join(wants, "grp").groupBy("grp").applyInPandas(run, "shard int, source_no long, blocks long, first long, last long")


def slot_table(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, shard, slot, pass, block): every slot of the mix with the block it takes."""
    spark = plan.sparkSession
    starts = F.explode(F.sequence("first", F.col("last") - 1, F.lit(_SLOTS_A_ROW)))
    ranges = dealt_slots(plan, shards, seed).select("shard", "source_no", starts.alias("first"), "last", "blocks")
    ranges = ranges.select("shard", "source_no", "first", F.least("last", F.col("first") + _SLOTS_A_ROW).alias("last"), "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, source, first, last, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                slot = np.arange(first, last)
                count = np.full(len(slot), n)
                block = permute(slot % n, count, (slot // n) * 1_000_003 + source * 7_919 + seed)
                columns = [np.full(len(slot), source, np.int64), np.full(len(slot), shard, np.int32), slot, (slot // n).astype(np.int32), block]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["source_no", "shard", "slot", "pass", "block"])

    return ranges.repartition(shuffle_width(spark)).mapInArrow(run, "source_no long, shard int, slot long, pass int, block long")


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    words = F.size(F.filter(F.split(whole_text(), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")
    return docs.select("doc_id", "source", words.alias("size"), _row_hash().alias("row_hash"), *more)


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: doc_id, source, size, source_size, target, taken, row_hash, row_no for every row.
    pieces: shard, source_no, slot, pass, block, row_no, first, n: which words of which document fill which slot.

    A null source is a source (last in order); null and empty texts have size 0 and take no part, and neither do
    sources without words. Rows that agree in id and text follow each other in their source and are taken each
    on its own. An empty table gives empty results. Reruns agree: nothing depends on partitions.
    """
    return _mix(_sized(docs).withColumn("row_no", F.monotonically_increasing_id()), block_words, shards, seed)


def _mix(rows: DataFrame, block_words: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``mix`` for rows (doc_id, source, size, row_hash, row_no) whose numbers are their own."""
    spark = rows.sparkSession
    sized = materialize(rows, "mix-sizes")
    plan = plan_sources(sized, block_words)
    catalogue = plan.select("source_no", F.col("source").alias("source_"), "source_size", "target")
    placed = sized.join(catalogue, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    buckets = 4 * shuffle_width(spark)
    laid = with_offsets(placed, ["source_no"], ["doc_id", "row_hash", "size"], "size", "first", buckets)
    laid = materialize(laid, "mix-laid")
    ends = F.floor((F.col("first") + F.col("size") - 1) / block_words)
    cut = laid.where("size > 0").select("source_no", "row_no", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / block_words), ends)).alias("block"))
    begin = F.greatest(F.col("first"), F.col("block") * block_words)
    stop = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block_words)
    blocks = cut.select("source_no", "block", "row_no", (begin - F.col("first")).alias("first"), (stop - begin).alias("n"))
    # Exploded blocks are far larger than the table they are estimated from: no broadcast on that estimate.
    pieces = slot_table(plan, shards, seed).join(blocks.hint("merge"), ["source_no", "block"])
    taken = pieces.groupBy("row_no").agg(F.sum("n").alias("taken"))
    documents = laid.join(taken, "row_no", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "row_hash", "row_no")
    return documents, pieces


def _row_hash() -> Column:
    return F.xxhash64("doc_id", "source", whole_text())


_WORDS = re.compile(WORD)


def _cut(text: str, parts: list[tuple[int, int]]) -> str:
    """The words first .. first + n of every part with the white space among them; parts that touch are one."""
    runs: list[list[int]] = []
    for first, n in parts:
        if runs and runs[-1][1] == first:
            runs[-1][1] += n
        else:
            runs.append([first, first + n])
    words = [m.span() for m in _WORDS.finditer(text)]
    if runs == [[0, len(words)]]:
        return text
    return "\n".join(text[words[a][0] : words[z - 1][1]] for a, z in runs)


def keep_mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = 17) -> DataFrame:
    """The mixed corpus as rows with the columns of docs: one row for every pass that takes words of a document.

    A pass that takes a document whole returns its text as it stands; one that takes some blocks of it returns
    the words of those blocks, with the white space among them kept and a line break between blocks that don't
    touch. Documents without a taken word are left out. Of rows that agree in id, source and text each is taken
    on its own, with its own other columns. The rows are numbered and written once, so that a number stays a row's.
    """
    rows = materialize(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_no")), "mix-rows")
    sized = _sized(rows.select("row.doc_id", "row.source", "row.text", "row_no"), "row_no")
    _, pieces = _mix(sized, block_words, shards, seed)
    by_pass = pieces.groupBy("row_no", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("parts"))
    wanted = by_pass.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("pass", "parts"))).alias("taken"))
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            source, texts = [], []
            for i, (text, taken) in enumerate(zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist(), strict=True)):
                for one in taken:
                    source.append(i)
                    texts.append(_cut(text, [(x["first"], x["n"]) for x in one["parts"]]))
            picked = b.take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else picked.column(i) for i in range(len(columns))], columns)

    return rows.join(wanted.hint("merge"), "row_no").select("row.*", F.col("taken").alias(unused(docs, "taken"))).mapInArrow(run, docs.schema)


def op10_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")
