"""Helpers the training-data operators share: shared-folder tables, whole-text columns, prefix sums."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (fixed by the result contracts).
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corvella/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    Spark is told to remove the shuffle files of this write when it is done, since nothing reads them again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Empty a table that ``materialize`` has written and that nothing will read again."""
    files = df.inputFiles()
    if files:
        path = files[0].rsplit("/", 1)[0]
        assert "/corvella/" in path, path
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bits of a hash filter: 4 MB whatever the input, so it may be broadcast.
FILTER_BITS = 1 << 25


def hash_filter(df: DataFrame, column: str) -> np.ndarray:
    """One bit for every value of a column of hashes, as 64-bit words. It only prunes: others may pass as well."""
    bit = F.pmod(column, F.lit(FILTER_BITS))
    words = df.select(F.shiftright(bit, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(`{column}`, {FILTER_BITS}) & 63 as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes % FILTER_BITS).astype(np.uint64)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20, index: int | None = None) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches so that the column "text" (or number ``index``) of one holds about ``limit`` bytes.

    A text is never cut; one longer than the limit is a batch of its own.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text") if index is None else index)
        sizes = pc.binary_length(column).to_pylist() if batch.num_rows else []
        start = total = 0
        for i, size in enumerate(sizes):
            if size and size >= limit and start < i:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size or 0
            if total >= limit:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def release_memory() -> None:
    """Give back what a task has freed: a Python worker outlives its tasks, and allocators keep freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = 1 << 20) -> DataFrame:
    """mapInArrow over batches with a bounded amount of text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit):
            out = fn(chunk)
            if out is not None and out.num_rows:
                yield out
        release_memory()

    return df.mapInArrow(run, schema)


def with_offsets(df: DataFrame, group: Sequence[str], order: Sequence[str], size: str, out: str, buckets: int) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows before this one in its group.

    The order within a group is (hash bucket of the order columns, order columns). No task holds a group:
    bucket sums are added up first (groups x buckets small rows), then every bucket is numbered on its own.
    Group columns must not be null. Rows that tie in every order column follow each other in any order.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sums = bucketed.groupBy(*group, "_bucket").agg(F.sum(size).alias("_bucket_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*group, "_bucket", F.coalesce(F.sum("_bucket_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.join(bases, [*group, "_bucket"])
        .withColumn(out, (F.col("_base") + F.coalesce(F.sum(size).over(inner), F.lit(0))).cast("long"))
        .drop("_bucket", "_base")
    )
