"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every round is a grouped minimum and a join, both of which Spark can split; each round's edges are written to
the shared folder, so a lost executor costs one round at most. Nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, whole_text


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of the component.

    ``edges`` has the columns a and b of one orderable type; loops, repeats and both directions are allowed,
    rows with a null end are no edges. Without edges the result is empty.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = materialize(current, name)
    seen = _state(current)
    while seen[0]:
        before, current = current, materialize(_stars(current), name)
        discard(before)
        now = _state(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def one_of_each(docs: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of docs that stay; components: doc_id, text_hash, root and component_id of every row.

    Of rows with one id and text that differ in other columns the one with the smallest hash of all columns stays, whatever
    order they come in; rows that agree in all are alike.
    """
    chosen = (
        components
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", "doc_id")
        .agg(F.min("text_hash").alias("_hash"))
        .select(F.col("doc_id").alias("_id"), "_hash")
    )
    # The rows travel as one struct, so no column of theirs clashes with the ones added here.
    row = F.struct("*")
    hashed = docs.select(row.alias("row"), F.col("doc_id").alias("id"), F.xxhash64(whole_text()).alias("text_hash"), F.xxhash64(F.to_json(row)).alias("row_hash"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    repeats = Window.partitionBy("id", "text_hash").orderBy("row_hash")
    kept = hashed.join(chosen, same, "left_semi").withColumn("nth", F.row_number().over(repeats))
    return kept.where("nth = 1").select("row.*")
