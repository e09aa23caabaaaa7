"""The prefix trie of conversations, by the depths that each conversation owns.

A node is a distinct beginning of d turns; it belongs to the smallest conversation that starts with it. The smallest
member of a beginning is also the smallest of every longer one it has, so a conversation owns its depths from some first
one on. That first depth is found by binary search: every round joins one prefix digest of each undecided conversation
with the smallest member of that digest. What a conversation owns is a chain; a chain hangs on the owner of the depth
before its first, and these links are the tree. Totals go up it by doubling: round j adds to every chain what stands 2^j
links below, so the rounds are few however tall the tree is.

A prefix digest is the sum of digests of (depth, turn), so that prefix sums over ranges of rows give it, and no task
needs a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_width, table

#: Every conversation borrows its first crc32(id) % SHARED turns from the first of its FAMILY.
SHARED, FAMILY = 6, 100
#: Ids of a node's ends are joined to texts of about so many characters before they are hashed in order.
PIECE = 1 << 16
_SUMS = ("g0", "g1", "g2", "g3")


def _running(df: DataFrame, group: str, ranges: Sequence[Column], order: Sequence[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df with the sums up to and with each row of its group; ``ranges`` must not contradict ``order``.

    Range partitions may split a group. Each is summed up on its own; groups that span several get what stands before.
    """
    width = shuffle_width(df.sparkSession)
    laid = materialize(df.repartitionByRange(width, F.col(group), *ranges).withColumn("part", F.spark_partition_id()), name)
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy("part", group).agg(*(F.sum(c).alias(f"_total_{out}") for out, c in sums.items()))
    bases = totals.select("part", group, *(F.sum(f"_total_{out}").over(before).alias(f"_base_{out}") for out in sums))
    bases = bases.where(F.col(f"_base_{next(iter(sums))}").isNotNull())
    within = Window.partitionBy("part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = laid.select("*", *(F.sum(c).over(within).alias(f"_sum_{out}") for out, c in sums.items())).join(bases, ["part", group], "left")
    kept = [c for c in df.columns if c not in sums]
    return summed.select(*kept, *((F.col(f"_sum_{out}") + F.coalesce(f"_base_{out}", F.lit(0))).cast("long").alias(out) for out in sums))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv, idx, said, chars) of every turn: its place from 1, a digest of role and text, the code points of the text.

    Turns stand by number (null first), then role, then text. A null role or text is empty. Turns without a conversation
    id belong to none and are left out.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    first = F.col("turn").asc_nulls_first()
    # Ranges are bounded by the beginnings of texts, which the driver may sample.
    ranges = [first, F.substring("role", 1, 16), F.substring("text", 1, 16)]
    placed = _running(rows, "conv", ranges, [first, F.col("role"), F.col("text")], {"idx": F.lit(1)}, "trie-turns")
    said = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return placed.select("conv", "idx", said.alias("said"), F.length("text").cast("long").alias("chars"))


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of the rebuilt conversations, from numbered turns.

    turns: conv, depth (from 1), said, chars. members: conv, n (its turns; 0 is possible).
    """
    c = F.col("conv")
    heads = turns.where((c % FAMILY == 0) & (F.col("idx") < SHARED)).select(c.alias("base"), "idx", "said", "chars")
    held = heads.groupBy("base").agg(F.max("idx").alias("held"))
    convs = turns.groupBy("conv").agg(F.max("idx").alias("own")).select("conv", "own", (c - c % FAMILY).alias("base"), (F.crc32(c.cast("string")) % SHARED).alias("h"))
    shared = F.least("h", F.coalesce("held", F.lit(0)))
    members = materialize(convs.join(held, "base", "left").select("conv", "base", "h", shared.alias("k"), (shared + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("n")), "trie-members")
    borrowed = heads.join(members, "base").where("idx <= k").select("conv", F.col("idx").alias("depth"), "said", "chars")
    own = turns.join(members, "conv").where("idx > h").select("conv", (F.col("k") + F.col("idx") - F.col("h")).alias("depth"), "said", "chars")
    return borrowed.unionByName(own), members.select("conv", "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, key, chars): the digest of every beginning, its last turn's code points."""
    mark = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("said")))
    parts = {g: F.conv(F.substring(mark, 1 + 8 * i, 8), 16, 10).cast("long").alias(g) for i, g in enumerate(_SUMS)}
    rows = turns.select("conv", "depth", "chars", *parts.values())
    summed = _running(rows, "conv", [F.col("depth")], [F.col("depth")], {g: F.col(g) for g in _SUMS}, "trie-marks")
    return summed.select("conv", "depth", F.unhex(F.md5(F.concat_ws(":", "depth", *_SUMS))).alias("key"), "chars")


def first_owned(members: DataFrame, beginnings: DataFrame, owners: DataFrame, root: int) -> DataFrame:
    """(conv, n, first, above): the first depth a conversation owns, n + 1 if none, and who owns the depth before.

    owners: (key, owner). Depth 0 belongs to ``root``. A round probes the middle of each undecided conversation.
    """
    todo = members.select("conv", "n", F.lit(1).cast("long").alias("lo"), (F.col("n") + 1).alias("hi"), F.lit(root).cast("long").alias("above"))
    longest = members.agg(F.max("n")).first()[0] or 0
    done: list[DataFrame] = []
    written = None
    for _ in range(int(longest).bit_length()):
        probe = todo.withColumn("depth", F.expr("(lo + hi) div 2"))
        asked = probe.join(beginnings.select("conv", "depth", "key"), ["conv", "depth"]).join(owners, "key")
        mine = F.col("owner") == F.col("conv")
        step = materialize(asked.select("conv", "n", F.when(mine, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(mine, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(mine, F.col("above")).otherwise(F.col("owner")).alias("above")), "trie-search")
        if not done:  # those without a turn have nothing to search
            done.append(todo.where("lo = hi"))
        done.append(step.where("lo = hi"))
        todo, written = step.where("lo < hi"), step
    found = done[0] if done else todo
    for part in done[1:]:
        found = found.unionByName(part)
    if written is not None:
        found = found.unionByName(written.where("lo < hi"))
    return found.select("conv", "n", F.col("lo").alias("first"), "above")


def chain_totals(chains: DataFrame) -> DataFrame:
    """(conv, leaves, saved) of every chain with all that hangs on it, from (conv, up, leaves, saved) of the chains alone."""
    now = materialize(chains.select("conv", "up", "leaves", "saved"), "trie-totals")
    while not now.where("up is not null").isEmpty():
        below = now.where("up is not null").groupBy(F.col("up").alias("conv")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("spared"))
        far = now.select(F.col("conv").alias("up"), F.col("up").alias("farther"))
        summed = now.join(below, "conv", "left").select("conv", "up", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("spared", F.lit(0))).alias("saved"))
        after = materialize(summed.join(far, "up", "left").select("conv", F.col("farther").alias("up"), "leaves", "saved"), "trie-totals")
        discard(now)
        now = after
    return now.drop("up")


def end_digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of (owner, depth, conv): the digest of a node's ids in numeric order, comma-joined.

    Range partitions join ids to texts; a node's texts then stream through one digest, a few rows for many ids.
    """
    width = shuffle_width(ends.sparkSession)
    keys = ["owner", "depth", "conv"]
    ordered = ends.select(*(F.col(k).cast("long") for k in keys)).repartitionByRange(width, *keys).sortWithinPartitions(*keys)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size = None, [], 0
        for b in batches:
            out: list[tuple] = []
            for owner, depth, conv in zip(*(b.column(k).to_pylist() for k in keys), strict=True):
                if ids and (node != (owner, depth) or size >= PIECE):
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                node = (owner, depth)
                ids.append(conv)
                size += 8
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["owner", "depth", "conv", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, ids[0], ",".join(map(str, ids)))], ["owner", "depth", "conv", "ids"])

    joined = ordered.mapInArrow(join, "owner long, depth long, conv long, ids string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        names = ["owner", "depth", "ends_sha256"]
        for b in batches:
            out: list[tuple] = []
            for owner, depth, ids in zip(*(b.column(k).to_pylist() for k in ("owner", "depth", "ids")), strict=True):
                if node == (owner, depth):
                    running.update(b"," + ids.encode())
                else:
                    if node:
                        out.append((*node, running.hexdigest()))
                    node, running = (owner, depth), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, running.hexdigest())], names)

    return joined.repartition(width, "owner", "depth").sortWithinPartitions(*keys).mapInArrow(digest, "owner long, depth long, ends_sha256 string")


def turn_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations, see ``op12_turn_trie``.

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Null turn numbers come first, ties stand by role and text, null roles and texts are empty, repeated
    turns are turns each; turns without a conversation id are left out. A conversation whose turns are all dropped by
    its rebuilding is a member of the root alone. An empty table has no node. Only the four columns are read.
    """
    turns, members = rebuild(numbered(conversations))
    beginnings = materialize(prefixes(turns), "trie-prefixes")
    nodes = materialize(beginnings.groupBy("key").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.first("chars").alias("chars")), "trie-nodes")
    n_all, root = members.agg(F.count("*"), F.min("conv")).first()
    searched = materialize(first_owned(members, beginnings, nodes.select("key", "owner"), root if n_all else 0), "trie-chains")
    spark = conversations.sparkSession
    top = spark.createDataFrame([(root, n_all, 0, 0)] if n_all else [], "owner long, n_convs long, depth long, chars long")
    up = F.when(F.col("conv") != F.lit(root if n_all else 0), F.col("above"))
    chains = searched.where((F.col("first") <= F.col("n")) | up.isNull()).select("conv", up.alias("up"), (F.col("first") - 1).alias("at"))
    kids = chains.where("up is not null").groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.count("*").alias("kids"))
    owned = nodes.select("owner", "n_convs", "depth", "chars").unionByName(top).join(kids, ["owner", "depth"], "left")
    owned = owned.join(searched.select(F.col("conv").alias("owner"), "n", "first", "above"), "owner")
    more = (F.col("depth") < F.col("n")).cast("long")
    children = F.coalesce("kids", F.lit(0)) + more
    owned = materialize(owned.select("owner", "depth", "n_convs", children.alias("n_children"), F.when(F.col("depth") == F.col("first"), F.col("above")).when(F.col("depth") > 0, F.col("owner")).alias("parent"), (children == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "trie-owned")
    alone = owned.groupBy(F.col("owner").alias("conv")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = chain_totals(chains.join(alone, "conv"))
    hung = chains.where("up is not null").join(totals, "conv").groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("spared"))
    valued = owned.join(hung, ["owner", "depth"], "left").select("owner", "depth", "n_convs", "n_children", "parent", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("spared", F.lit(0))).alias("saved_tokens"))
    deepest = [F.col("depth").desc()]
    summed = _running(valued, "owner", deepest, deepest, {"n_leaves": F.col("n_leaves"), "saved_tokens": F.col("saved_tokens")}, "trie-sums")
    ends = end_digests(searched.select(F.when(F.col("first") <= F.col("n"), F.col("conv")).otherwise(F.col("above")).alias("owner"), F.col("n").alias("depth"), "conv"))
    return summed.join(ends, ["owner", "depth"], "left").select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie(table(spark, sf_dir, "conversations"))


#: The unsigned crc32 of a decimal, digit by digit and bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, CAST(length({0}) + 1 AS BIGINT)), lambda i: CAST(ascii({0}[i]) AS BIGINT))),
  lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda a, k: xor(a >> 1, (a & 1) * 3988292384))))"""

OP12_SQL = f"""
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS idx
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC.format("CAST(conv_id AS VARCHAR)")} % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM numbered)
), parts AS (
  SELECT c.conv_id, 0 AS src, n.idx, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.base AND n.idx <= c.h
  UNION ALL
  SELECT c.conv_id, 1, n.idx, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.idx > c.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY src, idx) AS depth, role, text FROM parts
), beginnings AS (
  SELECT conv_id, depth, length(text) AS chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved FROM beginnings GROUP BY depth, key
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN beginnings b ON b.conv_id = n.conv_id AND b.depth = n.depth - 1
  LEFT JOIN nodes p ON p.depth = b.depth AND p.key = b.key
), kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2
), counted AS (SELECT l.*, coalesce(k.n_children, 0) AS n_children FROM linked l LEFT JOIN kids k USING (conv_id, depth)
), sums AS (
  SELECT b.depth, b.key, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(x.saved) AS saved_tokens
  FROM counted x JOIN beginnings b ON b.conv_id = x.conv_id AND b.depth <= x.depth GROUP BY b.depth, b.key
), ends AS (
  SELECT b.depth, b.key, string_agg(CAST(b.conv_id AS VARCHAR), ',' ORDER BY b.conv_id) AS ids
  FROM beginnings b JOIN (SELECT conv_id, max(depth) AS depth FROM beginnings GROUP BY conv_id) m USING (conv_id, depth) GROUP BY b.depth, b.key
)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, c.parent_conv_id, c.n_convs, c.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM counted c JOIN sums s USING (depth, key) LEFT JOIN ends e USING (depth, key)
"""
