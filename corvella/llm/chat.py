"""Chat formatting as prefix trees: conversations that begin alike share the tokens of their common turns.

A node is a turn after a given beginning; its key is a hash chain over the turns up to it, so equal beginnings have
equal keys and one grouping merges them. Nodes without a fork among them form segments. Only the forks order a tree:
a conversation's path is the list of its segments, and sorting paths, the child most conversations take first, is
depth-first order. Every segment's tokens stand together in the stream; shared tokens come once. Each node keeps
where its tokens stand, the position its first token has in its conversations (position ids count on from there), the
token range under the loss mask, and the intervals of the stream its tokens attend to. Intervals that touch are one,
so with the most taken child first a node has few, however long its conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import coder, default_vocabulary
from .common import materialize, shuffle_width, table, text_chunks

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: No control string, ours or another template's, keeps its first character inside a text.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))


def escape(text: str) -> str:
    for plain, marked in ESCAPES:
        text = text.replace(plain, marked)
    return text


def unescape(text: str) -> str:
    for plain, marked in reversed(ESCAPES):
        text = text.replace(marked, plain)
    return text


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition(TEXT)
        turns.append((unescape(role), unescape(rest.removesuffix(END))))
    return turns


_ROW = "conv {conv}, idx long, key binary, parent binary, tree binary, tokens array<int>, loss_from int, loss_to int, position long, n_tokens long"
_INTERVAL = "struct<start:bigint,stop:bigint>"


def _encoded(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """Every turn with its place, node and tokens.

    A conversation streams through its task turn by turn, in order; nothing of it but a running hash and position stays.
    """
    spark = conversations.sparkSession
    rows = conversations.select(F.struct("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition(shuffle_width(spark), "conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        end = own.encode([END])[0]
        heads: dict[str, np.ndarray] = {}
        conv, idx, key, tree, position = None, 0, b"", b"", 0
        for batch in text_chunks(batches):
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            bodies = own.encode([escape(t) for t in texts])
            out: dict[str, list] = {c: [] for c in ("idx", "key", "parent", "tree", "loss_from", "loss_to", "position", "n_tokens")}
            tokens: list[np.ndarray] = []
            for c, role, text, body in zip(batch.column("conv").to_pylist(), roles, texts, bodies, strict=True):
                if c != conv:
                    conv, idx, key, position = c, 0, b"", 0
                raw = role.encode("utf-8")
                parent, key = key, hashlib.blake2b(b"%s%d:%s%s" % (key, len(raw), raw, text.encode("utf-8")), digest_size=16).digest()
                tree = tree if idx else key
                if role not in heads:
                    if len(heads) > 10_000:
                        heads.clear()
                    heads[role] = own.encode([TURN + escape(role) + TEXT])[0]
                head = heads[role]
                n = len(head) + len(body) + len(end)
                tokens += [head, body, end]
                for name, value in (("idx", idx), ("key", key), ("parent", parent or None), ("tree", tree), ("loss_from", len(head)), ("loss_to", len(head) + (len(body) if role == "assistant" else 0)), ("position", position), ("n_tokens", n)):
                    out[name].append(value)
                idx, position = idx + 1, position + n
            offsets = np.concatenate([[0], np.cumsum(out["n_tokens"])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int32), pa.int32()))
            kinds = {"idx": pa.int64(), "key": pa.binary(), "parent": pa.binary(), "tree": pa.binary(), "loss_from": pa.int32(), "loss_to": pa.int32(), "position": pa.int64(), "n_tokens": pa.int64()}
            made = {c: pa.array(out[c], t) for c, t in kinds.items()}
            names = [c.split()[0] for c in _ROW.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("conv") if c == "conv" else flat if c == "tokens" else made[c] for c in names], names)

    kind = rows.schema["conv"].dataType.simpleString()
    return ordered.mapInArrow(run, _ROW.format(conv=kind))


def _running_start(segments: DataFrame, width: int) -> DataFrame:
    """Segments with ``start``: the tokens of all segments before, by rank and depth.

    Range partitions keep the order; each is summed up on its own, then the partitions' totals (a row each) before it.
    """
    ordered = segments.repartitionByRange(width, "rank", "depth").withColumn("part", F.spark_partition_id())
    laid = materialize(ordered, "chat-laid")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = laid.groupBy("part").agg(F.sum("size").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("rank", "depth").rowsBetween(Window.unboundedPreceding, -1)
    summed = laid.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return summed.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("within")).drop("part", "within", "base")


def _above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of paths, for the segments they are the first to reach: the intervals of the segments before, joined where they touch."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for b in batches:
        names, found = [], []
        for steps in b.column("steps").to_pylist():
            above: list[tuple[int, int]] = []
            for s in steps:
                if s["own"]:
                    names.append(s["segment"])
                    found.append([{"start": x, "stop": y} for x, y in above])
                if above and above[-1][1] == s["start"]:
                    above[-1] = (above[-1][0], s["stop"])
                else:
                    above.append((s["start"], s["stop"]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, kind)], ["segment", "above"])


def _segments(turns: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(segments, nodes) of turns (conv, idx, key, parent, tree, position, n_tokens) of differing conversations.

    segments: segment (its first node's key), start, at (position of its first token), above (intervals).
    nodes: key, segment, and spot, the turn that stands for the node.
    """
    once = turns.groupBy("key").agg(F.count("*").alias("n"), F.first("parent").alias("parent"))
    forks = once.where("parent is not null").groupBy("parent").agg(F.count("*").alias("c")).where("c > 1").select(F.col("parent").alias("fork"))
    heads = once.join(forks, F.col("parent") == F.col("fork"), "left").where("parent is null or fork is not null").select(F.col("key").alias("head"), (-F.col("n")).alias("weight"))
    flagged = turns.join(heads, F.col("key") == F.col("head"), "left")
    along = Window.partitionBy("conv").orderBy("idx")
    flagged = materialize(flagged.withColumn("segment", F.last("head", ignorenulls=True).over(along)), "chat-segments")
    nodes = materialize(flagged.groupBy("key").agg(F.first("segment").alias("segment"), F.min(F.struct("conv", "idx")).alias("spot"), F.first("tree").alias("tree"), F.first("position").alias("position"), F.first("n_tokens").alias("n_tokens")), "chat-node-keys")
    sizes = nodes.groupBy("segment").agg(F.min("position").alias("at"), (F.max(F.col("position") + F.col("n_tokens")) - F.min("position")).alias("size"))

    paths = flagged.where("head is not null").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("idx", "weight", "head"))).alias("steps"))
    paths = paths.select(F.transform("steps", lambda s: F.struct(s["weight"].alias("weight"), s["head"].alias("head"))).alias("path")).withColumn("last", F.element_at("path", -1)["head"])
    distinct = paths.dropDuplicates(["last"]).select("path")
    ranked = materialize(distinct.repartitionByRange(width, "path").sortWithinPartitions("path").withColumn("rank", F.monotonically_increasing_id()), "chat-paths")
    steps = ranked.select("rank", F.posexplode("path").alias("depth", "step")).select("rank", "depth", F.col("step.head").alias("segment"))
    first = steps.groupBy("segment").agg(F.min(F.struct("rank", "depth")).alias("first")).select("segment", "first.rank", "first.depth")
    laid = materialize(_running_start(sizes.join(first, "segment"), width), "chat-starts")
    spans = laid.select("segment", "start", (F.col("start") + F.col("size")).alias("stop"), F.col("rank").alias("owner"))
    along_path = steps.join(spans, "segment").groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("depth", "segment", "start", "stop", (F.col("owner") == F.col("rank")).alias("own")))).alias("steps"))
    above = along_path.select("steps").mapInArrow(_above, f"segment binary, above array<{_INTERVAL}>")
    return laid.select("segment", "start", "at").join(above, "segment"), nodes


def _with_own(above: Column, start: Column, stop: Column) -> Column:
    """Intervals and one more, as one where they touch."""
    one = lambda a, z: F.array(F.struct(a.cast("long").alias("start"), z.cast("long").alias("stop")))
    last = F.get(above, F.size(above) - 1)
    return F.when(last["stop"] == start, F.concat(F.slice(above, F.lit(1), F.size(above) - 1), one(last["start"], stop))).otherwise(F.concat(above, one(start, stop)))


def prefix_trees(conversations: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, turns), both written to the shared folder.

    nodes: key, tree (key of its first turn), start (first token in the stream of all trees), tokens, position (of the
    first token), loss_from, loss_to (tokens under the loss mask: an assistant's text), attends: array of (start, stop)
    intervals of the stream, first turn first, the node's own tokens last.
    turns: conv_id, idx (from 0), key of its node.

    Turns stand by number, then role, then text; null numbers come first. A null role or text counts as empty, a null
    conv_id is a conversation; turns that agree in all are turns each. An empty table gives empty results. Only the
    four columns are read.
    """
    spark = conversations.sparkSession
    width = shuffle_width(spark)
    rows = materialize(_encoded(conversations, vocabulary or default_vocabulary()), "chat-turns")
    # Copies of a conversation end in one node: the first of them stands for all.
    ends = rows.groupBy("conv").agg(F.max_by("key", "idx").alias("key"))
    reps = ends.groupBy("key").agg(F.min("conv").alias("conv")).select("conv")
    small = rows.select("conv", "idx", "key", "parent", "tree", "position", "n_tokens")
    segments, keys = _segments(small.join(reps, "conv", "left_semi"), width)
    spots = keys.select(F.col("spot.conv").alias("conv"), F.col("spot.idx").alias("idx"), "segment")
    whole = rows.join(spots, ["conv", "idx"]).join(segments.withColumnRenamed("start", "begin"), "segment")
    placed = whole.withColumn("start", F.col("begin") + F.col("position") - F.col("at"))
    attends = _with_own(F.col("above"), F.col("begin"), F.col("start") + F.col("n_tokens"))
    nodes = placed.select("key", "tree", "start", "tokens", "position", "loss_from", "loss_to", attends.alias("attends"))
    return materialize(nodes, "chat-nodes"), rows.select(F.col("conv.conv_id").alias("conv_id"), "idx", "key")


def read_back(nodes: DataFrame, turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, idx, formatted, loss) of every turn, from the written tokens alone; loss is unescaped."""
    path = vocabulary or default_vocabulary()
    parts = turns.join(nodes.select("key", "tokens", "loss_from", "loss_to"), "key").select(F.struct("conv_id").alias("conv"), "idx", "tokens", "loss_from", "loss_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for b in batches:
            column = b.column("tokens")
            flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            said, loss = [], []
            for a, z, x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), b.column("loss_from").to_pylist(), b.column("loss_to").to_pylist(), strict=True):
                said.append(own.decode(flat[a:z]))
                loss.append(unescape(own.decode(flat[a + x : a + y])) if y > x else "")
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("idx"), pa.array(said, pa.string()), pa.array(loss, pa.string())], ["conv", "idx", "formatted", "loss"])

    kind = parts.schema["conv"].dataType.simpleString()
    return parts.mapInArrow(run, f"conv {kind}, idx long, formatted string, loss string").select("conv.conv_id", "idx", "formatted", "loss")


def _digests(read: DataFrame) -> DataFrame:
    """What the query returns of each conversation: its turns stream by in order through running digests."""
    rows = read.select(F.struct("conv_id").alias("conv"), "idx", "formatted", "loss")
    ordered = rows.repartition(shuffle_width(read.sparkSession), "conv").sortWithinPartitions("conv", "idx")
    kind = rows.schema["conv"].dataType.simpleString()
    out = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [c.split()[0] for c in out.split(", ")]
    conv_type = to_arrow_type(rows.schema["conv"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        conv, n, said, chars, loss, total = None, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        for b in batches:
            done: list[tuple] = []
            for c, formatted, under in zip(b.column("conv").to_pylist(), b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
                if n and c != conv:
                    done.append((conv, n, said.hexdigest(), chars, loss.hexdigest(), total))
                    n, said, chars, loss, total = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                conv = c
                for role, text in parse(formatted):
                    said.update(f"{role}\n{text}\n".encode())
                    n += 1
                loss.update(under.encode())
                chars, total = chars + len(under), total + len(formatted)
            if done:
                yield emit(done)
        if n:
            yield emit([(conv, n, said.hexdigest(), chars, loss.hexdigest(), total)])

    return ordered.mapInArrow(run, out).select("conv.conv_id", *names[1:])


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -1, whose texts are control strings of another template."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def op8_chat_prefix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, turns = prefix_trees(with_probe(table(spark, sf_dir, "conversations")))
    return _digests(read_back(nodes, turns))


OP8_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, role || chr(10) || text || chr(10) AS plain,
    '<|turn|>' || replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2') || '<|text|>'
    || replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2') || '<|end|>' AS formatted,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(plain, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
