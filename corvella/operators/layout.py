"""OCR words and positioned boxes put back into lines."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_db_text, safe_int, strip


def _ordered_text(items: Column, separator: str) -> Column:
    """Texts of structs, which are never null themselves, in the order of their fields."""
    return F.array_join(F.sort_array(items)["text"], separator)  # array_sort() would call a lambda for every comparison


def ocr_text(words: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, text, confidence) of OCR words (text, conf, block_num, par_num, line_num, left, word_no).

    Words of one block, paragraph and line stand by their left edge, ties as they came; blank words are no words.
    Confidence is the mean of what is a number from 0 up, as a fraction; null if nothing is. Numbers that don't parse
    count as 0 in the layout.
    """
    stripped = strip(F.col("text").cast("string"))
    line = ("block_num", "par_num", "line_num")
    conf = F.col("conf").try_cast("double")
    rows = words.where(stripped != "").select(*key, *(safe_int(F.col(c)).alias(c) for c in line), safe_int(F.col("left")).alias("left"), "word_no", stripped.alias("text"), F.when(conf >= 0, conf / 100).alias("conf"))
    rows = rows.repartition(*key)  # both groupings below share this shuffle
    lines = rows.groupBy(*key, *line).agg(_ordered_text(F.collect_list(F.struct("left", "word_no", "text")), " ").alias("text"), F.sum("conf").alias("total"), F.count("conf").alias("n"))
    whole = lines.groupBy(*key).agg(_ordered_text(F.collect_list(F.struct(*line, "text")), "\n").alias("text"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    return whole.select(*key, clean_db_text(F.col("text")).alias("text"), F.try_divide("total", "n").alias("confidence"))


def box_center(box: Column) -> Column:
    """Struct (y, x): the mean of a box's points; (0, 0) without points or with an incomplete one."""
    bad = F.coalesce((F.size(box) < 1) | F.exists(box, lambda p: F.coalesce(F.size(p) < 2, F.lit(True))), F.lit(True))
    mean = lambda i: F.aggregate(box, F.lit(0.0), lambda s, p: s + F.get(p, F.lit(i))) / F.size(box)
    return F.when(bad, F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("x"))).otherwise(F.struct(mean(1).alias("y"), mean(0).alias("x")))


def line_height(ys: Sequence[float]) -> float:
    """0.6 of the mean gap between different heights, 8 at least; 12 of a single height."""
    levels = sorted(set(ys))
    return max(8.0, 0.6 * (levels[-1] - levels[0]) / (len(levels) - 1) if len(levels) > 1 else 12.0)


def join_positioned(y: np.ndarray, x: np.ndarray, n: np.ndarray, text: Sequence[str]) -> str:
    """Boxes of one page (heights, left edges, numbers, texts) as lines.

    From the top down, a box opens a line if it stands further from the line's first box than the line height; what
    follows depends on where earlier lines began, so one pass goes through the page, a search a line.
    """
    order = np.lexsort((n, x, y))
    heights, lefts = y[order].tolist(), x[order]
    limit = line_height(heights) if heights else 0.0
    known = len(heights) - int(np.isnan(y).sum())  # what has no height comes last, each on a line of its own
    lines, at = [], 0
    while at < len(heights):
        top = heights[at]
        end = bisect_right(heights, limit, at, known, key=lambda v, top=top: v - top) if at < known else at + 1
        lines.append(" ".join(text[k] for k in order[at:end][np.argsort(lefts[at:end], kind="stable")].tolist()))
        at = end
    return "\n".join(lines)


#: Boxes whose lines leave a task together; one page may have more.
_BOXES = 1 << 18


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) of (key, items): numbers stay arrays, and of the texts one page's are Python's at a time."""
    for b in batches:
        items, ends = b.column("items"), np.cumsum(b.column("items").value_lengths().to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(ends // _BOXES)) + 1).tolist(), b.num_rows]
        for a, z in pairwise(cuts):
            texts = []
            for k in range(a, z):
                y, x, n, text = items[k].values.flatten()
                texts.append(join_positioned(y.to_numpy(), x.to_numpy(), n.to_numpy(), text.to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("key").slice(a, z - a), pa.array(texts, pa.string())], ["key", "text"])


def positioned_text(boxes: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, text) of boxes (y, x, text, box_no); a page's boxes meet in one row."""
    item = F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("box_no").cast("long").alias("n"), "text")
    pages = boxes.groupBy(F.struct(*key).alias("key")).agg(F.collect_list(item).alias("items"))
    kind = pages.schema["key"].dataType.simpleString()
    return pages.mapInArrow(_joined, f"key {kind}, text string").select("key.*", "text")
