"""Vector and trigram expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors up to this length are compared by plain arithmetic.
UNROLLED = 128
#: What stands between the words of trigrams.
WORD_GAP = "[^\\p{IsAlphabetic}\\p{IsDigit}]+"


def _literals(vectors: pa.Array) -> pa.Array:
    said = [None if v is None else ",".join("null" if x is None else f"{x:.8f}" for x in v) for v in vectors.to_pylist()]
    return pa.array([None if s is None else f"[{s}]" for s in said], pa.string())


def vector_literal(c: Column) -> Column:
    """``[0.10000000,0.20000000]``

    Numbers are rounded by their exact value, ties to even, as C and Python do; Java rounds the shortest decimal, ties up.
    """
    return F.arrow_udf(_literals, "string")(c.cast("array<double>"))


def rounded(values: Sequence[float]) -> Column:
    """A query vector as a literal, at the 8 decimals queries are sent with."""
    return F.array(*(F.lit(round(float(v), 8)) for v in values))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where a norm is zero, an element is missing or the lengths differ."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_to(a: Column, query: Sequence[float]) -> Column:
    """Cosine similarity to one query vector.

    Up to UNROLLED numbers the sums are written out, so they compile with the scan; longer ones, whose code would grow
    beyond what the JVM compiles, fold over the array.
    """
    values = [round(float(v), 8) for v in query]
    norm = sum(v * v for v in values) ** 0.5
    if len(values) > UNROLLED:
        top, own = dot(a, F.lit(values).cast("array<double>")), dot(a, a)
    else:
        items = [F.get(a, F.lit(i)).cast("double") for i in range(len(values))]
        top = sum((x * v for x, v in zip(items[1:], values[1:], strict=True)), items[0] * values[0])
        own = sum((x * x for x in items[1:]), items[0] * items[0])
    return F.when(F.size(a) == len(values), F.try_divide(top, F.sqrt(own) * F.lit(norm)))


def trigrams(c: Column) -> Column:
    """The set of trigrams of the lower-case alphanumeric words, each padded by two spaces left and one right."""
    # A word is cut once, however often it stands in a text.
    runs = F.filter(F.array_distinct(F.split(F.lower(c), WORD_GAP)), lambda w: w != "")
    padded = F.transform(runs, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    parts = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(parts))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the trigram sets; 0 where neither text has any."""
    x, y = trigrams(a), trigrams(b)
    shared = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(x) + F.size(y) - shared).cast("double")), F.lit(0.0))
