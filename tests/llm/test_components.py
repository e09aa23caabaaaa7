import random

import pytest
from pyspark.sql import functions as F

from corvella.llm import components
from corvella.llm.components import connected_components


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 540)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_row_that_stays_does_not_depend_on_the_order_of_rows(spark):
    """Rows of one id and text that differ in other columns; copies of it, a null id."""
    rows = [(1, "same text", lang, src) for lang in ("de", "en", None) for src in ("b", "a")] + [(2, "same text", "en", "z"), (None, "other", "x", None), (None, "other", None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = [sorted(map(repr, components.one_of_each(x, _alone(x)).collect())) for x in (df.repartition(1), df.repartition(5, "source"), df.orderBy(F.desc("lang")), df.orderBy("source"))]
    assert len(kept[0]) == 3 and kept.count(kept[0]) == len(kept)


def _alone(df):
    """Components of equal ids."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    return df.select("doc_id", text.alias("text_hash"), F.xxhash64("doc_id", "text").alias("root"), F.col("doc_id").alias("component_id"))
