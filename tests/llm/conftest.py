import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Names the operators use inside; the tables of these tests carry them too.
CLASHING = "key a b s n fp text_hash _hash _nth size first row_no shard slot _bucket root digest label k1 k2 pattern seen base extra _id source_ _taken _extra _key ids decoded tree start position conv turns host wrapper".split()


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text, source) rows with further columns of clashing names."""

    def make(rows, parts=3):
        full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
        return df.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)))

    return make


def odd_rows():
    """Nulls, empties, blanks, ties, repeated rows, one very long text."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "é", "文字", "x1", "mail@host.example.org", "10.0.0.1", "\U0001f600"]
    long_text = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(30_000))
    same = "The same words stand here again and again. " * 30
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, same, "b"), (5, same, "b"), (5, same, "b"), (6, same + "more", None),
        (7, long_text, "b"), (8, "one", "c"), (9, "one", "c"), (None, "nobody's text with a few words", "a"), (None, None, None), (10, "x\x00y\r\nz\x1f \x85 end", "a"),
    ]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(odd_rows())


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
