"""Queries over documents with odd texts against their SQL."""

import duckdb
import pytest
from pyspark.sql import types as T

from corvella.plans import registry

TEXTS = [
    "two words", "", "   ", "\n\n", "a\n\n b ", "one\rtwo\x0bthree\x0cfour", "a\x1cb\x1db\x1e\x1f", "tab\there\r\n", "\x01 \x02x", "smile \U0001f600 \U0001f600\U0001f600", "\ufffe \uffff",
    "\ufffd ok", "\x85a\xa0b\u2028c\u3000", "<w:t> & ]]>", " Document ", "\xe9 \u200b", None,
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables whose documents have odd texts."""
    root = str(tmp_path_factory.mktemp("odd"))
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(TEXTS)]
    kind = T.StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{root}/documents.parquet")
    return root


def _both(spark, root, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet/*.parquet'")
    said = con.execute(registry.oracles()[name])
    names = [d[0] for d in said.description]
    return sorted(map(tuple, registry.queries()[name](spark, root).select(*names).collect()), key=repr), sorted(said.fetchall(), key=repr)


def test_office_documents_of_odd_texts(spark, odd):
    """Blank texts, texts with characters that XML can't hold, and no text."""
    got, want = _both(spark, odd, "office_documents")
    assert len(want) == len(TEXTS) and got == want
