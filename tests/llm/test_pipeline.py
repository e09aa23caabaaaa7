import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from corvella.llm import mixing, nearcopies, pii, quality

from .conftest import SF, odd_rows


@pytest.fixture(scope="module")
def stages(spark, sf_docs, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), sf_docs, {}
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = out[name] = spark.read.parquet(f"{root}/{name}")
    return out


def _ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_quality_rejects_go(spark, sf_docs, stages):
    model = quality.train(sf_docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert _ids(stages["quality_rules"]) == _ids(quality.judge(sf_docs, model).where("kept"))
    assert stages["quality_rules"].count() < sf_docs.count()


def test_one_of_each_group_stays(stages):
    """Against all pairs of texts: five-word shingles, Jaccard similarity 0.8 or more."""
    before, after = stages["quality_rules"], stages["near_duplicates"]
    sets = {r.doc_id: nearcopies.shingles(r.text) for r in before.collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and nearcopies.similar(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert _ids(after) == sorted(i for i in root if root[i] == i)
    assert after.count() < before.count()


def test_private_spans_are_marked(stages):
    before = {r.doc_id: r.text for r in stages["near_duplicates"].collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in stages["personal_data"].collect()}
    assert set(after) == set(before)
    changed = 0
    for i, text in before.items():
        assert len(after[i][0]) == after[i][1]
        if pii.base_spans(text):
            assert after[i][0] != text
        changed += after[i][0] != text
    assert changed and not any("@" in t and pii.base_spans(t) for t, _ in after.values() if "example" in t)


def test_mix_returns_what_is_taken(stages):
    before, after = stages["personal_data"], stages["mix_sources"]
    taken = {r.doc_id: r.taken for r in mixing.mix(before)[0].collect()}
    words = {}
    for r in after.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == {i: n for i, n in taken.items() if n}


def test_tokens_decode_to_the_text(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = sorted((r.doc_id, r.text) for r in stages["mix_sources"].collect())
    rows = stages["tokens"].collect()
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in rows)
    assert sorted((r.doc_id, library.decode(r.ids, skip_special_tokens=False)) for r in rows) == texts


def test_all_but_the_last_return_the_columns_of_documents(sf_docs, stages):
    assert all(stages[name].columns == sf_docs.columns for name, _ in P.STAGES[:-1])


def test_run_gives_the_same_rows(spark, stages):
    assert P.run(spark, SF).count() == stages["tokens"].count()


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES])
def test_odd_and_empty_tables(spark, odd_docs, no_docs, name):
    stage = dict(P.STAGES)[name]
    assert stage(spark, no_docs, SF).count() == 0
    assert stage(spark, odd_docs, SF).count() <= 3 * len(odd_rows())
