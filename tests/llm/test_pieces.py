import hashlib
import resource

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corvella.llm import pieces

from .conftest import odd_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _expected(library, text):
    ids = library.encode(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


ODD = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from([" ", "  ", "▁", "\n", "the", " in", "er", "aa", "==", "----", "梦", "中国", "<0x0A>", "<s>", "</s>", "<unk>", "�", "\x00"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=40).map("".join))
def test_any_text_is_coded_as_the_library_does(library, text):
    own = pieces.coder(PATH)
    ids = own.encode([text])[0]
    assert ids.tolist() == library.encode(text)
    assert own.decode(ids) == library.decode(ids.tolist())
    assert own.digests([text])[0] == _expected(library, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 258), st.integers(0, 31_999)), max_size=10))
def test_any_ids_decode_as_the_library_does(library, ids):
    assert pieces.coder(PATH).decode(np.array(ids, np.int64)) == library.decode(ids)


LETTERS = np.random.default_rng(5)


@pytest.mark.parametrize(
    "text",
    ["a" * 50_000, "=-" * 20_000, " " * 70_000, "ab▁ c " * 3_000, "".join(LETTERS.choice(list("etaoinshr"), 30_000)), "".join(map(chr, LETTERS.integers(0x4E00, 0x9FA5, 40_000))), "\n" * 999, ""],
)
def test_long_runs(library, text, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 5_000)
    own = pieces.PieceCoder(PATH)
    assert own.encode([text, "x", text])[2].tolist() == library.encode(text)
    assert own.digests([text])[0] == _expected(library, text)


def test_the_table_is_bounded_and_may_be_dropped_at_any_time(library):
    own = pieces.PieceCoder(PATH, table_bytes=2_000)
    texts = [f"word{i} and more of it {i * 7}" for i in range(300)]
    assert [x.tolist() for t in texts for x in own.encode([t])] == [library.encode(t) for t in texts]
    assert len(own.index) < 50


def test_many_characters_without_a_space_take_bounded_memory():
    own = pieces.PieceCoder(PATH)
    text = "".join(map(chr, np.random.default_rng(6).integers(0x4E00, 0x9FA5, 3_000_000)))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    own.digests([text])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB


def test_odd_rows(library, odd_docs, no_docs):
    found = sorted(map(tuple, pieces.encode_digests(odd_docs).collect()), key=repr)
    assert found == sorted(((i, *_expected(library, t or "")) for i, t, _ in odd_rows()), key=repr)
    whole = pieces.encode_documents(odd_docs, keep=("doc_id", "source"))
    assert sorted(((r.doc_id, r.source, list(r.ids), r.decoded) for r in whole.collect()), key=repr) == sorted(((i, s, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, s in odd_rows()), key=repr)
    assert pieces.encode_digests(no_docs).count() == 0
    assert pieces.encode_documents(no_docs).columns == ["doc_id", "ids", "decoded"]


def test_other_kinds_of_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="only BPE models"):
        pieces.PieceCoder(str(tmp_path / "m.model"))
