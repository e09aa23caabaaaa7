import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvella.llm import bpe

from .conftest import SF, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def _expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\x1c\x85 'aAeé0123<|endoftext|>")), max_size=60))
def test_any_text_encodes_as_the_library_does(library, text):
    ids = bpe.coder(PATH).encode([text])[0]
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert bpe.coder(PATH).decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("text", ["aaaaaaaaaaa", "ab" * 5000, "<|endoftext|><|endoftext|> x", "don't we'll I'M", " " * 3000, "\x1c \x1f", "", "​́"])
def test_corner_texts(library, text):
    assert bpe.coder(PATH).encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_cache_overflow_changes_nothing(library):
    small = bpe.BytePairCoder(PATH, cache_bytes=3)
    for text in ["some words here", "other words there", "some words here", "yet more distinct words again"]:
        assert small.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_whole_table(spark, library, sf_docs):
    want = {r.doc_id: _expected(library, r.text or "") for r in sf_docs.collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op4_bpe_codes(spark, SF).collect()}
    assert got == want


def test_odd_rows(library, odd_docs, no_docs):
    want = sorted((repr(i), *_expected(library, t or "")) for i, t, _ in odd_rows())
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(odd_docs).collect())
    assert got == want
    assert bpe.encode_digests(no_docs).count() == 0
    kept = bpe.encode_documents(odd_docs, keep=("doc_id", "source"))
    assert kept.columns == ["doc_id", "source", "ids", "decoded"] and kept.where("decoded is null").count() == 0


def test_long_texts_go_in_pieces(library, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["word", "don't", "<|endoftext|>", "  ", "\n", "é\u3000", "12", "文字", "a"]
    text = " ".join(words[i] for i in rng.integers(0, len(words), 3000))
    want = library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "_CHUNK", 40)
    assert len(list(bpe.coder(PATH)._pieces(text))) > 50
    assert bpe.coder(PATH).encode([text, "", text])[2].tolist() == want
