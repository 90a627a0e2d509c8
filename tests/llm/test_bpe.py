import hashlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from affinity.llm import bpe

PATH = bpe.tokenizer_path()
CASES = ["", " ", "a", "the  quick\n\n brown\tfox's", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "Éléphant ñandú 北京 🙂🙂", "x" * 5000, "١٢٣ 123 ½", "   z", "don't DON'T 're", "<|endof" + "text|>x", "\x00\x01"]


@lru_cache
def _library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("text", CASES)
def test_same_as_library(library, text):
    own = bpe.load(PATH)
    ids = own.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_same_as_library_on_any_text(text):
    library = _library()
    own = bpe.load(PATH)
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == want
    assert own.decode(own.encode(text)) == text


def test_frame(spark):
    rows = [(i, t, 1) for i, t in enumerate([*CASES, None, CASES[3]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = bpe.encode(docs, PATH)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert got[i].n_tokens == len(got[i].token_ids) // 4
    back = {r.doc_id: r.text for r in bpe.decode(out, PATH).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert bpe.encode(docs.limit(0), PATH).count() == 0
