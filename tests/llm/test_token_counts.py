import random

import numpy as np
import pyarrow as pa
import pytest

from readalike.llm import token_counts as tc
from readalike.llm.queries import tokenizer_file
from readalike.llm.training_order import Encoder


@pytest.fixture(scope="module")
def code():
    return Encoder(tokenizer_file())


def random_texts(seed, n):
    rng = random.Random(seed)
    bits = [*"abcdeéß .,  \n日本▁<s>0/1'\"ABC#*$%", "the", "tion", " the", " " * 9, "\t", "😀", "<unk>", "<0x41>"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(n)]


HAND = ["", None, " ", "  ", "a", "\n", "\nabc", " \n  x", "▁▁a b", "a  b   c    d", "日本語 テスト 😀😀", "<s> </s>", "x" + " " * 400 + "y", "\x00a", "　x"]


@pytest.mark.parametrize("texts", [HAND, random_texts(1, 3000), ["ab" * 50_000, "word " * 200_000]])
def test_counts_and_ids_equal_the_library(code, texts):
    expected = [code.library.encode(t or "") for t in texts]
    assert tc.counts(pa.array(texts, pa.string()), code.machine).tolist() == [len(x) for x in expected]
    at = 0
    for part in tc.ta.slices(tc.plain(pa.array(texts, pa.string()))):
        ids, size = code.slice(part)
        for row in np.split(ids, np.cumsum(size)[:-1]):
            assert row.tolist() == [*expected[at], code.end]
            at += 1
    assert at == len(texts)


def test_counts_do_not_depend_on_what_was_forgotten(code, monkeypatch):
    texts = random_texts(2, 400)
    machine = tc.Transducer(tokenizer_file())
    monkeypatch.setattr(tc, "KEPT_CHUNKS", 20)
    monkeypatch.setattr(tc, "KEPT_MOVES", 50)
    monkeypatch.setattr(tc.ta, "SLICE_BYTES", 200)
    found = np.concatenate([tc.counts(pa.array([t]), machine) for t in texts])
    assert found.tolist() == [len(code.library.encode(t)) for t in texts]


def test_query(docs, texts, odd_docs, no_docs, code):
    found = {r["doc_id"]: r for r in tc.token_counts(docs, tokenizer_file()).collect()}
    for i, text in texts.items():
        n = len(code.library.encode(text))
        assert tuple(found[i])[1:] == (len(text.encode()), n, n > 4096)
    odd = tc.token_counts(odd_docs, tokenizer_file())
    assert odd.count() == odd_docs.count()
    assert {tuple(r)[1:] for r in odd.filter("doc_id IN (1, 2)").collect()} == {(0, 0, False)}
    assert tc.token_counts(no_docs, tokenizer_file()).count() == 0
