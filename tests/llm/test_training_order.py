import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readalike.llm import training_order as to
from readalike.llm.queries import tokenizer_file


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65_537])
def test_permutation(n):
    found = to.permuted(np.arange(n), n)
    assert sorted(found.tolist()) == list(range(n))
    assert to.permuted(np.arange(n), n).tolist() == found.tolist()
    if n > 500:
        assert to.permuted(np.arange(n), n, to.KEY + 1).tolist() != found.tolist()
        assert abs(np.corrcoef(np.arange(n), found)[0, 1]) < 0.2


def expected(rows):
    code = to.Encoder(tokenizer_file())
    out = Counter()
    for i, text in rows:
        ids = np.array([*code.library.encode(text or ""), code.end], np.uint16)
        for k in range(0, len(ids), to.LENGTH):
            part = ids[k:k + to.LENGTH]
            out[i, k // to.LENGTH, len(part), zlib.crc32(part.tobytes())] += 1
    return out


def written(df):
    rows = df.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    return Counter((r["doc_id"], r["seq"], r["n_tokens"], r["crc"]) for r in rows)


def test_round_trip_in_many_shards(docs, texts, store, monkeypatch):
    monkeypatch.setattr(to, "RECORDS", 100)
    manifest = to.write_shards(docs, store, tokenizer_file())
    assert manifest.count() > 3
    every = to.read_shards(manifest)
    assert written(every) == expected(texts.items())
    reading = every.select("shard", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r["task"] for r in reading}) == len(reading) == manifest.count()
    rest = {tuple(r) for r in to.read_shards(manifest, first_slot=157).collect()}
    assert rest == {tuple(r) for r in every.filter("slot >= 157").collect()}
    again = to.read_shards(to.write_shards(docs, store, tokenizer_file()))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in every.collect()}


def test_rows_of_several_files_and_no_files(spark, docs, texts, store):
    parts = store.write(docs.repartition(5))
    assert written(to.read_shards(to.write_shards(parts, store, tokenizer_file()))) == expected(texts.items())
    shuffled = docs.repartition(3).withColumn("_metadata", docs["doc_id"])
    assert written(to.read_shards(to.write_shards(shuffled, store, tokenizer_file()))) == expected(texts.items())


def test_odd_rows(odd_docs, no_docs, store):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert written(to.read_shards(to.write_shards(odd_docs, store, tokenizer_file()))) == expected(rows)
    assert to.read_shards(to.write_shards(no_docs, store, tokenizer_file())).count() == 0


class Stub:
    def encode(self, texts, num_threads):
        return [[7, 8, 9]] * len(texts)


def test_memory_of_a_worker(monkeypatch):
    code = to.Encoder(tokenizer_file())
    code.library = Stub()
    kept = 0
    rng = np.random.default_rng(7)
    for _ in range(30):
        texts = pa.array([" ".join(map(str, rng.integers(0, 1 << 40, 75_000)))])
        for _, _, tokens, size in to.encoded(texts, code):
            assert len(tokens) == size.sum() > 75_000
        arrays = [*code.known, *code.fresh, code.pool]
        kept = max(kept, sum(x.nbytes for x in arrays))
    assert kept < 64 << 20
    # a batch's texts aren't copied whole
    texts = pa.array(["word " * 600] * 10_000)
    before = pa.total_allocated_bytes()
    assert max(pa.total_allocated_bytes() - before for _ in to.encoded(texts, code)) < 15 << 20


def test_chunks_learnt_in_steps_and_forgotten(texts, monkeypatch):
    monkeypatch.setattr(to, "PIECE", 3)
    whole = to.Encoder(tokenizer_file())
    plain = pa.array(list(texts.values()))
    expected = [*to.encoded(plain, whole)]
    for kept, fresh in ((1 << 30, 10), (500, 100)):
        monkeypatch.setattr(to, "KEPT", kept)
        monkeypatch.setattr(to, "FRESH", fresh)
        code = to.Encoder(tokenizer_file())
        for _ in range(2):
            found = [*to.encoded(plain, code)]
            assert [x[0] for x in found] == [x[0] for x in expected]
            for x, y in zip(found, expected, strict=True):
                assert x[2].tolist() == y[2].tolist() and x[3].tolist() == y[3].tolist()
