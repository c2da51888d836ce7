import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from readalike.llm import decontaminate as dc

ITEM = "item_id long, text string"


def tokens(text):
    return [t for t in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (text or "").lower()) if t]


def brute_tiles(a, b, least):
    """Greedy string tiling as first published: every longest free match in turn."""
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    least = min(least, len(b))
    while least:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            break
        for k in range(best[0]):
            free_a[best[1] + k] = free_b[best[2] + k] = False
        covered += best[0]
    return covered


def best(text, items):
    block = dc.block_of(list(range(len(items))), items)
    found = dc.best_items(pa.array([text], pa.string()), block)
    return found["item"][0], found["tiled"][0], found["tiles"][0]


def test_tiling_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        a = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        b = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        assert best(a, [b])[1] == brute_tiles(tokens(a), tokens(b), dc.SEED), (a, b)


def test_reordered_passage_is_covered_in_full():
    words = [f"word{k}" for k in range(40)]
    item = " ".join(words)
    text = "Before. " + " ".join(words[20:]).upper() + ", between; " + " ".join(words[:20]) + " after"
    assert best(text, ["other things entirely, of no use here", item]) == (1, 40, 2)


def test_short_and_empty_items():
    assert best("x y z", ["", "y z", "y q"])[:2] == (1, 2)
    assert best("", ["a b"]) == (None, 0, 0)
    assert best("nothing shared", ["a b c d e f"]) == (None, 0, 0)


@pytest.mark.parametrize("size", [dc.BLOCK_BYTES, 200])
def test_blocks_give_the_same_verdicts(spark, docs, monkeypatch, size):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = {r["doc_id"]: tuple(r) for r in dc.contamination(docs, benchmark).collect()}
    monkeypatch.setattr(dc, "BLOCK_BYTES", 3000 if size == 200 else size)
    assert {r["doc_id"]: tuple(r) for r in dc.contamination(docs, benchmark).collect()} == whole
    clean = {r["doc_id"] for r in dc.drop_contaminated(docs, benchmark).collect()}
    assert clean == {i for i, r in whole.items() if not r[-1]}


def test_planted_passages_are_found(spark, docs, texts):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [" ".join(tokens(r["text"])) for r in benchmark.collect()]
    holding = {i for i, t in texts.items() if any(item in " ".join(tokens(t)) for item in items)}
    assert holding and holding <= {r["doc_id"] for r in dc.contamination(docs, benchmark).filter("contaminated").collect()}


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "some words without an id"), (3, "same line same line")], ITEM)
    found = dc.contamination(odd_docs, items)
    assert found.count() == odd_docs.count()
    assert {(r["doc_id"], r["item_id"]) for r in found.filter("contaminated").collect()} == {(None, None), (8, 3)}
    kept = dc.drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
    assert dc.contamination(no_docs, items).count() == 0
    none = dc.contamination(odd_docs, items.limit(0))
    assert none.count() == odd_docs.count() and none.filter("contaminated").count() == 0
    assert dc.drop_contaminated(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_blocks_keep_rows_apart(spark, odd_docs, monkeypatch):
    extra = spark.createDataFrame([(None, "a whole other text of no id"), (5, "other words with the id five"), (5, "same line same line")],
                                  "doc_id long, text string")
    rows = odd_docs.select("doc_id", "text").unionByName(extra)
    items = spark.createDataFrame([(None, "some words without an id"), (3, "same line same line"), (4, "same line same line"),
                                   (6, "a whole other text of no id"), (7, "other words with the id five")], ITEM)

    def report():
        return sorted(map(str, dc.contamination(rows, items).collect()))

    whole = report()
    monkeypatch.setattr(dc, "BLOCK_BYTES", 20)
    assert len(list(dc.benchmark_blocks(items))) > 2
    assert report() == whole and len(whole) == rows.count()


@pytest.mark.parametrize("seed", range(40))
def test_tiles_by_length_are_the_tiles(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 2 + seed % 4, 60 + seed).astype(np.uint64) + np.uint64(1)
    item = rng.integers(0, 2 + seed % 4, 10 + seed).astype(np.uint64) + np.uint64(1)
    n = 2 + seed % 4
    assert dc.tile_by_length(text, item, n) == dc.tile(text, item, *dc.places(text, item, n), n)


def test_a_long_text_of_one_token(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, "word other " * 50_000), (3, "some other text here and now")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "word " * 1000), (8, "word other " * 400)], "item_id long, text string")
    started = time.perf_counter()
    found = {r.doc_id: r for r in dc.contamination(docs, items).collect()}
    assert (found[1].item_id, found[1].tiled_tokens, found[1].n_tiles) == (7, 1000, 1)
    assert (found[2].item_id, found[2].tiled_tokens, found[2].n_tiles) == (8, 800, 1)
    assert found[3].item_id is None and time.perf_counter() - started < 30
