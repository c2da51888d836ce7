import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readalike.llm import toxicity


def test_scores_separate_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.scores(docs, toxicity.trained(docs, labels)).withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    rows = found.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    mine = [(r["score"], r["toxic"]) for r in rows if r["held_out"]]
    good, bad = ([s for s, t in mine if t == k] for k in (0, 1))
    assert np.mean([b > g for b in bad for g in good]) > 0.85
    assert np.mean([s >= toxicity.THRESHOLD for s in good]) < 0.02


def test_learner_is_the_published_update():
    model, z, n = toxicity.Ftrl(), {}, {}
    rng = np.random.default_rng(1)
    for _ in range(200):
        row = np.unique(rng.integers(0, 12, 4))
        label = float(3 in row)
        model.learn(row, label)
        keys = [*row.tolist(), toxicity.BIAS]
        w = {}
        for k in keys:
            zk, nk = z.get(k, 0.0), n.get(k, 0.0)
            w[k] = 0.0 if abs(zk) <= toxicity.L1 else -(zk - np.sign(zk) * toxicity.L1) / (
                (toxicity.BETA + nk**0.5) / toxicity.ALPHA + toxicity.L2)
        g = (1 / (1 + np.exp(-sum(w.values()))) - label) * (toxicity.TOXIC_WEIGHT if label else 1.0)
        for k in keys:
            z[k] = z.get(k, 0.0) + g - ((n.get(k, 0.0) + g * g)**0.5 - n.get(k, 0.0)**0.5) / toxicity.ALPHA * w[k]
            n[k] = n.get(k, 0.0) + g * g
    assert model.z[3] == pytest.approx(z[3]) and model.weights(np.array([3]))[0] > 0
    assert (model.weights(slice(None)) != 0).sum() < 14


def test_features_are_words_pairs_and_skips():
    (_, n, owner, bucket), = toxicity.features(pa.array(["A b, c!", "a b c", "", None, "c b a"]))
    rows = [set(bucket[owner == k].tolist()) for k in range(n)]
    assert rows[0] == rows[1] and len(rows[0]) == 6 and rows[2] == rows[3] == set()
    assert len(rows[4] & rows[0]) == 3


def test_odd_rows(odd_docs, no_docs, labels):
    weights = toxicity.trained(odd_docs, labels)
    found = toxicity.scores(odd_docs, weights).collect()
    assert len(found) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in found)
    none = toxicity.trained(odd_docs, labels.limit(0))
    assert {r["score"] for r in toxicity.scores(odd_docs, none).collect()} == {0.5}
    assert not toxicity.trained(no_docs, labels).any()
    assert toxicity.scores(no_docs, weights).count() == 0


def test_training_takes_what_fits(spark, store, docs, labels):
    assert toxicity.fitting({1: 5, 2: 9, 3: 4, 4: 1}, [2, 7, 1, 3, 4], 14) == [2, 1]
    assert toxicity.fitting({1: 5, 2: 90, 3: 4}, [2, 1, 3], 10) == [1, 3]
    whole = toxicity.trained(docs, labels, store=store)
    assert (toxicity.trained(docs, labels, limit=10**9, store=store) == whole).all() and whole.any()
    assert not toxicity.trained(docs, labels, limit=0, store=store).any()


def test_query_equals_a_plain_version(spark):
    """The whole query by dictionaries: features, order of learning, bounds, scores."""
    from readalike.llm.queries import op6_toxicity, table
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    marks = table(spark, folder, "labels").filter("toxic IS NOT NULL")
    order = [r.doc_id for r in marks.select("doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").collect()]
    toxic = {r.doc_id: r.toxic for r in marks.collect()}
    rows = {}
    for i, text in docs.items():
        (_, _, _, bucket), = toxicity.features(pa.array([text or ""]))
        rows[i] = np.unique(bucket)
    model = toxicity.Ftrl()
    for _ in range(toxicity.EPOCHS):
        for i in order:
            if i in docs and zlib.crc32(str(i).encode()) % 3 != 1:
                model.learn(rows[i], float(toxic[i]))
    w = model.weights(slice(None))
    for r in op6_toxicity(spark, folder).collect():
        score = 1 / (1 + np.exp(-(w[toxicity.BIAS] + w[rows[r.doc_id]].sum())))
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == int(r.score >= toxicity.THRESHOLD)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
