import hashlib
import math
import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from readalike.operators import vectors
from readalike.sources.store import Store

VECTORS = "isbn string, embedding array<float>"


def items(n, dim, seed=0):
    """Random vectors, a third of them copies of one vector."""
    rng = random.Random(seed)
    copy = [rng.random() for _ in range(dim)]
    return [(f"i{i:03d}", copy if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(dim)])
            for i in range(n)]


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("z", [0.0, 0.0])], VECTORS)
    got = {r.isbn: r.embedding for r in vectors.l2_normalize(df).collect()}
    assert got == {"a": [0.6, 0.8], "z": [0.0, 0.0]}


def test_dimension_check(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], VECTORS)
    with pytest.raises(ValueError, match="1 of 2"):
        vectors.check_dim(df, 2)
    assert vectors.check_dim(df.filter("isbn = 'a'"), 2).count() == 1


@pytest.mark.parametrize("block_bytes", [1, 2000, 1 << 20])
def test_knn_is_exact_for_any_block_size(spark, block_bytes):
    data = items(90, 5)
    df = spark.createDataFrame(data, VECTORS)
    seeds = spark.createDataFrame([(i,) for i, _ in data[:50]] + [("absent",)], "seed_isbn string")
    got = {}
    for r in vectors.knn(df, seeds, 6, block_bytes).collect():
        got.setdefault(r.seed_isbn, []).append((r["rank"], r.isbn, r.score))
    assert set(got) == {i for i, _ in data[:50]}
    arrays = {i: np.array(v, dtype=np.float32).astype(float) for i, v in data}
    for seed, found in got.items():
        expected = sorted((-round(float(arrays[seed] @ v), 9), i) for i, v in arrays.items())[:6]
        assert [(i, s) for _, i, s in sorted(found)] == [
            (i, pytest.approx(-s, abs=2e-9)) for s, i in expected]


def test_blocks_that_cannot_reach_a_list_are_skipped(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16)) * 4
    data = [(f"i{i:04d}", (centres[i % 12] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(data, VECTORS)
    seeds = df.select(F.col("isbn").alias("seed_isbn"))
    whole = sorted(map(tuple, vectors.knn(df, seeds, 5).collect()))
    reports = []
    blocked = sorted(map(tuple, vectors.knn(df, seeds, 5, 64 * 50, reports=reports).collect()))
    assert [r[:2] + r[3:] for r in blocked] == [r[:2] + r[3:] for r in whole]
    assert [r[2] for r in blocked] == pytest.approx([r[2] for r in whole], abs=2e-9)
    assert 0 < reports[0].compared < reports[0].possible / 2


def test_default_encoder_is_hashed_tf_idf(spark):
    data = [("a", "Red ring red"), ("b", "blue ring"), ("c", None)]
    df = spark.createDataFrame(data, "isbn string, text string")
    got = {r.isbn: np.array(r.embedding) for r in vectors.encode(df, dim=32).collect()}

    def bucket(word):
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 32

    docs = {i: (t or "").lower().split() for i, t in data}
    seen = {}
    for words in docs.values():
        for b in {bucket(w) for w in words}:
            seen[b] = seen.get(b, 0) + 1
    for isbn, words in docs.items():
        v = np.zeros(32)
        for w in words:
            v[bucket(w)] += math.log(4 / (seen[bucket(w)] + 1))
        norm = np.linalg.norm(v) or 1.0
        assert got[isbn] == pytest.approx(v / norm, abs=1e-6)


def test_supplied_encoder(spark):
    df = spark.createDataFrame([("a", "xx"), ("b", "xyy")], "isbn string, text string")

    def count_letters(texts):
        return np.array([[t.count("x"), t.count("y")] for t in texts], dtype=float)

    got = {r.isbn: r.embedding for r in vectors.encode(df, encoder=count_letters).collect()}
    assert got["a"] == [1.0, 0.0]
    assert got["b"] == pytest.approx([1 / math.sqrt(5), 2 / math.sqrt(5)])


def test_an_encoder_is_made_once_per_worker(spark, tmp_path):
    made = str(tmp_path / "made")

    def make():
        with open(made, "a") as out:
            print(os.getpid(), file=out)
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.range(2000).selectExpr("cast(id as string) AS isbn", "repeat('x', 1 + int(id % 7)) AS text").repartition(6)
    got = vectors.encode(df, make_encoder=make, dim=2, batch_size=16).collect()
    assert len(got) == 2000 and got[0].embedding == pytest.approx(
        np.array([1 + int(got[0].isbn) % 7, 1.0]) / math.hypot(1 + int(got[0].isbn) % 7, 1.0))
    with open(made) as lines:
        pids = lines.read().split()
    assert len(pids) == len(set(pids)) <= 8


def test_dot_products_keep_partition_independence(spark):
    df = spark.createDataFrame(items(40, 4, 3), VECTORS)
    seeds = df.select(F.col("isbn").alias("seed_isbn"))
    one = sorted(map(tuple, vectors.knn(df.coalesce(1), seeds, 4).collect()))
    many = sorted(map(tuple, vectors.knn(df.repartition(9), seeds, 4, 11).collect()))
    assert one == many


def test_knn_refuses_ragged_vectors_and_leaves_out_nulls(spark):
    seeds = spark.createDataFrame([("a",), ("b",)], "seed_isbn string")
    ragged = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", [1.0, 2.0, 3.0])], VECTORS)
    with pytest.raises(ValueError, match="of 3 vectors"):
        vectors.knn(ragged, seeds, 2)
    with pytest.raises(ValueError, match="1 of 2"):
        vectors.knn(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, None])], VECTORS), seeds, 2)
    some = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.5, 1.0])], VECTORS)
    assert [(r.seed_isbn, r.isbn) for r in vectors.knn(some, seeds, 2).orderBy("rank").collect()] == [
        ("a", "a"), ("a", "c")]
    assert vectors.knn(some.limit(0), seeds, 2).count() == 0


def test_encoder_of_another_width_is_refused(spark):
    df = spark.createDataFrame([("a", "x")], "isbn string, text string")
    with pytest.raises(Exception, match="of 4 values"):
        vectors.encode(df, encoder=lambda texts: np.ones((len(texts), 3)), dim=4).collect()


def test_long_texts_are_encoded_in_time_and_exploded(spark):
    """The dense vector and its norm are made once a row, also below an explode, whose filter is pushed down to them."""
    texts = [(f"b{i}", " ".join(f"w{i * j % 997}" for j in range(1, 400))) for i in range(40)]
    df = spark.createDataFrame([*texts, ("none", None)], "isbn string, text string")
    stop = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        rows = vectors.encode(df).select("isbn", F.posexplode("embedding")).filter("col <> 0").groupBy("isbn").agg(
            F.sum(F.col("col").cast("double") * F.col("col")).alias("squares")).collect()
    finally:
        stop.cancel()
    # all words of w0 are one, which every document may have
    assert {r.isbn for r in rows} >= {f"b{i}" for i in range(1, 40)} and "none" not in {r.isbn for r in rows}
    assert all(abs(r.squares - 1) < 1e-5 for r in rows)


def test_small_blocks_do_not_multiply_the_vectors(spark, tmp_path):
    """Seeds are stored and sent once for each bundle of clusters, not for each block."""
    data = items(1200, 8, seed=5)
    df = spark.createDataFrame(data, VECTORS)
    seeds = df.select(F.col("isbn").alias("seed_isbn"))
    whole = sorted(map(tuple, vectors.knn(df, seeds, 5).collect()))
    for task_bytes in (32 * 40, 32 * 300, 1 << 20):
        root = str(tmp_path / str(task_bytes))
        got = sorted(map(tuple, vectors.knn(df, seeds, 5, 32 * 4, 16, Store(spark, root), task_bytes=task_bytes).collect()))
        assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in whole]
        stored = sum(spark.read.parquet(f"{root}/{name}").count() for name in os.listdir(root))
        assert stored <= 10 * len(data)
