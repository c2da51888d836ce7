import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from readalike.operators import baselines
from readalike.operators.features import item_index
from tests.conftest import rows


def tagged(seed, n=60):
    """Books with tags of which one is on most of them."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        tags = {t for t, p in (("fiction", 0.8), ("drama", 0.5), ("war", 0.3)) if rng.random() < p}
        tags |= {f"r{rng.randint(0, 15)}" for _ in range(rng.randint(0, 2))}
        out.append((f"b{i:02d}", ", ".join(sorted(tags))))
    return out


def brute_jaccard(data, k):
    sets = {i: {t.strip() for t in s.split(",") if t.strip()} for i, s in data}
    out = []
    for seed, a in sets.items():
        scored = [(-round(len(a & b) / len(a | b), 9), i) for i, b in sets.items()
                  if i != seed and a & b]
        out += [(seed, r, i, round(-s, 6)) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("probes", [0, 2, 20])
def test_jaccard_is_exact_for_any_number_of_probes(spark, store, probes):
    for seed, k in ((1, 3), (2, 8)):
        data = tagged(seed)
        enriched = spark.createDataFrame(data, "isbn string, subjects string")
        seeds = enriched.select(F.col("isbn").alias("seed_isbn"))
        got = rows(baselines.subject_jaccard(
            seeds, enriched, k, index=item_index(store, enriched), probes=probes))
        expected = brute_jaccard(data, k)
        assert [r[:3] for r in got] == [r[:3] for r in expected]
        assert [r[3] for r in got] == pytest.approx([r[3] for r in expected], abs=1.1e-6)


@pytest.mark.parametrize("k,pool", [(5, 200), (5, 2)])
def test_author_or_subject_equals_brute_force(spark, k, pool):
    rng = random.Random(7)
    data = tagged(3, 40)
    facts = {i: (rng.choice(["ann", "bob", None]), round(rng.uniform(1, 9), 2)) for i, _ in data}
    sets = {i: {t.strip() for t in s.split(",") if t.strip()} for i, s in data}
    stats = spark.createDataFrame([(i, a, b) for i, (a, b) in facts.items()],
                                  "isbn string, author string, bayesian_rating double")
    enriched = spark.createDataFrame(data, "isbn string, subjects string")
    seeds = enriched.select(F.col("isbn").alias("seed_isbn"))
    got = defaultdict(list)
    for r in baselines.author_or_subject(seeds, stats, enriched, k, pool).collect():
        got[r.seed_isbn].append((r["rank"], r.isbn))
    for seed in sets:
        def best(isbns, n):
            return sorted(isbns, key=lambda i: (-facts[i][1], i))[:n]

        others = [i for i in sets if i != seed]
        author = [i for i in others if facts[seed][0] and facts[i][0] == facts[seed][0]]
        subject = best([i for i in others if sets[seed] & sets[i]], pool)
        assert [i for _, i in sorted(got[seed])] == best(set(author) | set(subject), k)


def test_list_overlap(spark):
    left = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a")], "seed_isbn string, isbn string")
    right = spark.createDataFrame([("s", "b"), ("s", "c"), ("u", "a")], "seed_isbn string, isbn string")
    assert rows(baselines.list_overlap(left, right)) == [
        ("s", 1, 1, 1), ("t", 0, 1, 0), ("u", 0, 0, 1)]


@pytest.mark.parametrize("limits", [{"few": 500}, {"few": 0}, {"few": 0, "limit": 2}])
def test_a_partial_index_changes_no_list(spark, store, limits):
    ratings = spark.createDataFrame(
        [(1, "a", 5), (1, "b", 6), (1, "x", 7), (2, "a", 3), (2, "x", 9), (3, "x", 2)],
        "user_id int, isbn string, rating int")
    seeds = spark.createDataFrame([("a",), ("x",)], "seed_isbn string")
    partial = item_index(store, ratings.filter("isbn <> 'x'").select("isbn"))
    got = baselines.co_rated_top(seeds, ratings, index=partial, **limits).select(
        "seed_isbn", "rank", "isbn", "co_raters")
    assert rows(got) == [("a", 1, "x", 2), ("a", 2, "b", 1), ("x", 1, "a", 2), ("x", 2, "b", 1)]
