import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from readalike import params
from readalike.functions import scores
from readalike.operators import strategies
from readalike.plans.workspace import Workspace
from tests.conftest import rows

SIM = "isbn string, other_isbn string, similarity double"
STATS = "isbn string, title string, author string, rating_count long, bayesian_rating double"


def seeds_of(spark, *isbns):
    return spark.createDataFrame([(i,) for i in isbns], "seed_isbn string")


@pytest.fixture(scope="module")
def art(spark):
    rng = random.Random(4)
    isbns = [f"b{i:02d}" for i in range(40)]
    words = ["red", "old", "ring", "gear", "saga"]
    stats = [(i, f"{rng.choice(words)} {rng.choice(words)} {n % 9}",
              rng.choice(["ann", "bob", "", None]), rng.randint(5, 40), round(rng.uniform(3, 9), 3))
             for n, i in enumerate(isbns)]
    sim = []
    for n, a in enumerate(isbns):
        for b in isbns[n + 1:]:
            if rng.random() < 0.5:
                s = rng.choice([0.0, 0.25, 0.5, round(rng.random(), 9)])
                sim += [(a, b, s), (b, a, s)]
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in isbns[:30]]
    dominant = [(i, rng.choice(["13-17", "55+"]), 3) for i in isbns[:35]]
    top = [(g, i, b) for g in ("13-17", "55+") for i, _, _, _, b in stats if rng.random() < 0.7]
    enriched = [(i, f"about {i}", "x, y") for i in isbns[:20]]
    return strategies.Artefacts(
        spark.createDataFrame(sim, SIM),
        spark.createDataFrame(vectors, "isbn string, embedding array<double>"),
        spark.createDataFrame(stats, STATS),
        spark.createDataFrame(dominant, "isbn string, dominant_age_group string, age_group_count long"),
        spark.createDataFrame(top, "age_group string, isbn string, bayesian_rating double"),
        strategies.catalogue(spark.createDataFrame(stats, STATS), spark.createDataFrame(
            enriched, "isbn string, description string, subjects string")))


@pytest.fixture(scope="module")
def all_recs(spark, art, store):
    seeds = art.stats.select(F.col("isbn").alias("seed_isbn"))
    return strategies.recommend_all(seeds, art, store, 5).cache()


def test_ranks_have_no_gaps_and_seeds_never_return(all_recs):
    lists = defaultdict(list)
    for r in all_recs.collect():
        assert r.isbn != r.seed_isbn
        lists[r.seed_isbn, r.strategy].append((r["rank"], r.score))
    assert {s for _, s in lists} == {name for name, _, _ in params.STRATEGIES}
    for found in lists.values():
        found.sort()
        assert [rank for rank, _ in found] == list(range(1, len(found) + 1)) and len(found) <= 5
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)


@pytest.mark.parametrize("name", [name for name, _, _ in params.STRATEGIES])
def test_one_strategy_equals_its_part_of_all(spark, art, all_recs, name):
    seeds = seeds_of(spark, "b00", "b07", "b33", "absent")
    one = strategies.recommend(seeds, name, art, 5)
    part = all_recs.filter(
        (F.col("strategy") == name) & F.col("seed_isbn").isin("b00", "b07", "b33"))
    assert rows(one) == rows(part.drop("strategy_order"))
    assert rows(strategies.recommend(seeds_of(spark, "absent"), name, art, 5)) == []


def test_unknown_strategy_is_rejected(spark, art):
    with pytest.raises(KeyError, match="best_sellers"):
        strategies.recommend(seeds_of(spark, "b00"), "best_sellers", art)


def test_same_author_and_age_group_equal_plain_joins(art, all_recs):
    plain = art.stats.alias("s").join(art.stats.alias("o"), "author").filter(
        "author <> '' AND s.isbn <> o.isbn").select("s.isbn", "o.isbn", "o.bayesian_rating").collect()
    expected = defaultdict(list)
    for seed, isbn, score in plain:
        expected["same_author", seed].append((-score, isbn))
    bracket = {r.isbn: r.dominant_age_group for r in art.dominant.collect()}
    for r in art.top_books.collect():
        for seed, group in bracket.items():
            if group == r.age_group and seed != r.isbn:
                expected["age_group", seed].append((-r.bayesian_rating, r.isbn))
    got = defaultdict(list)
    for r in all_recs.filter(F.col("strategy").isin("same_author", "age_group")).collect():
        got[r.strategy, r.seed_isbn].append((r["rank"], r.isbn))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {
        k: [i for _, i in sorted(v)[:5]] for k, v in expected.items()}


def test_metadata_defaults(spark, art):
    lists = spark.createDataFrame([("b00", "nowhere", 0.12345649, 1)],
                                  "seed_isbn string, isbn string, score double, rank int")
    row = strategies.attach_metadata(lists, art.catalogue, "readers_also").first()
    assert (row.title, row.author, row.description, row.rating_count, row.bayesian_rating) == (
        "", "", "", 0, 0.0)
    assert row.score == 0.123456


@pytest.mark.parametrize("name, unread", [
    ("same_author", ("similarity", "vectors", "dominant", "top_books")),
    ("hidden_gems", ("vectors", "dominant", "top_books")),
    ("similar_themes", ("similarity", "dominant", "top_books"))])
def test_a_strategy_makes_only_the_tables_it_reads(spark, name, unread):
    tables = Workspace(spark, "/root/testdata/sf0.001")
    recs = strategies.recommend(tables.seeds, name, tables.artefacts)
    made = set(vars(tables))
    assert {"stats", "catalogue"} <= made
    assert not made & {*unread, *({"pairs", "pair_table"} if "similarity" in unread else ())}
    assert not recs.isEmpty()


def test_missing_count_in_hidden_gems_is_one(spark):
    sim = spark.createDataFrame([("s", "x", 0.5), ("s", "y", 0.5), ("s", "z", -0.1)], SIM)
    stats = spark.createDataFrame([("x", "t", "a", 100, 5.0)], STATS)
    got = rows(strategies.hidden_gems_list(seeds_of(spark, "s"), sim, stats))
    assert [(r[1], r[3]) for r in got] == [("x", 2), ("y", 1)]


def test_constant_list_scales_to_one(spark):
    df = spark.createDataFrame([("s", 3.0), ("s", 3.0), ("t", 1.0), ("t", 5.0)],
                               "seed_isbn string, score double")
    assert rows(strategies.minmax_per_list(df, ["seed_isbn"])) == [
        ("s", 1.0), ("s", 1.0), ("t", 0.0), ("t", 1.0)]


def test_fusion_by_hand(spark):
    stats = spark.createDataFrame(
        [("s", "seed title", "a", 9, 5.0), ("x", "alpha", "a", 10, 5.0), ("y", "beta", "a", 10, 5.0),
         ("e", "seed titlE", "a", 10, 5.0), ("few", "gamma", "a", 7, 5.0),
         ("low", "delta", "a", 10, 4.4)], STATS)
    schema = "seed_isbn string, isbn string, score double, rank int"
    cf = spark.createDataFrame([("s", "e", 0.9, 1), ("s", "x", 0.8, 2), ("s", "low", 0.6, 3),
                                ("s", "y", 0.4, 4), ("s", "few", 0.3, 5)], schema)
    semantic = spark.createDataFrame([("s", "y", 0.7, 1)], schema)
    got = {r.isbn: r for r in strategies.fused_candidates(cf, semantic, stats).collect()}
    assert set(got) == {"x", "low", "y"}
    assert (got["y"].cf_rank, got["y"].semantic_rank, got["x"].semantic_rank) == (3, 1, None)
    assert got["y"].rrf_bonus == pytest.approx(1 / 63 + 1 / 61)
    assert got["x"].linear_score == pytest.approx(0.6)
    kept = strategies.quality_floor(strategies.fused_candidates(cf, semantic, stats))
    assert {r.isbn for r in kept.collect()} == {"x", "y"}


def test_scores_guard_zero_counts(spark):
    row = spark.range(1).select(
        scores.gem_score(F.lit(0.5), F.lit(0)), scores.popularity_penalty(F.lit(0.5), F.lit(0))).first()
    assert tuple(row) == (None, None)
