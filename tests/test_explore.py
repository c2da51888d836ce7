import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from readalike.operators import explore
from readalike.operators.ids import item_index
from tests.conftest import rows

RATINGS = "user_id int, isbn string, rating int"


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [0.5] * 30 + [0.1, 0.9], [round(random.Random(i).random(), 3) for i in range(101)],
    [round(random.Random(i).random(), 2) for i in range(100)], [1e300] + [random.Random(i).gauss(0, 1) for i in range(200)],
    [-1e300, 1e300, 5e-324, -5e-324], [0.0, -0.0, 0.0], [float("inf"), 2.0, 3.0], [float("-inf"), -2.0, -3.0, -2.5],
    [-7.0] * 9 + [7.0] * 9, [math.ldexp(random.Random(i).random(), i % 60 - 30) for i in range(301)]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    for bins in (2, 65_536):
        got = spark.range(1).select(explore.exact_median(df, "v", bins)).first()[0]
        assert got == pytest.approx(statistics.median(values), abs=1e-12)


def test_histogram_matches_numpy(spark):
    values = [round(random.Random(3).random() * i, 4) for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    counts, edges = np.histogram(values, bins=20)
    got = explore.histogram(df, "v", 20).orderBy("bin").collect()
    assert [r.n for r in got] == list(counts)
    assert [r.low_edge for r in got] == pytest.approx(list(edges[:-1]))
    same = spark.createDataFrame([(2.0,)] * 5, "v double")
    flat = explore.histogram(same, "v", 4).orderBy("bin").collect()
    assert [r.n for r in flat] == list(np.histogram([2.0] * 5, bins=4)[0])


def test_log_histogram_and_dropped(spark):
    raw = [(u, f"b{b}", 5) for b in range(1, 41) for u in range(b)] + [(1, "zero", 0)]
    clean = [r for r in raw if r[2] and int(r[1][1:]) >= 5]
    raw_df, clean_df = (spark.createDataFrame(d, RATINGS) for d in (raw, clean))
    got = explore.log_histogram(raw_df, clean_df, 20).orderBy("bin").collect()
    edges = np.logspace(0, np.log10(40), 20)
    edges[-1] += 1e-9
    assert [r.raw_books for r in got] == list(np.histogram(range(1, 41), bins=edges)[0])
    assert [r.clean_books for r in got] == list(np.histogram(range(5, 41), bins=edges)[0])
    assert tuple(explore.dropped_share(raw_df, clean_df).first()) == (40, 36, 4, 10.0)


def test_reports(spark):
    data = [(1, "a", 0), (1, "a", 0), (1, "b", 5), (2, "b", 7), (3, "c", 5)]
    ratings = spark.createDataFrame(data, RATINGS)
    books = spark.createDataFrame([("a", "A", "x"), ("b", "B", None)],
                                  "isbn string, title string, author string")
    assert explore.duplicate_count(ratings).first()[0] == 1
    assert rows(explore.null_counts(books)) == [("author", 1), ("isbn", 0), ("title", 0)]
    assert rows(explore.rating_distribution(ratings)) == [(0, 2, 40.0), (5, 2, 40.0), (7, 1, 20.0)]
    compare = rows(explore.rating_distribution_compare(ratings, ratings.filter("rating > 0")))
    assert len(compare) == 11 and compare[0] == (0, 2, 0, 2, 3) and compare[5] == (5, 2, 2, 2, 3)
    assert tuple(explore.cardinalities(ratings).first()) == (3, 3, 2, 2)
    tail = {r.measure: (r.n, r.share_pct) for r in explore.long_tail(ratings).collect()}
    assert tail["books_with_1"] == (1, pytest.approx(100 / 3)) and tail["books_with_0"][0] == 0
    assert tail["users_with_1"][0] == 2
    assert rows(explore.most_rated(ratings, books, 2)) == [("a", 2, "A"), ("b", 2, "B")]
    assert rows(explore.most_rated(ratings, books, 1, asc=True)) == [("c", 1, "[UNKNOWN TITLE]")]
    assert [r[0] for r in rows(explore.best_rated(ratings, books, 2, 1))] == ["b"]


def test_exploratory_cleaning(spark, store):
    data = [(u, i, 5) for u in range(3) for i in ("a", "b", "n")] + [(9, "c", 4), (1, "z", 0)]
    ratings = spark.createDataFrame(data, RATINGS)
    books = spark.createDataFrame(
        [("a", "A", "x"), ("a", "A2", "x"), ("b", "B", None), ("c", "C", "x"), ("z", "Z", "x")],
        "isbn string, title string, author string")
    explicit = explore.explicit_once(ratings, store)
    kept, left = explore.explore_clean(books, explicit)
    assert rows(kept) == [("a", "A", "x")] and left.count() == 3
    report = {r.step: r.n for r in explore.explore_clean_report(books, explicit).collect()}
    assert report == {"all_books": 4, "rated_books": 3, "often_rated_books": 2, "kept_books": 1,
                      "kept_ratings": 3}
    assert tuple(explore.survival_funnel(books, ratings).first()) == (4, 3, 2, 1)
    seeds = kept.selectExpr("isbn AS seed_isbn")
    assert rows(explore.author_by_mean(seeds, kept, left)) == [("a", 1, "a", 5.0, 3)]


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("cast(id AS string) AS isbn")
    one = rows(explore.sample_items(df.coalesce(1), 40))
    assert one == rows(explore.sample_items(df.repartition(7), 40))
    assert len(set(one)) == 40 and one != rows(explore.sample_items(df, 40, seed=7))
    assert explore.sample_items(df, 6000).count() == 500


def test_strategy_table_fills_gaps(spark):
    from readalike.operators.strategies import strategies
    recs = spark.createDataFrame([("s", "readers_also", 1, "x", "X"), ("s", "readers_also", 4, "y", "Y")],
                                 "seed_isbn string, strategy string, rank int, isbn string, title string")
    seeds = spark.createDataFrame([("s",)], "seed_isbn string")
    table = {r.strategy: r for r in explore.strategy_table(recs, seeds, strategies(spark)).collect()}
    assert len(table) == 6 and table["readers_also"].title_1 == "X"
    assert table["readers_also"].isbn_2 is None and table["top_picks"].isbn_1 is None


def test_fans_are_ranked_where_their_seed_lies(spark, store):
    """Baskets are sent to their seeds: no row of a pair is shuffled."""
    rng = random.Random(4)
    rated = sorted({(u, f"b{rng.randrange(700):03d}") for u in range(900) for _ in range(12)})
    ratings = spark.createDataFrame([(u, b, rng.randint(5, 10)) for u, b in rated], "user_id int, isbn string, rating int")
    seeds = ratings.select(F.col("isbn").alias("seed_isbn")).distinct()
    index = store.write(item_index(store, seeds.withColumnRenamed("seed_isbn", "isbn")))
    df = explore.fan_co_reads_weighted(seeds, ratings, index=index)
    plan = df._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("seed_isbn#"):plan.index("collect_list")]
    assert "explode" in below and not re.search(r"Exchange hashpartitioning\(seed_isbn#\w+, isbn#", below)
    few = explore.fan_co_reads_weighted(seeds, ratings, few=1_000)
    table = explore.fan_co_reads_weighted(seeds, ratings, index=index, limit=5)
    assert rows(df) == rows(few) == rows(table)
