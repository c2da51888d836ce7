"""Data-quality and distribution reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readalike import params
from readalike.functions.text import genre
from readalike.operators.clean import (
    dedupe_ratings, drop_nulls, min_ratings_per_book, one_row_per_isbn, ratings_of_books)
from readalike.operators.pairs import ranked_co_ratings
from readalike.operators.ranking import top_k
from readalike.operators.skew import join_per_key
from readalike.sources.store import Store

def n_rows() -> Column:
    return F.count(F.lit(1))


def share(part: Column, whole: Column) -> Column:
    return part * 100.0 / F.nullif(whole, F.lit(0))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_null), one aggregate over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "n_null")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in full."""
    return df.groupBy(*df.columns).agg(n_rows().alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def rating_distribution(ratings: DataFrame) -> DataFrame:
    counts = ratings.groupBy("rating").agg(n_rows().alias("n"))
    total = ratings.agg(n_rows()).scalar()
    return counts.withColumn("share_pct", share(F.col("n"), total))


def rating_distribution_compare(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Counts of ratings 0 to 10 before and after, with the totals."""
    axis = raw.sparkSession.range(11).select(F.col("id").cast("int").alias("rating"))
    raw_n = raw.groupBy("rating").agg(n_rows().alias("raw_n"))
    clean_n = clean.groupBy("rating").agg(n_rows().alias("clean_n"))
    totals = raw.agg(F.count_if(F.col("rating") == 0).alias("implicit_total"),
                     F.count_if(F.col("rating") != 0).alias("explicit_total"))
    return (
        axis.join(raw_n, "rating", "left").join(clean_n, "rating", "left").fillna(0)
        .withColumn("implicit_total", totals.select("implicit_total").scalar())
        .withColumn("explicit_total", totals.select("explicit_total").scalar())
    )


def cardinalities(ratings: DataFrame) -> DataFrame:
    """Distinct users and books, and the rows beyond them."""
    users = F.countDistinct("user_id")
    books = F.countDistinct("isbn")
    return ratings.agg(users.alias("n_users"), books.alias("n_books"),
                       (n_rows() - users).alias("n_repeat_users"), (n_rows() - books).alias("n_repeat_books"))


def long_tail(ratings: DataFrame) -> DataFrame:
    """Books with 0, 1 and 2 ratings and users with 1, with their shares."""
    def few(key: str, label: str, limits: list[int]) -> DataFrame:
        per_key = ratings.groupBy(key).agg(n_rows().alias("n"))
        counts = per_key.agg(n_rows().alias("total"), *[
            F.count_if(F.col("n") == i).alias(f"{label}_{i}") for i in limits])
        return counts.unpivot(["total"], [f"{label}_{i}" for i in limits], "measure", "n")

    rows = few("isbn", "books_with", [0, 1, 2]).unionByName(few("user_id", "users_with", [1]))
    return rows.select("measure", "n", share(F.col("n"), F.col("total")).alias("share_pct"))


def _titles(books: DataFrame) -> DataFrame:
    return one_row_per_isbn(books.select("isbn", "title", "author")).select("isbn", "title")


def _with_title(rows: DataFrame, books: DataFrame) -> DataFrame:
    """Title of each report row; the report is small, so it is the side to match."""
    titles = books.select("isbn", "title", "author").join(
        F.broadcast(rows.select("isbn")), "isbn", "left_semi")
    return rows.join(_titles(titles), "isbn", "left").fillna("[UNKNOWN TITLE]", subset=["title"])


def most_rated(ratings: DataFrame, books: DataFrame, n: int = params.REPORT_ROWS,
               asc: bool = False) -> DataFrame:
    counts = ratings.groupBy("isbn").agg(n_rows().alias("n_ratings"))
    by_count = F.asc("n_ratings") if asc else F.desc("n_ratings")
    return _with_title(counts.orderBy(by_count, F.asc("isbn")).limit(n), books)


def best_rated(ratings: DataFrame, books: DataFrame, min_n: int = params.BEST_RATED_MIN_RATINGS,
               n: int = params.REPORT_ROWS) -> DataFrame:
    means = ratings.groupBy("isbn").agg(n_rows().alias("n_ratings"), F.avg("rating").alias("mean_rating"))
    best = means.filter(F.col("n_ratings") >= min_n).orderBy(
        F.desc("mean_rating"), F.asc("isbn")).limit(n)
    return _with_title(best, books)


def survival_funnel(books: DataFrame, ratings: DataFrame,
                    min_n: int = params.EXPLORE_MIN_RATINGS) -> DataFrame:
    """Raw isbns, isbns with enough explicit ratings, orphans, survivors."""
    explicit = dedupe_ratings(ratings.filter(F.col("rating") > 0))
    popular = explicit.groupBy("isbn").agg(n_rows().alias("n")).filter(F.col("n") >= min_n)
    named = drop_nulls(books, ["title", "author"]).select("isbn").distinct()
    survived = named.join(popular, "isbn", "left_semi").agg(n_rows()).scalar()
    total = books.agg(F.countDistinct("isbn")).scalar()
    return popular.agg(n_rows().alias("popular")).select(
        total.alias("raw_isbns"), "popular", (F.col("popular") - survived).alias("orphans"),
        survived.alias("survived"))


def explicit_once(ratings: DataFrame, store: Store) -> DataFrame:
    """Repeated ratings dropped, then zeros. Stored, as every step below reads it."""
    return store.write(dedupe_ratings(ratings).filter(F.col("rating") > 0))


def explore_clean(books: DataFrame, explicit: DataFrame,
                  min_n: int = params.EXPLORE_MIN_RATINGS) -> tuple[DataFrame, DataFrame]:
    """Books and ratings under the exploratory rules, from ``explicit_once``."""
    named = drop_nulls(books, ["title", "author"])
    kept_books = one_row_per_isbn(min_ratings_per_book(named, explicit, min_n))
    # these books have enough ratings, so theirs are all that is kept
    return kept_books, ratings_of_books(explicit, kept_books)


def explore_clean_report(books: DataFrame, explicit: DataFrame) -> DataFrame:
    """Distinct books after each exploratory step, and the ratings left."""
    per_book = explicit.groupBy("isbn").agg(n_rows().alias("n"))
    enough = per_book.filter(F.col("n") >= params.EXPLORE_MIN_RATINGS)
    kept_books, kept_ratings = explore_clean(books, explicit)
    isbns = books.select("isbn").distinct()
    steps = {
        "all_books": isbns,
        "rated_books": isbns.join(per_book, "isbn", "left_semi"),
        "often_rated_books": isbns.join(enough, "isbn", "left_semi"),
        "kept_books": kept_books,
        "kept_ratings": kept_ratings,
    }
    out = None
    for name, df in steps.items():
        row = df.agg(n_rows().alias("n")).select(F.lit(name).alias("step"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _fans(ratings: DataFrame, threshold: int) -> DataFrame:
    return ratings.filter(F.col("rating") >= threshold)


def fan_co_reads(seeds: DataFrame, ratings: DataFrame, threshold: int = params.FAN_RATING,
                 k: int = params.TOP_K, index: DataFrame | None = None,
                 **options) -> DataFrame:
    """Other books that the seed's fans rated at least ``threshold``, by count."""
    return ranked_co_ratings(seeds, _fans(ratings, threshold), "count", k, index, **options).select(
        "seed_isbn", "rank", "isbn", "co_raters")


def fan_co_reads_weighted(seeds: DataFrame, ratings: DataFrame, threshold: int = params.FAN_RATING,
                          k: int = params.TOP_K, index: DataFrame | None = None,
                 **options) -> DataFrame:
    """The same books by the sum of their ratings."""
    return ranked_co_ratings(seeds, _fans(ratings, threshold), "sum", k, index, **options).select(
        "seed_isbn", "rank", "isbn", "rating_sum")


def author_by_mean(seeds: DataFrame, books: DataFrame, ratings: DataFrame,
                   k: int = params.TOP_K) -> DataFrame:
    """The author's books by mean, then count, the seed included."""
    means = ratings.groupBy("isbn").agg(n_rows().alias("n_ratings"), F.avg("rating").alias("mean_rating"))
    rated = books.select("isbn", "author").filter(F.col("author").isNotNull()).join(means, "isbn")
    best = top_k(rated, ["author"], [F.desc("mean_rating"), F.desc("n_ratings"), F.asc("isbn")], k)
    lists = best.groupBy("author").agg(F.collect_list(
        F.struct("rank", "isbn", "mean_rating", "n_ratings")).alias("best"))
    wanted = books.select(F.col("isbn").alias("seed_isbn"), "author").join(
        seeds.select("seed_isbn"), "seed_isbn", "left_semi")
    return join_per_key(wanted, lists, "author").select("seed_isbn", F.inline("best"))


def exact_median(df: DataFrame, col: str, bins: int = 4_096) -> Column:
    """Exact median, without gathering the column in one task; null values are left out.

    Radix passes over the order of doubles: the first bins values by sign and power of two, the later ones cut the bin of the middle
    rank into ``bins`` equal parts, from its least to its largest value. Each pass is one grouped count of at most
    some thousand rows; an outlier has a bin of its own, and a bin of one distinct value ends the search.
    ``df`` should be a stored table, as each pass reads it.
    """
    values = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    size = F.abs(F.col("v"))
    power = (F.when(F.isnan("v"), 5_000).when(size == float("inf"), 4_000).when(size == 0, 0)
             .otherwise(F.floor(F.log2(size)) + 2_000).cast("int"))
    bin_of = F.when((F.col("v") < 0) & ~F.isnan("v"), -power).otherwise(power)
    rank = None
    while True:
        found = sorted(tuple(r) for r in values.groupBy(bin_of.alias("bin")).agg(
            n_rows().alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
        if rank is None:
            total = sum(n for _, n, _, _ in found)
            if not total:
                return F.lit(None).cast("double")
            # ranks from 0; an odd number of values has one middle
            rank, two = (total - 1) // 2, total % 2 == 0
        before = 0
        for at, (_, n, low, high) in enumerate(found):
            if rank < before + n:
                break
            before += n
        if two and rank == before + n - 1:
            return F.lit((high + found[at + 1][2]) / 2)   # the last of this bin and the first of the next
        if not low < high:
            return F.lit(float(low))
        values = values.filter(F.col("v").between(low, high))
        rank -= before
        bin_of = F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")


def similarity_report(sim: DataFrame, books: DataFrame) -> DataFrame:
    """Size, fill and spread of the symmetric similarity table."""
    n = books.agg(F.countDistinct("isbn")).scalar()
    return sim.agg(n_rows().alias("n_entries"), F.avg("similarity").alias("mean_similarity"),
                   F.min("similarity").alias("min_similarity"),
                   F.max("similarity").alias("max_similarity")).select(
        n.alias("n_items"), "n_entries",
        share(F.col("n_entries"), n.cast("double") * n).alias("fill_pct"),
        exact_median(sim, "similarity").alias("median_similarity"),
        "mean_similarity", "min_similarity", "max_similarity")


def histogram(df: DataFrame, col: str, bins: int = params.SIMILARITY_BINS) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed, empty ones kept."""
    values = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # a constant column gets half a unit on either side
    spare = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    low = bounds.select(F.col("lo") - spare).scalar()
    high = bounds.select(F.col("hi") + spare).scalar()
    bin_of = F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1))
    counts = values.groupBy(bin_of.alias("bin")).agg(n_rows().alias("n"))
    axis = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    step = (high - low) / bins
    return axis.join(counts, "bin", "left").fillna(0, subset=["n"]).select(
        "bin", F.round(low + F.col("bin") * step, 12).alias("low_edge"),
        F.round(low + (F.col("bin") + 1) * step, 12).alias("high_edge"), "n")


def _ratings_per_book(ratings: DataFrame) -> DataFrame:
    """(n, n_books): how many books have n ratings. Few rows, whatever the table."""
    return ratings.groupBy("isbn").agg(n_rows().alias("n")).groupBy("n").agg(n_rows().alias("n_books"))


def log_histogram(raw: DataFrame, clean: DataFrame, edges: int = params.LOG_EDGES) -> DataFrame:
    """Books per log-spaced bin of their rating count, before and after."""
    explicit = raw.filter(F.col("rating") > 0)
    counts = (
        _ratings_per_book(explicit).withColumn("stage", F.lit("raw"))
        .unionByName(_ratings_per_book(clean).withColumn("stage", F.lit("clean")))
    )
    whole = Window.partitionBy()  # over the few rows of distinct counts, then over the bins
    scaled = counts.withColumn("top", F.log10(F.max("n").over(whole)))
    bins = edges - 1
    bin_of = F.coalesce(F.least(F.floor(F.log10("n") / F.nullif(F.col("top"), F.lit(0.0)) * bins),
                                F.lit(bins - 1)), F.lit(0))
    per_bin = scaled.groupBy(bin_of.alias("bin")).agg(
        F.max("top").alias("top"),
        F.sum(F.when(F.col("stage") == "raw", F.col("n_books"))).alias("raw_books"),
        F.sum(F.when(F.col("stage") == "clean", F.col("n_books"))).alias("clean_books"))
    axis = raw.sparkSession.range(bins).select(F.col("id").alias("bin"))
    full = axis.join(per_bin, "bin", "left").withColumn("top", F.max("top").over(whole)).fillna(
        0, subset=["raw_books", "clean_books"])

    def edge(at: Column) -> Column:
        return F.round(F.pow(F.lit(10.0), F.col("top") * at / bins), 6)

    return full.select("bin", edge(F.col("bin")).alias("low_edge"),
                       edge(F.col("bin") + 1).alias("high_edge"), "raw_books", "clean_books")


def dropped_share(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Rated books before and after cleaning, and the share that was dropped."""
    before = raw.filter(F.col("rating") > 0).agg(F.countDistinct("isbn").alias("raw_books"))
    after = clean.agg(F.countDistinct("isbn")).scalar()
    dropped = F.col("raw_books") - F.col("clean_books")
    return before.withColumn("clean_books", after).select(
        "raw_books", "clean_books", dropped.alias("dropped_books"),
        F.coalesce(share(dropped, F.col("raw_books")), F.lit(0.0)).alias("dropped_pct"))


def genre_counts(items: DataFrame, enriched: DataFrame,
                 keywords=params.GENRE_KEYWORDS) -> DataFrame:
    """Items per genre; those without metadata are Other."""
    subjects = enriched.select("isbn", "subjects")
    return items.select("isbn").join(subjects, "isbn", "left").groupBy(
        genre(F.col("subjects"), keywords).alias("genre")).agg(n_rows().alias("n"))


def sample_items(df: DataFrame, n: int = params.SAMPLE_ITEMS,
                 seed: int = params.SAMPLE_SEED) -> DataFrame:
    """Up to ``n`` rows without replacement; the same rows for any partitioning."""
    return df.orderBy(F.md5(F.concat("isbn", F.lit(str(seed)))), "isbn").limit(n)


def strategy_table(recs: DataFrame, seeds: DataFrame, strategies: DataFrame,
                   n: int = 3) -> DataFrame:
    """One row per (seed, strategy) with the first ``n`` books side by side."""
    places = range(1, n + 1)
    wide = recs.filter(F.col("rank") <= n).groupBy("seed_isbn", "strategy").agg(*[
        F.max(F.when(F.col("rank") == i, F.col(col))).alias(f"{col}_{i}")
        for i in places for col in ("isbn", "title")])
    names = F.array(*[F.lit(name) for name, _, _ in params.STRATEGIES])
    rows = seeds.select("seed_isbn", F.explode(names).alias("strategy"))
    labels = F.broadcast(strategies.select("strategy_order", "strategy", "label"))  # six rows
    return rows.join(labels, "strategy").join(wide, ["seed_isbn", "strategy"], "left")
