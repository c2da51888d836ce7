"""Cleaning of raw ratings, books and users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readalike import params
from readalike.functions.text import lower_trim
from readalike.operators.ranking import at_most, top_k
from readalike.operators.skew import join_per_key
from readalike.sources.store import Store

RATING_KEYS = ("user_id", "isbn")


def drop_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def dedupe_ratings(ratings: DataFrame, keys: Sequence[str] = RATING_KEYS) -> DataFrame:
    """One rating per key: the highest. ``max`` combines before the shuffle."""
    return ratings.groupBy(*keys).agg(F.max("rating").alias("rating"))


def explicit_ratings(ratings: DataFrame, lo: int = params.MIN_RATING,
                     hi: int = params.MAX_RATING) -> DataFrame:
    return ratings.filter(F.col("rating").between(lo, hi))


def _frequent(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n).select(key)


def min_ratings_per_user(ratings: DataFrame,
                         n: int = params.MIN_RATINGS_PER_USER, store: Store | None = None) -> DataFrame:
    """Users below ``n`` are taken out, as they are the few: up to ``params.RARE_USERS`` of them are broadcast, so the
    ratings aren't shuffled. With more of them the result is stored, if there is a ``store``."""
    present = drop_nulls(ratings, ["user_id"])
    per_user = present.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    rare = Store(ratings.sparkSession).write(per_user.filter(F.col("n") < n).select("user_id"))
    if at_most(rare, params.RARE_USERS):
        return present.join(F.broadcast(rare), "user_id", "left_anti")
    kept = join_per_key(present, _frequent(present, "user_id", n), "user_id", "left_semi")
    return kept if store is None else store.write(kept)


def normalize_text(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, lower_trim(F.col(col)))


def _in_range(value: Column, lo: int, hi: int) -> Column:
    return F.when(value.between(lo, hi), value)


def clean_year(books: DataFrame) -> DataFrame:
    year = F.col("year").try_cast("int")
    return books.withColumn("year", _in_range(year, params.MIN_YEAR, params.MAX_YEAR))


def clean_age(users: DataFrame, lo: int = params.MIN_AGE, hi: int = params.MAX_AGE) -> DataFrame:
    """Text age to int by way of double; unreadable or out of range becomes null."""
    age = F.col("age").try_cast("double").try_cast("int")
    return users.withColumn("age", _in_range(age, lo, hi))


def books_with_ratings(books: DataFrame, ratings: DataFrame) -> DataFrame:
    return books.join(ratings.select("isbn"), "isbn", "left_semi")


def min_ratings_per_book(books: DataFrame, ratings: DataFrame,
                         n: int = params.MIN_RATINGS_PER_BOOK) -> DataFrame:
    return books.join(_frequent(ratings, "isbn", n), "isbn", "left_semi")


def dedupe_editions(books: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
    """Per (title, author) keep the most rated isbn, then the lowest isbn."""
    if ratings is None:
        return top_k(books, ["title", "author"], [F.asc("isbn")], 1).drop("rank")
    return _most_rated_edition(books.join(_counts(ratings), "isbn", "left").fillna(0, subset=["_n"]))


def _counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("isbn").agg(F.count(F.lit(1)).alias("_n"))


def _most_rated_edition(counted: DataFrame) -> DataFrame:
    return top_k(counted, ["title", "author"], [F.desc("_n"), F.asc("isbn")], 1).drop("rank", "_n")


def one_row_per_isbn(books: DataFrame) -> DataFrame:
    """Lowest title, then author, of an isbn that is listed more than once."""
    return top_k(books, ["isbn"], [F.asc("title"), F.asc("author")], 1).drop("rank")


def ratings_of_books(ratings: DataFrame, books: DataFrame) -> DataFrame:
    return ratings.join(books.select("isbn"), "isbn", "left_semi")


def clean_ratings(ratings: DataFrame, lo: int = params.MIN_RATING, hi: int = params.MAX_RATING,
                  min_per_user: int = params.MIN_RATINGS_PER_USER,
                  store: Store | None = None) -> DataFrame:
    """Null keys, repeated ratings, explicit range, minimum per user.

    The deduped ratings are stored, as the last step reads them more than once. The result is that table without a few
    broadcast users, or a table of its own, so it is cheap to read and need not be stored again.
    Ratings below ``lo`` leave before the shuffle: the highest of a group is
    below ``lo`` only when all of the group is, so no result changes.
    """
    present = drop_nulls(ratings, ["user_id", "isbn", "rating"]).filter(F.col("rating") >= lo)
    store = store or Store(ratings.sparkSession)
    explicit = store.write(explicit_ratings(dedupe_ratings(present), lo, hi))
    return min_ratings_per_user(explicit, min_per_user, store)


def clean_books(books: DataFrame, ratings: DataFrame,
                min_per_book: int = params.MIN_RATINGS_PER_BOOK) -> DataFrame:
    """``ratings`` are cleaned ones, counted once for the minimum and the editions. Counted books have ratings, whatever the minimum."""
    named = drop_nulls(books, ["isbn", "title"])
    tidy = clean_year(normalize_text(normalize_text(named, "title"), "author"))
    rated = tidy.join(_counts(ratings).filter(F.col("_n") >= min_per_book), "isbn")
    return one_row_per_isbn(_most_rated_edition(rated))


def clean_users(users: DataFrame, lo: int = params.MIN_AGE, hi: int = params.MAX_AGE) -> DataFrame:
    return clean_age(drop_nulls(users, ["user_id"]), lo, hi)


def stage_counts(raw: dict[str, DataFrame], clean: dict[str, DataFrame]) -> DataFrame:
    """Rows per (stage, table), one aggregate per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(stage).alias("stage"), F.lit(table).alias("table_name"), "n")
        for stage, tables in (("raw", raw), ("clean", clean))
        for table, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
