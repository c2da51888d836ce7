"""Title search, isbn lookup, seed resolution and display columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readalike import params
from readalike.functions.text import is_blank, ngrams, strip
from readalike.operators.ids import item_index
from readalike.operators.ranking import at_most, top_k
from readalike.operators.skew import join_per_key
from readalike.sources.store import Store

BOOK_COLUMNS = ("isbn", "title", "author", "rating_count", "bayesian_rating")
GRAM = 3


@dataclass
class TitleIndex:
    """An inverted index of the titles' grams, stored once for any number of searches.

    ``titles``: the book columns, the lower-cased title and its number. ``cells``: (gram, chunk, numbers), the sorted numbers
    of the titles with the gram within one range of ``params.TITLE_CHUNK`` numbers, so that no cell is longer than that, however
    frequent its gram. ``counts``: (gram, n) titles of each gram. Grams have one to ``GRAM`` letters.
    """
    titles: DataFrame
    cells: DataFrame
    counts: DataFrame


def title_index(stats: DataFrame, store: Store, chunk: int = params.TITLE_CHUNK) -> TitleIndex:
    """The index of a table with the book columns."""
    texts = stats.select(*BOOK_COLUMNS, F.lower(F.coalesce("title", F.lit(""))).alias("text"))
    titles = store.write(texts.join(item_index(store, stats), "isbn").withColumnRenamed("idx", "number"))
    grams = F.array_distinct(F.concat(*[ngrams(F.col("text"), n) for n in range(1, GRAM + 1)]))
    rows = titles.select(F.explode(grams).alias("gram"), "number")
    cells = rows.groupBy("gram", F.floor(F.col("number") / chunk).alias("chunk")).agg(
        F.sort_array(F.collect_list("number")).alias("numbers"))
    cells = store.write(cells)
    counts = store.write(cells.groupBy("gram").agg(F.sum(F.size("numbers")).alias("n")))
    return TitleIndex(titles, cells, counts)


def _candidates(texts: DataFrame, index: TitleIndex, store: Store) -> DataFrame:
    """(q, number) of titles that have the two rarest grams of the query.

    A title that contains the query contains all of its grams, so these two miss nothing. Queries of
    the same two grams share one intersection, made chunk by chunk.
    """
    grams = F.when(F.length("q") < GRAM, F.array("q")).otherwise(F.array_distinct(ngrams(F.col("q"), GRAM)))
    wanted = store.write(texts.select("q", F.explode(grams).alias("gram")))
    # a gram that no title has rules the query out, so it must not lose to a known one
    known = join_per_key(wanted, wanted.select("gram").distinct().join(index.counts, "gram", "left").fillna(0, subset=["n"]), "gram")
    # a query's grams are a short list: as many as it has letters
    rarest = known.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    chosen = store.write(rarest.filter(F.col("grams")[0]["n"] > 0).select(
        "q", F.col("grams")[0]["gram"].alias("rarest"),
        F.coalesce(F.try_element_at("grams", F.lit(2))["gram"], F.col("grams")[0]["gram"]).alias("next")))
    couples = chosen.select("rarest", "next").distinct()
    one = index.cells.select(F.col("gram").alias("rarest"), "chunk", F.col("numbers").alias("x"))
    two = index.cells.select(F.col("gram").alias("next"), "chunk", F.col("numbers").alias("y"))
    both = couples.join(one, "rarest").join(two, ["next", "chunk"]).select(
        "rarest", "next", F.array_intersect("x", "y").alias("numbers")).filter(F.size("numbers") > 0)
    return chosen.join(store.write(both), ["rarest", "next"]).select("q", F.explode("numbers").alias("number"))


def search_books(queries: DataFrame, stats: DataFrame | TitleIndex, n: int = params.TOP_K,
                 scan_limit: int = params.SCAN_QUERIES, store: Store | None = None) -> DataFrame:
    """Best ``n`` books per query text: exact titles first, then titles that
    contain it, each by rating count. Blank queries find nothing.

    Up to ``scan_limit`` texts are broadcast and matched in one scan of the titles; more of them go through the
    gram index, which is made here unless a stored one is given in place of the books.
    Returns query, rank and the book columns.
    """
    asked = queries.select("query").distinct().withColumn("q", strip(F.lower("query")))
    asked = asked.filter(F.col("q") != "")
    texts = asked.select("q").distinct()
    few = at_most(texts, scan_limit)
    if isinstance(stats, TitleIndex):
        index, titles = stats, stats.titles
    else:
        index, titles = None, stats.select(*BOOK_COLUMNS, F.lower(F.coalesce("title", F.lit(""))).alias("text"))
    if few:
        found = titles.join(F.broadcast(texts), F.col("text").contains(F.col("q")))
    else:
        store = store or Store(queries.sparkSession)
        index = index or title_index(stats, store)
        found = index.titles.join(_candidates(texts, index, store), "number").filter(F.col("text").contains(F.col("q")))
    exact = (F.col("text") == F.col("q")).cast("int")
    best = top_k(found.withColumn("exact", exact), ["q"],
                 [F.desc("exact"), F.desc("rating_count"), F.asc("isbn")], n)
    return asked.join(best, "q").select("query", "rank", *BOOK_COLUMNS)


def get_books(isbns: DataFrame, stats: DataFrame) -> DataFrame:
    return stats.join(isbns.select("isbn"), "isbn", "left_semi").select(*BOOK_COLUMNS)


def resolve_seeds(requests: DataFrame, stats: DataFrame | TitleIndex) -> DataFrame:
    """Requests (request_isbn, request_title) to their seed book.

    A given isbn decides; without one the best title match does. What cannot be
    resolved keeps its request and an ``error``.
    """
    by_isbn = requests.filter(~is_blank(F.col("request_isbn")))
    by_title = requests.filter(is_blank(F.col("request_isbn")))
    books = (stats.titles if isinstance(stats, TitleIndex) else stats).select(*BOOK_COLUMNS)
    first = by_isbn.join(books, F.col("request_isbn") == F.col("isbn"), "left").withColumn(
        "error", F.when(F.col("isbn").isNull(), "no book has this isbn"))
    best = search_books(by_title.select(F.col("request_title").alias("query")), stats, 1)
    second = by_title.join(
        best.drop("rank"), F.col("request_title") == F.col("query"), "left"
    ).drop("query").withColumn("error", F.when(F.col("isbn").isNull(), "no title matches"))
    return first.unionByName(second)


def score_percent(recs: DataFrame) -> DataFrame:
    """Score as a whole percentage of the best score of its list."""
    group = Window.partitionBy("seed_isbn", "strategy")  # a list has at most k rows
    best = F.greatest(F.max("score").over(group), F.lit(1e-9))
    return recs.withColumn("score_pct", F.round(F.col("score") / best * 100).cast("int"))


def display_columns(recs: DataFrame) -> DataFrame:
    """Adds has_description and the first display tags."""
    description = F.coalesce("description", F.lit(""))
    fallback = F.lower(F.concat(
        F.coalesce("title", F.lit("")), F.lit(" by "), F.coalesce("author", F.lit(""))))
    real = (
        (F.lower(description) != fallback)
        & (F.length(description) > params.DISPLAY_DESCRIPTION_CHARS)
    )
    parts = F.transform(F.split(F.coalesce("subjects", F.lit("")), ","), strip)
    tags = F.slice(F.filter(parts, lambda t: t != ""), 1, params.DISPLAY_TAGS)
    return recs.withColumn("has_description", real).withColumn("tags", tags)


