"""Six ways to recommend: a table of seeds in, ranked rows out.

Each ``*_list`` function returns bare lists (seed_isbn, isbn, score, rank) for
all seeds at once; the function without the suffix attaches the metadata. A
seed that the needed table does not know yields no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readalike import params
from readalike.functions import scores
from readalike.functions.text import is_blank
from readalike.functions.titles import is_edition
from readalike.operators.ranking import top_k
from readalike.operators.skew import join_per_key
from readalike.operators.vectors import knn
from readalike.sources.store import Store

LIST_COLUMNS = ("seed_isbn", "isbn", "score", "rank")


def _ranked(df: DataFrame, k: int, keys: Sequence[str] = ("seed_isbn",)) -> DataFrame:
    return top_k(df, keys, [F.desc("score"), F.asc("isbn")], k)


def cf_candidates(seeds: DataFrame, sim: DataFrame, pool: int = params.FUSION_POOL) -> DataFrame:
    """Most similar other books, positive similarity only."""
    rows = sim.filter(F.col("similarity") > 0).select(
        F.col("isbn").alias("seed_isbn"), F.col("other_isbn").alias("isbn"),
        F.col("similarity").alias("score"))
    return _ranked(rows.join(seeds.select("seed_isbn"), "seed_isbn", "left_semi"), pool)


def semantic_candidates(seeds: DataFrame, vectors: DataFrame,
                        pool: int = params.FUSION_POOL) -> DataFrame:
    """``pool`` + 1 nearest by inner product, without the seed."""
    return _without_seed(knn(vectors, seeds, pool + 1), pool + 1)


def _without_seed(neighbours: DataFrame, nearest: int) -> DataFrame:
    return neighbours.filter((F.col("rank") <= nearest) & (F.col("isbn") != F.col("seed_isbn")))


def _with_titles(lists: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds title, rating_count, bayesian_rating of the candidate and seed_title."""
    candidate = stats.select("isbn", "title", "rating_count", "bayesian_rating")
    seed = stats.select(F.col("isbn").alias("seed_isbn"), F.col("title").alias("seed_title"))
    return lists.join(candidate, "isbn", "left").join(seed, "seed_isbn", "left")


def _hidden_gems_from(pool: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    counts = stats.select("isbn", "rating_count")
    gems = pool.drop("rank").join(counts, "isbn", "left").withColumn(
        "score", scores.gem_score(F.col("score"), F.coalesce("rating_count", F.lit(1))))
    return _ranked(gems.filter(F.col("score").isNotNull()), k).select(*LIST_COLUMNS)


def _similar_themes_from(neighbours: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    others = _without_seed(neighbours, k + params.EDITION_SPARE).drop("rank")
    kept = _with_titles(others, stats).filter(~is_edition(F.col("title"), F.col("seed_title")))
    return _ranked(kept, k).select(*LIST_COLUMNS)


def keep_candidates(lists: DataFrame, stats: DataFrame,
                    min_ratings: int = params.MIN_CANDIDATE_RATINGS) -> DataFrame:
    """Not the seed, rated often enough, not an edition of the seed."""
    known = _with_titles(lists, stats)
    return known.filter(
        (F.col("isbn") != F.col("seed_isbn"))
        & (F.coalesce("rating_count", F.lit(0)) >= min_ratings)
        & ~is_edition(F.col("title"), F.col("seed_title")))


def minmax_per_list(df: DataFrame, keys: Sequence[str], col: str = "score") -> DataFrame:
    """Scale ``col`` to 0..1 within each list."""
    bounds = df.groupBy(*keys).agg(F.min(col).alias("_low"), F.max(col).alias("_high"))
    scaled = scores.min_max(F.col(col), F.col("_low"), F.col("_high"))
    return join_per_key(df, bounds, list(keys)).withColumn(col, scaled).drop("_low", "_high")


def _scaled_and_ranked(lists: DataFrame) -> DataFrame:
    """Candidate lists of at most a pool per (seed, source): scale, then rank."""
    group = Window.partitionBy("seed_isbn", "source")
    scaled = scores.min_max(F.col("score"), F.min("score").over(group), F.max("score").over(group))
    rank = F.row_number().over(group.orderBy(F.desc("score"), F.asc("isbn")))
    return lists.withColumn("scaled", scaled).withColumn("rank", rank)


def linear_fusion(lists: DataFrame, alpha: float = params.FUSION_ALPHA) -> DataFrame:
    """Both filtered candidate lists side by side, one row per (seed, isbn).

    ``lists`` has source ``cf`` or ``semantic``. The lists are joined by one
    grouping on (seed, isbn), which is a full outer join without a second side.
    """
    def of(source: str, col: str) -> Column:
        return F.max(F.when(F.col("source") == source, F.col(col)))

    return (
        _scaled_and_ranked(lists).groupBy("seed_isbn", "isbn")
        .agg(
            of("cf", "scaled").alias("cf_score"), of("cf", "rank").alias("cf_rank"),
            of("semantic", "scaled").alias("semantic_score"),
            of("semantic", "rank").alias("semantic_rank"),
            F.max("rating_count").alias("rating_count"),
            F.max("bayesian_rating").alias("bayesian_rating"),
        )
        .withColumn("linear_score",
                    scores.linear_fusion(F.col("cf_score"), F.col("semantic_score"), alpha))
        .withColumn("rrf_bonus", scores.rrf_bonus(F.col("cf_rank"), F.col("semantic_rank")))
    )


def quality_floor(df: DataFrame, floor: float = params.MIN_BAYESIAN_RATING) -> DataFrame:
    return df.filter(F.coalesce("bayesian_rating", F.lit(0.0)) >= floor)


def fused_candidates(cf: DataFrame, semantic: DataFrame, stats: DataFrame,
                     min_ratings: int = params.MIN_CANDIDATE_RATINGS) -> DataFrame:
    """Filter both lists with one join, fuse them, penalise popularity."""
    both = cf.withColumn("source", F.lit("cf")).unionByName(
        semantic.withColumn("source", F.lit("semantic"))).drop("rank")
    fused = linear_fusion(keep_candidates(both, stats, min_ratings))
    score = scores.popularity_penalty(
        F.col("linear_score") + F.col("rrf_bonus"), F.coalesce("rating_count", F.lit(1)))
    return fused.withColumn("score", scores.settle(score))


def _top_picks_from(cf: DataFrame, semantic: DataFrame, stats: DataFrame, k: int,
                    min_ratings: int = params.MIN_CANDIDATE_RATINGS) -> DataFrame:
    fused = fused_candidates(cf, semantic, stats, min_ratings)
    return _ranked(quality_floor(fused), k).select(*LIST_COLUMNS)


def best_per_group(df: DataFrame, group: str, score: str, k: int) -> DataFrame:
    """One row per group with its ``k`` best (isbn, score), best first.

    The top-k filter cuts every group inside the tasks, so the list has at most
    ``k`` entries and a hot group never meets in one task.
    """
    rows = df.select(group, "isbn", scores.settle(F.col(score)).alias("score"))
    best = top_k(rows, [group], [F.desc("score"), F.asc("isbn")], k)
    return best.groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct("rank", "isbn", "score"))).alias("best"))


def pick_from_lists(seeds: DataFrame, lists: DataFrame, group: str, k: int) -> DataFrame:
    """Each seed takes its group's list, leaves itself out and keeps ``k``."""
    others = F.slice(F.filter("best", lambda b: b["isbn"] != F.col("seed_isbn")), 1, k)
    return join_per_key(seeds, lists, group).select(
        "seed_isbn", F.posexplode(others).alias("pos", "b")).select(
        "seed_isbn", "b.isbn", "b.score", (F.col("pos") + 1).alias("rank"))


def readers_also_list(seeds: DataFrame, sim: DataFrame, k: int = params.TOP_K) -> DataFrame:
    return cf_candidates(seeds, sim, k).select(*LIST_COLUMNS)


def hidden_gems_list(seeds: DataFrame, sim: DataFrame, stats: DataFrame,
                     k: int = params.TOP_K, pool: int = params.GEM_POOL) -> DataFrame:
    return _hidden_gems_from(cf_candidates(seeds, sim, pool), stats, k)


def similar_themes_list(seeds: DataFrame, vectors: DataFrame, stats: DataFrame,
                        k: int = params.TOP_K) -> DataFrame:
    return _similar_themes_from(knn(vectors, seeds, k + params.EDITION_SPARE), stats, k)


def same_author_list(seeds: DataFrame, stats: DataFrame, k: int = params.TOP_K) -> DataFrame:
    """The author's k + 1 best books serve every seed by that author."""
    authored = stats.filter(~is_blank(F.col("author")))
    known = authored.select(F.col("isbn").alias("seed_isbn"), "author").join(
        seeds.select("seed_isbn"), "seed_isbn", "left_semi")
    lists = best_per_group(authored, "author", "bayesian_rating", k + 1)
    return pick_from_lists(known, lists, "author", k)


def age_group_list(seeds: DataFrame, dominant: DataFrame, top_books: DataFrame,
                   k: int = params.TOP_K) -> DataFrame:
    """The bracket's k + 1 best books serve every seed of that bracket."""
    known = dominant.select(
        F.col("isbn").alias("seed_isbn"), F.col("dominant_age_group").alias("age_group")
    ).join(seeds.select("seed_isbn"), "seed_isbn", "left_semi")
    # six brackets of k + 1 books
    lists = F.broadcast(best_per_group(top_books, "age_group", "bayesian_rating", k + 1))
    return pick_from_lists(known, lists, "age_group", k)


def top_picks_list(seeds: DataFrame, sim: DataFrame, vectors: DataFrame, stats: DataFrame,
                   k: int = params.TOP_K, pool: int = params.FUSION_POOL,
                   min_ratings: int = params.MIN_CANDIDATE_RATINGS) -> DataFrame:
    return _top_picks_from(cf_candidates(seeds, sim, pool),
                           semantic_candidates(seeds, vectors, pool), stats, k, min_ratings)


def catalogue(stats: DataFrame, enriched: DataFrame) -> DataFrame:
    """What is shown of each book, one row per isbn known to either table.

    Stored once, it makes attaching a single join of two scanned sides, which
    AQE can split when one book is on very many lists.
    """
    facts = stats.select("isbn", "title", "author", "rating_count", "bayesian_rating")
    return facts.join(enriched.select("isbn", "description", "subjects"), "isbn", "full")


def attach_metadata(lists: DataFrame, books: DataFrame, strategy: str | None = None) -> DataFrame:
    """Recommendation rows with the ``catalogue``; what is unknown becomes empty or 0."""
    if strategy is not None:
        lists = lists.withColumn("strategy", F.lit(strategy))
    empty = F.lit("")
    return lists.join(books, "isbn", "left").select(
        "seed_isbn", "strategy", "rank", "isbn", scores.published(F.col("score")).alias("score"),
        F.coalesce("title", empty).alias("title"), F.coalesce("author", empty).alias("author"),
        F.coalesce("description", empty).alias("description"),
        F.coalesce("subjects", empty).alias("subjects"),
        F.coalesce("rating_count", F.lit(0)).alias("rating_count"),
        F.coalesce("bayesian_rating", F.lit(0.0)).alias("bayesian_rating"))


@dataclass(frozen=True)
class Artefacts:
    """The stored feature tables that recommendations are read from. What has these names serves as well, so a table
    may be made when it is first asked for."""

    similarity: DataFrame
    vectors: DataFrame
    stats: DataFrame
    dominant: DataFrame
    top_books: DataFrame
    catalogue: DataFrame


def _lists(name: str, seeds: DataFrame, art: Artefacts, k: int) -> DataFrame:
    if name == "readers_also":
        return readers_also_list(seeds, art.similarity, k)
    if name == "hidden_gems":
        return hidden_gems_list(seeds, art.similarity, art.stats, k)
    if name == "similar_themes":
        return similar_themes_list(seeds, art.vectors, art.stats, k)
    if name == "same_author":
        return same_author_list(seeds, art.stats, k)
    if name == "age_group":
        return age_group_list(seeds, art.dominant, art.top_books, k)
    if name == "top_picks":
        return top_picks_list(seeds, art.similarity, art.vectors, art.stats, k)
    raise KeyError(f"unknown strategy {name!r}, known: {[s[0] for s in params.STRATEGIES]}")


def recommend(seeds: DataFrame, strategy: str, art: Artefacts, k: int = params.TOP_K) -> DataFrame:
    """One strategy by name for a table of seeds (seed_isbn)."""
    return attach_metadata(_lists(strategy, seeds, art, k), art.catalogue, strategy)


def recommend_all(seeds: DataFrame, art: Artefacts, store: Store,
                  k: int = params.TOP_K) -> DataFrame:
    """All strategies, with strategy_order.

    The candidate pools feed several strategies, so they are stored once: per
    seed at most the larger pool of similar books and of nearest vectors.
    """
    pool = store.write(cf_candidates(seeds, art.similarity, max(params.GEM_POOL, k)))
    nearest = store.write(knn(
        art.vectors, seeds, max(params.FUSION_POOL + 1, k + params.EDITION_SPARE)))
    cf = pool.filter(F.col("rank") <= params.FUSION_POOL)
    semantic = _without_seed(nearest, params.FUSION_POOL + 1)
    lists = {
        "readers_also": pool.filter(F.col("rank") <= k).select(*LIST_COLUMNS),
        "hidden_gems": _hidden_gems_from(
            pool.filter(F.col("rank") <= params.GEM_POOL), art.stats, k),
        "similar_themes": _similar_themes_from(nearest, art.stats, k),
        "same_author": same_author_list(seeds, art.stats, k),
        "age_group": age_group_list(seeds, art.dominant, art.top_books, k),
        "top_picks": _top_picks_from(cf, semantic, art.stats, k),
    }
    named = [lists[name].withColumn("strategy", F.lit(name)) for name, _, _ in params.STRATEGIES]
    rows = attach_metadata(reduce(DataFrame.unionByName, named), art.catalogue)
    names = F.array(*[F.lit(name) for name, _, _ in params.STRATEGIES])
    return rows.withColumn("strategy_order", F.array_position(names, F.col("strategy")).cast("int"))


def strategies(spark: SparkSession) -> DataFrame:
    rows = [(order, *row) for order, row in enumerate(params.STRATEGIES, 1)]
    return spark.createDataFrame(
        rows, "strategy_order int, strategy string, label string, strategy_description string")
