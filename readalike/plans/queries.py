"""Registered queries: one per operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readalike import params
from readalike.functions import scores
from readalike.functions.titles import is_edition
from readalike.operators import (
    baselines, clean, enrich, explore, features, lookup, pairs, strategies, vectors)
from readalike.plans import build
from readalike.plans.workspace import Workspace, workspace
from readalike.sources import raw

Query = Callable[[Workspace], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(workspace(spark, sf_dir))

    return {name: bind(fn) for name, fn in QUERIES.items()}


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: scores.settle(F.col(c)) for c in cols})


# sources and sinks

def _csv(w: Workspace, kind: str) -> DataFrame:
    """A raw table written as CSV with raw headers and read back."""
    view, path = w.raw(f"raw_{kind}"), w.store.folder(f"csv-{kind}")
    raw.write_raw(view, path, kind)
    return raw.read_raw(w.spark, path, kind).select(*view.columns)


@query("csv_books")
def _(w: Workspace) -> DataFrame:
    return _csv(w, "books")


@query("csv_ratings")
def _(w: Workspace) -> DataFrame:
    return _csv(w, "ratings")


@query("csv_users")
def _(w: Workspace) -> DataFrame:
    return _csv(w, "users")


@query("csv_damaged_headers")
def _(w: Workspace) -> DataFrame:
    """Users under headers with foreign bytes, quotes and spaces; ages that are no numbers go."""
    path = w.store.folder("csv-damaged")
    raw.write_raw(w.raw("raw_users"), path, "users", '\xef\xbb\xbf "{}" ')
    return raw.read_repaired(w.spark, path, ("user", "AGE")).toDF("user_id", "location", "age")


@query("processed_tables")
def _(w: Workspace) -> DataFrame:
    """Rows that the sink counts while it writes, and rows that are read back."""
    folder = w.store.folder("processed")
    saved = {name: raw.save(getattr(w, name), f"{folder}/{name}.parquet") for name in ("books", "ratings", "users")}
    loaded = dict(zip(saved, raw.load_processed(w.spark, folder), strict=True))
    return _stack({name: df.agg(F.count(F.lit(1)).alias("loaded")).withColumn("saved", F.lit(saved[name]).cast("long"))
                   for name, df in loaded.items()})


@query("built_features")
def _(w: Workspace) -> DataFrame:
    """Rows of every feature table after a build from stored tables, and the sum of its values."""
    folder, out = w.store.folder("processed"), w.store.folder("features")
    for name in ("books", "ratings", "users"):
        raw.save(getattr(w, name), f"{folder}/{name}.parquet")
    built = build.build_features(w.spark, folder, out)
    values = {"item_index": F.col("idx"), "item_pairs": F.col("similarity") * 1e9, "item_similarity": F.col("similarity") * 1e9,
              "book_stats": F.round("bayesian_rating", 9) * 1e6, "age_group_dominant": F.col("age_group_count"),
              "age_group_top_books": F.round("bayesian_rating", 9) * 1e6}
    return _stack({name: w.spark.read.parquet(f"{out}/{name}.parquet").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(values[name]).cast("long")).alias("total")) for name in built})


@query("stage_counts")
def _(w: Workspace) -> DataFrame:
    raw = {t: w.raw(f"raw_{t}") for t in ("books", "ratings", "users")}
    return clean.stage_counts(raw, {"books": w.books, "ratings": w.ratings, "users": w.users})


@query("item_index")
def _(w: Workspace) -> DataFrame:
    return features.item_index(w.store, w.books)


@query("symmetric_similarity")
def _(w: Workspace) -> DataFrame:
    return features.symmetric_similarity(w.pairs, w.books)


# cleaning

@query("dedupe_ratings")
def _(w: Workspace) -> DataFrame:
    return clean.dedupe_ratings(w.raw("raw_ratings"))


@query("explicit_ratings")
def _(w: Workspace) -> DataFrame:
    return clean.explicit_ratings(w.raw("raw_ratings"))


@query("min_ratings_per_user")
def _(w: Workspace) -> DataFrame:
    return clean.min_ratings_per_user(w.raw("raw_ratings"))


@query("min_ratings_per_user_30")
def _(w: Workspace) -> DataFrame:
    return clean.min_ratings_per_user(w.raw("raw_ratings"), 30)


@query("normalize_books")
def _(w: Workspace) -> DataFrame:
    return clean.normalize_text(clean.normalize_text(w.raw("raw_books"), "title"), "author")


@query("clean_year")
def _(w: Workspace) -> DataFrame:
    return clean.clean_year(w.raw("raw_books"))


@query("books_with_ratings")
def _(w: Workspace) -> DataFrame:
    return clean.books_with_ratings(w.raw("raw_books"), w.all_ratings)


@query("books_with_top_ratings")
def _(w: Workspace) -> DataFrame:
    return clean.books_with_ratings(
        w.raw("raw_books"), clean.explicit_ratings(w.raw("raw_ratings"), params.MAX_RATING))


@query("min_ratings_per_book")
def _(w: Workspace) -> DataFrame:
    return clean.min_ratings_per_book(w.raw("raw_books"), w.all_ratings)


@query("min_ratings_per_book_25")
def _(w: Workspace) -> DataFrame:
    return clean.min_ratings_per_book(w.raw("raw_books"), w.all_ratings, 25)


@query("dedupe_editions")
def _(w: Workspace) -> DataFrame:
    return clean.dedupe_editions(w.raw("raw_books"), w.all_ratings)


@query("dedupe_editions_by_isbn")
def _(w: Workspace) -> DataFrame:
    return clean.dedupe_editions(w.raw("raw_books"))


@query("clean_age")
def _(w: Workspace) -> DataFrame:
    return clean.clean_age(w.raw("raw_users"))


@query("clean_ratings")
def _(w: Workspace) -> DataFrame:
    return clean.clean_ratings(w.raw("raw_ratings"))


@query("clean_books")
def _(w: Workspace) -> DataFrame:
    return clean.clean_books(w.raw("raw_books"), w.all_ratings)


@query("clean_users")
def _(w: Workspace) -> DataFrame:
    return clean.clean_users(w.raw("raw_users"))


@query("ingest_ratings")
def _(w: Workspace) -> DataFrame:
    return clean.ratings_of_books(w.all_ratings, w.books)


# features

@query("center_ratings")
def _(w: Workspace) -> DataFrame:
    return _round(features.center_ratings(w.ratings), "user_mean", "rating_adj")


@query("item_similarity")
def _(w: Workspace) -> DataFrame:
    return features.item_similarity(w.ratings, index=w.index)


@query("item_similarity_heavy")
def _(w: Workspace) -> DataFrame:
    """The same table by the heavy-user route, which most users exceed at this limit."""
    return features.item_similarity(w.ratings, index=w.index, light_limit=30)


@query("co_rated_pairs")
def _(w: Workspace) -> DataFrame:
    rated = w.ratings.select("user_id", "isbn", F.col("rating").alias("value"))
    return pairs.co_rated_pairs(pairs.RaterSplit(rated, 30))


@query("rating_count_quantile")
def _(w: Workspace) -> DataFrame:
    return features.credibility_m(features.book_rating_stats(w.ratings))


@query("book_stats")
def _(w: Workspace) -> DataFrame:
    return _round(features.book_stats(w.books, w.ratings), "rating_mean", "bayesian_rating")


@query("age_group_counts")
def _(w: Workspace) -> DataFrame:
    return features.age_group_counts(w.ratings, w.users)


@query("age_group_dominant")
def _(w: Workspace) -> DataFrame:
    return features.age_group_dominant(w.ratings, w.users)


@query("age_group_top_books")
def _(w: Workspace) -> DataFrame:
    return _round(features.age_group_top_books(w.ratings, w.users, w.stats), "bayesian_rating")


# metadata

def _joined_subjects(df: DataFrame) -> DataFrame:
    return df.withColumn("subjects", F.array_join("subjects", ", "))


@query("missing_metadata")
def _(w: Workspace) -> DataFrame:
    return enrich.missing_keys(w.books, w.cache())


@query("fetch_plan")
def _(w: Workspace) -> DataFrame:
    missing = enrich.missing_keys(w.books, w.cache())
    return enrich.fetch_plan(features.item_index(w.store, missing))


@query("parse_metadata")
def _(w: Workspace) -> DataFrame:
    return _joined_subjects(enrich.parse_metadata(w.payloads()))


@query("parse_metadata_odd")
def _(w: Workspace) -> DataFrame:
    """Unreadable, empty and partial payloads among whole ones, by the last digit of the isbn."""
    last = F.substring("isbn", -1, 1)
    odd = (F.when(last == "0", "no json").when(last == "2", "{}").when(last == "4", F.lit(None))
           .when(last == "6", '{"description": {"type": "/type/text"}, "subjects": [{"name": "A"}, {"key": 1}]}')
           .when(last == "8", '{"subjects": 5, "description": "plain"}').otherwise(F.col("payload")))
    return _joined_subjects(enrich.parse_metadata(w.payloads().withColumn("payload", odd)))


BATCH_KEYS = 10


def _responses(w: Workspace, plan: DataFrame) -> DataFrame:
    """What a server would answer: isbns that end in 7 are unknown to it, one batch of five has
    no answer, one an answer that is cut off."""
    meta = w.metadata_of_books().filter(~F.col("isbn").endswith("7"))
    names = F.transform(F.split("subjects", ", "), lambda s: F.struct(s.alias("name")))
    entries = meta.select("isbn", F.concat(F.lit('"ISBN:'), "isbn", F.lit('": '), F.to_json(
        F.struct("description", names.alias("subjects")))).alias("entry"))
    keys = plan.select("batch_id", F.explode(F.split("bibkeys", ",")).alias("key"))
    asked = keys.select("batch_id", F.substring("key", 6, 1000).alias("isbn"))
    known = asked.join(entries, "isbn").groupBy("batch_id").agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list("entry"), ", "), F.lit("}")).alias("payload"))
    failed = F.pmod("batch_id", F.lit(5))
    return known.filter(failed != 3).withColumn("payload", F.when(failed == 4, F.expr(
        "substr(payload, 1, length(payload) - 3)")).otherwise(F.col("payload")))


@query("parse_batches")
def _(w: Workspace) -> DataFrame:
    missing = enrich.missing_keys(w.books, w.cache())
    plan = w.store.write(enrich.fetch_plan(features.item_index(w.store, missing), BATCH_KEYS))
    return _joined_subjects(enrich.parse_batches(plan, _responses(w, plan)))


@query("build_metadata")
def _(w: Workspace) -> DataFrame:
    tables = build.metadata_tables(
        w.books, w.store.write(w.cache()), lambda plan: _responses(w, plan), w.store, BATCH_KEYS)
    return tables["enriched"]


@query("failed_defaults")
def _(w: Workspace) -> DataFrame:
    return _joined_subjects(enrich.with_failed_defaults(w.books, w.cache()))


@query("upsert_metadata")
def _(w: Workspace) -> DataFrame:
    fetched = w.metadata.join(w.books.select("isbn"), "isbn", "left_semi")
    path = w.store.folder("metadata_cache")
    enrich.write_cache(w.cache(), path)
    return _joined_subjects(enrich.upsert_cache_table(w.spark, path, fetched, w.store))


@query("enrich_books")
def _(w: Workspace) -> DataFrame:
    return enrich.enrich_books(w.books, w.metadata)


@query("description_coverage")
def _(w: Workspace) -> DataFrame:
    return _round(enrich.description_coverage(w.enriched), "coverage_pct")


# text and vectors

@query("embedding_text")
def _(w: Workspace) -> DataFrame:
    return vectors.embedding_text(w.enriched)


@query("encode_text")
def _(w: Workspace) -> DataFrame:
    """The places of each vector that aren't 0."""
    encoded = vectors.encode(vectors.embedding_text(w.enriched)).select("isbn", F.posexplode("embedding").alias("pos", "value"))
    return encoded.withColumn("value", F.round(F.col("value").cast("double"), 6)).filter("value <> 0")


@query("l2_normalize")
def _(w: Workspace) -> DataFrame:
    unit = vectors.l2_normalize(w.raw("book_embeddings"))
    return unit.select("isbn", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", scores.settle(F.col("value")))


@query("embedding_dim_report")
def _(w: Workspace) -> DataFrame:
    return vectors.dim_report(w.raw("book_embeddings"), 64)


@query("embedding_dim_report_wrong")
def _(w: Workspace) -> DataFrame:
    return vectors.dim_report(w.raw("book_embeddings"), params.EMBEDDING_DIM)


@query("knn_inner_product")
def _(w: Workspace) -> DataFrame:
    items = w.raw("book_embeddings")
    return vectors.knn(items, items.select(F.col("isbn").alias("seed_isbn")), params.TOP_K)


@query("knn_inner_product_blocks")
def _(w: Workspace) -> DataFrame:
    items = w.raw("book_embeddings")
    return vectors.knn(items, items.select(F.col("isbn").alias("seed_isbn")), params.TOP_K,
                       block_bytes=1 << 14, pivots=16, store=w.store)


# strategies

@query("readers_also")
def _(w: Workspace) -> DataFrame:
    return _strategy(w, "readers_also")


@query("hidden_gems")
def _(w: Workspace) -> DataFrame:
    return _strategy(w, "hidden_gems")


@query("similar_themes")
def _(w: Workspace) -> DataFrame:
    return _strategy(w, "similar_themes")


@query("same_author")
def _(w: Workspace) -> DataFrame:
    return _strategy(w, "same_author")


@query("age_group_picks")
def _(w: Workspace) -> DataFrame:
    return _strategy(w, "age_group")


@query("top_picks")
def _(w: Workspace) -> DataFrame:
    return _strategy(w, "top_picks")


def _strategy(w: Workspace, name: str) -> DataFrame:
    return _round(strategies.recommend(w.seeds, name, w.artefacts), "bayesian_rating")


@query("top_picks_25")
def _(w: Workspace) -> DataFrame:
    lists = strategies.top_picks_list(
        w.seeds, w.similarity, w.vectors, w.stats, min_ratings=25)
    return lists.withColumn("score", scores.published(F.col("score")))


@query("edition_pairs")
def _(w: Workspace) -> DataFrame:
    title = {s: w.stats.select(F.col("isbn").alias(f"isbn_{s}"), F.col("title").alias(f"title_{s}"))
             for s in "ab"}
    titled = w.pairs.select("isbn_a", "isbn_b").join(title["a"], "isbn_a").join(title["b"], "isbn_b")
    return titled.filter(is_edition(F.col("title_a"), F.col("title_b")))


@query("minmax_scores")
def _(w: Workspace) -> DataFrame:
    return _round(strategies.minmax_per_list(w.similarity, ["isbn"], "similarity"), "similarity")


@query("rrf_fusion")
def _(w: Workspace) -> DataFrame:
    fused = strategies.fused_candidates(
        strategies.cf_candidates(w.seeds, w.similarity),
        strategies.semantic_candidates(w.seeds, w.vectors), w.stats)
    return fused.select(
        "seed_isbn", "isbn", "cf_rank", "semantic_rank",
        F.round("linear_score", 12).alias("linear_score"),
        F.round("rrf_bonus", 12).alias("rrf_bonus"),
        scores.published(F.col("score")).alias("score"))


# lookups and multi-strategy results

@query("search_books")
def _(w: Workspace) -> DataFrame:
    titles = w.raw("raw_books").select(F.col("title").alias("query"))
    return _round(lookup.search_books(titles, w.title_index), "bayesian_rating")


@query("search_books_by_word")
def _(w: Workspace) -> DataFrame:
    words = w.raw("raw_books").select(F.explode(F.split(F.trim("title"), " ")).alias("query"))
    return _round(lookup.search_books(words.distinct(), w.title_index), "bayesian_rating")


@query("get_books")
def _(w: Workspace) -> DataFrame:
    return _round(lookup.get_books(w.raw("raw_books"), w.stats), "bayesian_rating")


@query("resolve_seeds")
def _(w: Workspace) -> DataFrame:
    raw = w.raw("raw_books")
    nothing = F.lit(None).cast("string")
    requests = raw.select(F.col("isbn").alias("request_isbn"), nothing.alias("request_title")).union(
        raw.select(nothing, F.col("title")).distinct())
    return _round(lookup.resolve_seeds(requests, w.title_index), "bayesian_rating")


@query("recommend_all")
def _(w: Workspace) -> DataFrame:
    return _round(strategies.recommend_all(w.seeds, w.artefacts, w.store), "bayesian_rating")


@query("strategies")
def _(w: Workspace) -> DataFrame:
    used = w.recommendations.groupBy("strategy").agg(
        F.countDistinct("seed_isbn").alias("n_seeds"), F.count(F.lit(1)).alias("n_recommendations"))
    return strategies.strategies(w.spark).join(used, "strategy", "left").fillna(
        0, subset=["n_seeds", "n_recommendations"])


@query("score_percent")
def _(w: Workspace) -> DataFrame:
    return lookup.score_percent(w.recommendations).select(
        "seed_isbn", "strategy", "rank", "isbn", "score", "score_pct")


@query("display_columns")
def _(w: Workspace) -> DataFrame:
    shown = lookup.display_columns(w.recommendations)
    return shown.select("seed_isbn", "strategy", "rank", "isbn", "has_description",
                        F.array_join("tags", "|").alias("tags"))


# query baselines

@query("co_rated_top")
def _(w: Workspace) -> DataFrame:
    return _round(baselines.co_rated_top(w.seeds, w.ratings, table=w.pair_table), "mean_rating")


@query("co_rated_top_few")
def _(w: Workspace) -> DataFrame:
    """The same lists by the lookup route."""
    return _round(baselines.co_rated_top(w.seeds, w.ratings, few=1_000_000_000), "mean_rating")


@query("co_rated_top_heavy")
def _(w: Workspace) -> DataFrame:
    """The same lists by the heavy-user route."""
    return _round(baselines.co_rated_top(
        w.seeds, w.ratings, index=w.index, few=0, limit=30), "mean_rating")


@query("co_rated_gems")
def _(w: Workspace) -> DataFrame:
    return baselines.co_rated_gems(w.seeds, w.ratings, w.stats, table=w.pair_table)


@query("subject_jaccard")
def _(w: Workspace) -> DataFrame:
    return baselines.subject_jaccard(w.seeds, w.enriched, index=w.index, store=w.store)


@query("subject_jaccard_hot_tags")
def _(w: Workspace) -> DataFrame:
    return baselines.subject_jaccard(
        w.seeds, w.enriched, index=w.index, store=w.store, probes=1)


@query("author_or_subject")
def _(w: Workspace) -> DataFrame:
    return baselines.author_or_subject(w.seeds, w.stats, w.enriched)


@query("list_overlap")
def _(w: Workspace) -> DataFrame:
    return baselines.list_overlap(
        strategies.readers_also_list(w.seeds, w.similarity),
        baselines.co_rated_top(w.seeds, w.ratings, table=w.pair_table))


# exploration and reporting

@query("null_counts")
def _(w: Workspace) -> DataFrame:
    tables = {t: explore.null_counts(w.raw(f"raw_{t}")) for t in ("books", "ratings", "users")}
    return _stack(tables)


@query("duplicate_count")
def _(w: Workspace) -> DataFrame:
    tables = {t: explore.duplicate_count(w.raw(f"raw_{t}")) for t in ("books", "ratings", "users")}
    return _stack(tables)


def _stack(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("rating_distribution")
def _(w: Workspace) -> DataFrame:
    return _round(explore.rating_distribution(w.raw("raw_ratings")), "share_pct")


@query("rating_distribution_compare")
def _(w: Workspace) -> DataFrame:
    return explore.rating_distribution_compare(w.raw("raw_ratings"), w.ratings)


@query("cardinalities")
def _(w: Workspace) -> DataFrame:
    return explore.cardinalities(w.raw("raw_ratings"))


@query("long_tail")
def _(w: Workspace) -> DataFrame:
    return _round(explore.long_tail(w.raw("raw_ratings")), "share_pct")


@query("most_rated")
def _(w: Workspace) -> DataFrame:
    return explore.most_rated(w.raw("raw_ratings"), w.raw("raw_books"))


@query("least_rated")
def _(w: Workspace) -> DataFrame:
    return explore.most_rated(w.raw("raw_ratings"), w.raw("raw_books"), asc=True)


@query("best_rated")
def _(w: Workspace) -> DataFrame:
    return _round(explore.best_rated(w.raw("raw_ratings"), w.raw("raw_books")), "mean_rating")


@query("survival_funnel")
def _(w: Workspace) -> DataFrame:
    return explore.survival_funnel(w.raw("raw_books"), w.raw("raw_ratings"))


@query("explore_clean")
def _(w: Workspace) -> DataFrame:
    return explore.explore_clean_report(w.raw("raw_books"), w.explicit_once)


@query("explore_clean_ratings")
def _(w: Workspace) -> DataFrame:
    return explore.explore_clean(w.raw("raw_books"), w.explicit_once)[1]


def _explored_seeds(w: Workspace) -> DataFrame:
    return w.explored[0].select(F.col("isbn").alias("seed_isbn"))


@query("fan_co_reads")
def _(w: Workspace) -> DataFrame:
    return explore.fan_co_reads(_explored_seeds(w), w.explored[1], index=w.explored_index)


@query("fan_co_reads_weighted")
def _(w: Workspace) -> DataFrame:
    return explore.fan_co_reads_weighted(_explored_seeds(w), w.explored[1], index=w.explored_index)


@query("author_by_mean")
def _(w: Workspace) -> DataFrame:
    books, ratings = w.explored
    return _round(explore.author_by_mean(_explored_seeds(w), books, ratings), "mean_rating")


@query("similarity_report")
def _(w: Workspace) -> DataFrame:
    return _round(explore.similarity_report(w.similarity, w.books),
                  "fill_pct", "median_similarity", "mean_similarity")


@query("similarity_histogram")
def _(w: Workspace) -> DataFrame:
    return explore.histogram(w.similarity, "similarity")


@query("long_tail_histogram")
def _(w: Workspace) -> DataFrame:
    return explore.log_histogram(w.raw("raw_ratings"), w.ratings)


@query("dropped_share")
def _(w: Workspace) -> DataFrame:
    return _round(explore.dropped_share(w.raw("raw_ratings"), w.ratings), "dropped_pct")


@query("genre_counts")
def _(w: Workspace) -> DataFrame:
    return explore.genre_counts(w.raw("book_embeddings"), w.enriched)


# Words of the test data's part names; the fixed keywords name none of them.
GOODS = (("Jewellery", ("ring",)), ("Fasteners", ("bolt", "screw")), ("Machines", ("widget", "gizmo", "gear")))


@query("genre_counts_goods")
def _(w: Workspace) -> DataFrame:
    return explore.genre_counts(w.raw("book_embeddings"), w.enriched, GOODS)


@query("sample_items")
def _(w: Workspace) -> DataFrame:
    return explore.sample_items(w.books.select("isbn", "title"), 500)


@query("strategy_table")
def _(w: Workspace) -> DataFrame:
    return explore.strategy_table(w.recommendations, w.seeds, strategies.strategies(w.spark))
