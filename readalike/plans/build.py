"""The batch builds: raw tables to processed tables to feature tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readalike import params
from readalike.operators import clean, enrich, features, strategies, vectors
from readalike.sources.buckets import read_bucketed, write_bucketed
from readalike.sources.raw import load_processed, read_raw, save
from readalike.sources.store import Store

EDGE_ORDER = ("isbn", "similarity")
# Raw file names
RAW_FILES = {"books": "Books.csv", "ratings": "Ratings.csv", "users": "Users.csv"}


def read_raw_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {kind: read_raw(spark, f"{folder}/{name}", kind) for kind, name in RAW_FILES.items()}


def processed_tables(raw: dict[str, DataFrame], store: Store) -> dict[str, DataFrame]:
    """Books, ratings and users after cleaning.

    Clean ratings (by ``clean_ratings``) and books are stored: each is read by more than one step.
    Users below the minimum after the book restriction are not dropped again.
    """
    ratings = clean.clean_ratings(raw["ratings"], store=store)
    books = store.write(clean.clean_books(raw["books"], ratings))
    return {
        "books": books,
        "ratings": clean.ratings_of_books(ratings, books),
        "users": clean.clean_users(raw["users"]),
    }


def ingest(spark: SparkSession, raw_folder: str, out_folder: str) -> dict[str, int]:
    """CSV folder to processed parquet tables; returns their row counts."""
    tables = processed_tables(read_raw_folder(spark, raw_folder), Store(spark))
    return {name: save(df, f"{out_folder}/{name}.parquet") for name, df in tables.items()}


def build_features(spark: SparkSession, in_folder: str, out_folder: str) -> dict[str, int]:
    """Processed tables to feature tables; returns their row counts.

    The similarity table is laid out in buckets of isbn, by similarity within it, so no strategy
    shuffles it.
    """
    books, ratings, users = load_processed(spark, in_folder)
    counts: dict[str, int] = {}

    def put(name: str, df: DataFrame) -> DataFrame:
        path = f"{out_folder}/{name}.parquet"
        counts[name] = save(df, path)
        return spark.read.parquet(path)

    index = put("item_index", features.item_index(Store(spark), books))
    pairs = put("item_pairs", features.item_similarity(ratings, index=index))
    edges = write_bucketed(features.symmetric_similarity(pairs, books), f"{out_folder}/item_similarity.parquet", *EDGE_ORDER)
    counts["item_similarity"] = edges.count()
    stats = put("book_stats", features.book_stats(books, ratings))
    put("age_group_dominant", features.age_group_dominant(ratings, users))
    put("age_group_top_books", features.age_group_top_books(ratings, users, stats))
    return counts


def metadata_tables(books: DataFrame, cache: DataFrame, fetch: Callable[[DataFrame], DataFrame],
                    store: Store, batch: int = params.FETCH_BATCH_KEYS) -> dict[str, DataFrame]:
    """Metadata of all books: what ``cache`` (isbn, description, subjects) lacks is planned in
    batches, ``fetch`` turns the plan into responses (batch_id, payload), and what they
    hold, or an empty entry, joins the cache."""
    missing = enrich.missing_keys(books, cache)
    plan = store.write(enrich.fetch_plan(features.item_index(store, missing), batch))
    parsed = enrich.with_failed_defaults(missing, enrich.parse_batches(plan, fetch(plan)))
    metadata = store.write(cache.unionByName(parsed))   # no isbn is in both
    enriched = enrich.enrich_books(books, metadata)
    return {"metadata": metadata, "enriched": enriched}


def build_metadata(spark: SparkSession, in_folder: str, cache: DataFrame,
                   fetch: Callable[[DataFrame], DataFrame], out_folder: str) -> dict[str, float]:
    """Processed books to the metadata cache and the enriched table; returns row counts and the
    percentage of books with a real description."""
    books = load_processed(spark, in_folder)[0]
    tables = metadata_tables(books, cache, fetch, Store(spark))
    counts: dict[str, float] = {
        name: save(df, f"{out_folder}/{name}.parquet") for name, df in tables.items()}
    coverage = enrich.description_coverage(spark.read.parquet(f"{out_folder}/enriched.parquet"))
    return counts | {"coverage_pct": coverage.first()["coverage_pct"]}


def build_vectors(spark: SparkSession, folder: str, dim: int = params.EMBEDDING_DIM,
                  encoder: Callable | None = None, make_encoder: Callable | None = None) -> dict[str, int]:
    """Enriched table to unit vectors, checked before they are kept, and the catalogue that
    recommendations get their columns from."""
    enriched, stats = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("enriched", "book_stats"))
    encoded = Store(spark).write(vectors.encode(
        vectors.embedding_text(enriched), encoder=encoder, dim=dim, make_encoder=make_encoder))
    return {"book_embeddings": save(vectors.check_dim(encoded, dim), f"{folder}/book_embeddings.parquet"),
            "catalogue": save(strategies.catalogue(stats, enriched), f"{folder}/catalogue.parquet")}


def artefacts(spark: SparkSession, folder: str) -> strategies.Artefacts:
    """What ``strategies.recommend`` needs, from a folder that the builds have filled."""
    names = ("item_similarity", "book_embeddings", "book_stats", "age_group_dominant",
             "age_group_top_books", "catalogue")
    tables = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names[1:]}
    return strategies.Artefacts(read_bucketed(spark, f"{folder}/item_similarity.parquet", *EDGE_ORDER), *tables.values())


def build_all(spark: SparkSession, raw_folder: str, processed_folder: str, folder: str, cache: DataFrame,
              fetch: Callable[[DataFrame], DataFrame], dim: int = params.EMBEDDING_DIM, encoder: Callable | None = None,
              make_encoder: Callable | None = None) -> dict[str, dict[str, float]]:
    """Every stage from the CSV folder on: cleaned tables, features, metadata, vectors. Returns what each reports; then
    ``artefacts(spark, folder)`` has all that recommendations need."""
    return {
        "ingest": dict(ingest(spark, raw_folder, processed_folder)),
        "features": dict(build_features(spark, processed_folder, folder)),
        "metadata": build_metadata(spark, processed_folder, cache, fetch, folder),
        "vectors": dict(build_vectors(spark, folder, dim, encoder, make_encoder)),
    }
