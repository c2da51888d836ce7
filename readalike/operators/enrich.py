"""Metadata around the fetch of descriptions and subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readalike import params
from readalike.functions.text import is_blank, title_by_author
from readalike.sources.store import Store

NO_SUBJECTS = "array<string>"


def _no_subjects() -> Column:
    return F.array().cast(NO_SUBJECTS)


def missing_keys(books: DataFrame, cache: DataFrame) -> DataFrame:
    return books.select("isbn").join(cache.select("isbn"), "isbn", "left_anti")


def fetch_plan(index: DataFrame, batch: int = params.FETCH_BATCH_KEYS,
               wave: int = params.FETCH_WAVE_BATCHES) -> DataFrame:
    """Requests of up to ``batch`` keys in isbn order, ``wave`` requests at a time.

    ``index`` is the dense (isbn, idx) table of the keys to fetch.
    """
    batch_id = F.floor(F.col("idx") / batch)
    keys = F.array_sort(F.collect_list(F.concat(F.lit("ISBN:"), F.col("isbn"))))
    return (
        index.withColumn("batch_id", batch_id).groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("n_keys"), F.array_join(keys, ",").alias("bibkeys"))
        .select("batch_id", F.floor(F.col("batch_id") / wave).alias("wave"), "n_keys", "bibkeys")
    )


def parse_description(entry: Column) -> Column:
    """Of a parsed entry: a plain string, or the ``value`` of an object, else empty."""
    plain = F.try_variant_get(entry, "$.description", "string")
    inner = F.try_variant_get(entry, "$.description.value", "string")
    kind = F.schema_of_variant(F.try_variant_get(entry, "$.description", "variant"))
    return F.coalesce(F.when(kind.startswith("OBJECT"), inner).otherwise(plain), F.lit(""))


def parse_subjects(payload: Column) -> Column:
    """Names of the subjects; entries without a name are skipped."""
    entry = F.from_json(payload, "subjects array<struct<name:string>>")
    names = F.transform(entry["subjects"], lambda s: s["name"])
    return F.coalesce(F.filter(names, lambda n: n.isNotNull()), _no_subjects())


def parse_metadata(responses: DataFrame) -> DataFrame:
    """(isbn, payload) to (isbn, description, subjects)."""
    parsed = responses.withColumn("entry", F.try_parse_json("payload"))
    return parsed.select("isbn", parse_description(F.col("entry")).alias("description"),
                         parse_subjects(F.col("payload")).alias("subjects"))


def parse_batches(plan: DataFrame, responses: DataFrame) -> DataFrame:
    """(isbn, description, subjects) of every planned key.

    ``responses`` has (batch_id, payload): the payload maps ``ISBN:x`` to an entry. A key that it
    lacks is empty, and so are all keys of a batch whose response is missing or unreadable.
    """
    keys = plan.select("batch_id", F.explode(F.split("bibkeys", ",")).alias("key"))
    entries = responses.select("batch_id", F.from_json("payload", "map<string,string>").alias("entries"))
    answered = keys.join(entries, "batch_id", "left").select(
        F.substring("key", 6, 1 << 20).alias("isbn"), F.col("entries")[F.col("key")].alias("payload"))
    return parse_metadata(answered)


def with_failed_defaults(keys: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every key; those without a parsed answer are empty."""
    return keys.select("isbn").join(parsed, "isbn", "left").select(
        "isbn", F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("subjects", _no_subjects()).alias("subjects"))


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """New entries win."""
    return cache.join(new.select("isbn"), "isbn", "left_anti").unionByName(new)


def _bucketed(entries: DataFrame, buckets: int) -> DataFrame:
    return entries.select("isbn", "description", "subjects", F.pmod(F.xxhash64("isbn"), F.lit(buckets)).cast("int").alias("bucket"))


def write_cache(entries: DataFrame, path: str, buckets: int = params.CACHE_BUCKETS) -> None:
    """Store a metadata cache (isbn, description, subjects), a folder for each of ``buckets`` hashes of the isbn."""
    _bucketed(entries, buckets).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    schema = "isbn string, description string, subjects array<string>, bucket int"
    return spark.read.schema(schema).parquet(path)


def upsert_cache_table(spark: SparkSession, path: str, new: DataFrame, store: Store,
                       buckets: int = params.CACHE_BUCKETS) -> DataFrame:
    """Upsert into the cache that ``write_cache`` stored with as many ``buckets``; returns it without its buckets.

    Only folders with a new isbn are read and replaced. Their new contents are written aside first, so a run that breaks
    off before the last step leaves the cache as it was; the folders are then replaced as the last job commits.
    """
    fresh = store.write(_bucketed(new, buckets))
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]   # at most ``buckets``
    kept = read_cache(spark, path).filter(F.col("bucket").isin(touched)).select(*fresh.columns)
    merged = store.write(upsert_cache(kept, fresh))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket").parquet(path)
    return read_cache(spark, path).drop("bucket")


def enrich_books(books: DataFrame, metadata: DataFrame) -> DataFrame:
    """(isbn, title, author, description, subjects), subjects comma-joined.

    Left join, so a book whose fetch failed gets the fallback description. Texts of other isbns leave before it.
    """
    found = metadata.select("isbn", "description", "subjects").join(books.select("isbn"), "isbn", "left_semi")
    fallback = title_by_author(F.col("title"), F.col("author"))
    kept = F.slice(F.coalesce("subjects", _no_subjects()), 1, params.MAX_SUBJECTS)
    return books.select("isbn", "title", "author").join(found, "isbn", "left").select(
        "isbn", "title", "author",
        F.when(~is_blank(F.col("description")), F.col("description")).otherwise(fallback)
        .alias("description"),
        F.array_join(kept, ", ").alias("subjects"))


def description_coverage(enriched: DataFrame) -> DataFrame:
    """Percentage of books whose description is longer than a fallback."""
    real = F.length("description") > params.REAL_DESCRIPTION_CHARS
    return enriched.agg(
        F.count(F.lit(1)).alias("n_books"),
        (F.count_if(real) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("coverage_pct"))
