"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readalike.llm import (
    decontaminate,
    html_text,
    mixing,
    near_dedup,
    ngram_join,
    quality,
    spelling,
    token_counts,
    toxicity,
    training_order,
    url_filter,
    warc_zip,
    whitening,
)
from readalike.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_verdicts(docs, quality.gram_ratios(docs, table(spark, sf_dir, "labels")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), Store(spark))
    return classes.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"), Store(spark))
    return plan.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * F.col("n_copies")).alias("taken"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scores(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"), Store(spark))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file())


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return training_order.read_shards(training_order.write_shards(docs, Store(spark), tokenizer_file()))


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_zip.write_packages(table(spark, sf_dir, "pages"), Store(spark))
    records = warc_zip.read_records(warc_zip.record_ranges(manifest))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), Store(spark))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), Store(spark))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), Store(spark))


def registered() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_quality_rules, op2_decontaminate, op3_near_duplicates, op4_main_text,
        op5_mix_sources, op6_toxicity, op7_url_filter, op8_token_counts, op9_training_order, op10_warc_zip,
        op11_ngram_join, op12_spelling_variants, op13_embedding_whitening)}
