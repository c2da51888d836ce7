"""Raw CSV files, processed parquet tables and the parquet sink."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw header -> (column name, type)
RAW_COLUMNS = {
    "books": (
        ("ISBN", "isbn", T.StringType()),
        ("Book-Title", "title", T.StringType()),
        ("Book-Author", "author", T.StringType()),
        ("Year-Of-Publication", "year", T.StringType()),
        ("Publisher", "publisher", T.StringType()),
        ("Image-URL-S", "image_url_s", T.StringType()),
        ("Image-URL-M", "image_url_m", T.StringType()),
        ("Image-URL-L", "image_url_l", T.StringType()),
    ),
    "ratings": (
        ("User-ID", "user_id", T.IntegerType()),
        ("ISBN", "isbn", T.StringType()),
        ("Book-Rating", "rating", T.IntegerType()),
    ),
    "users": (
        ("User-ID", "user_id", T.IntegerType()),
        ("Location", "location", T.StringType()),
        ("Age", "age", T.StringType()),
    ),
}

CSV_OPTIONS = {
    "sep": ",",
    "quote": '"',
    "escape": "\\",
    "encoding": "ISO-8859-1",
    "header": "true",
    "mode": "PERMISSIVE",
}


def raw_schema(kind: str) -> T.StructType:
    return T.StructType([T.StructField(header, dtype) for header, _, dtype in RAW_COLUMNS[kind]])


def read_raw(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Scan a raw CSV with its explicit schema and rename to snake_case."""
    names = [name for _, name, _ in RAW_COLUMNS[kind]]
    return spark.read.options(**CSV_OPTIONS).schema(raw_schema(kind)).csv(path).toDF(*names)


def load_processed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books, ratings and users written by ``plans.build.ingest``."""
    return tuple(spark.read.parquet(f"{folder}/{name}.parquet")
                 for name in ("books", "ratings", "users"))


def save(df: DataFrame, path: str) -> int:
    """Overwrite a parquet table; the row count is observed during the write."""
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return rows.get["n"]


_FOREIGN = re.compile(r"[^\x00-\x7f]")
_EDGES = re.compile(r'^\s*"*\s*|\s*"*\s*$')


def repair_header(name: str) -> str:
    """A header's ASCII characters without the spaces and quotes around them."""
    return _EDGES.sub("", _FOREIGN.sub("", name))


def repair_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[repair_header(name) for name in df.columns])


def find_column(df: DataFrame, part: str) -> str:
    """First column whose name contains ``part``, ignoring case."""
    for name in df.columns:
        if part.lower() in name.lower():
            return name
    raise ValueError(f"no column contains {part!r}: {df.columns}")


def coerce_numeric(df: DataFrame, col: str) -> DataFrame:
    """Column to whole numbers; rows where that fails are dropped."""
    number: Column = F.col(f"`{col}`").cast("string").try_cast("double")
    finite = ~F.isnan(number)
    return df.withColumn(col, F.when(finite, number)).dropna(subset=[f"`{col}`"]).withColumn(
        col, F.col(f"`{col}`").try_cast("int"))


def read_repaired(spark: SparkSession, path: str, numeric: tuple[str, ...] = ()) -> DataFrame:
    """A CSV whose headers are damaged, all columns as text; columns whose name contains a part
    of ``numeric`` become whole numbers, and rows where that fails are dropped."""
    df = repair_headers(spark.read.options(**CSV_OPTIONS).csv(path))
    for part in numeric:
        df = coerce_numeric(df, find_column(df, part))
    return df


def write_raw(df: DataFrame, path: str, kind: str, damage: str = "{}") -> None:
    """CSV with raw headers, each put into ``damage``; columns that ``df`` lacks are empty."""
    columns = [(F.col(name) if name in df.columns else F.lit(None)).cast("string").alias(damage.format(header))
               for header, name, _ in RAW_COLUMNS[kind]]
    options = CSV_OPTIONS | {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.select(*columns).write.mode("overwrite").options(**options).csv(path)
