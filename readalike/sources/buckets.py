"""Tables laid out in buckets of one column.

Rows of one key lie in one file, sorted, and Spark knows it: joins, windows and aggregates
on that column read the table without a shuffle of it. The files carry the layout, the session's
catalogue has only to be told, so any later session can read the folder again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from readalike import params


def _table(path: str) -> str:
    return "readalike_" + hashlib.md5(path.encode()).hexdigest()


def write_bucketed(df: DataFrame, path: str, key: str, *order: str, buckets: int = params.EDGE_BUCKETS,
                   dealt: bool = False) -> DataFrame:
    """Store ``df`` at ``path`` in ``buckets`` files of ``key``, sorted by it and ``order``; returns the stored table.

    A key that holds many rows makes its bucket large, and a task that reads it longer; sorted rows of a bucket
    stream, so it is never held whole. ``dealt``: ``df`` is partitioned by ``key`` in ``buckets`` already.
    """
    name = _table(path)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    placed = df if dealt else df.repartition(buckets, key)
    placed.write.mode("overwrite").format("parquet").option("path", path).bucketBy(
        buckets, key).sortBy(key, *order).saveAsTable(name)
    return df.sparkSession.table(name)


def read_bucketed(spark: SparkSession, path: str, key: str, *order: str, buckets: int = params.EDGE_BUCKETS) -> DataFrame:
    """The table that ``write_bucketed`` stored with the same key, order and number."""
    name = _table(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        by = ", ".join(f"`{c}`" for c in (key, *order))
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({by}) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
