"""Numbers in place of isbns where rows are paired.

Pairing makes far more rows than there are items. Two longs as the grouping key
are narrower in the shuffle than two strings and use the primitive hash map of
the aggregate. The dense index follows isbn order, so ``<`` and the final
tie-break mean the same on either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readalike.sources.store import Store


def item_index(store: Store, books: DataFrame) -> DataFrame:
    """Dense 0-based position of each isbn in sorted order.

    Range partitions are in order between each other; the partition number is
    stored with the row, so counts and positions see the same partitions.
    """
    placed = store.write(
        books.select("isbn").distinct().repartitionByRange("isbn")
        .withColumn("part", F.spark_partition_id()))
    # one row per partition, so the running total has few rows
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    position = F.row_number().over(Window.partitionBy("part").orderBy("isbn")) - 1
    return (
        placed.withColumn("position", position)
        .join(F.broadcast(offsets), "part")
        .select("isbn", (F.col("offset") + F.col("position")).alias("idx"))
    )


def covering_index(index: DataFrame | None, items: DataFrame) -> DataFrame | None:
    """``index`` if it numbers every isbn of ``items``, else a new index of all of them: the
    numbers are an encoding, so what they cover must not decide a result."""
    if index is None or items.select("isbn").join(index, "isbn", "left_anti").isEmpty():
        return index
    store = Store(items.sparkSession)
    every = items.select("isbn").unionByName(index.select("isbn"))
    return store.write(item_index(store, every))


def to_ids(df: DataFrame, index: DataFrame | None, *cols: str) -> DataFrame:
    """Replace each isbn column by its position in ``index`` (isbn, idx)."""
    for col in cols if index is not None else ():
        named = index.select(F.col("isbn").alias(col), F.col("idx").alias("_idx"))
        df = df.join(named, col).drop(col).withColumnRenamed("_idx", col)
    return df


def to_isbns(df: DataFrame, index: DataFrame | None, *cols: str) -> DataFrame:
    """The way back, on the few rows that are left."""
    for col in cols if index is not None else ():
        named = index.select(F.col("idx").alias(col), F.col("isbn").alias("_isbn"))
        df = df.join(named, col).drop(col).withColumnRenamed("_isbn", col)
    return df
