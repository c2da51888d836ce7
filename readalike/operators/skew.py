"""Joins of many rows per key with one row per key.

When the one-row side is an aggregate it arrives without a shuffle of its own,
and AQE does not split a join it cannot re-read on both sides. So the hot keys
are taken apart here: a key with more rows than 1 / n of the table is hot, where n is the number
of shuffle partitions, at least HOT_SHARE. There are fewer than n such keys, and their few rows
are broadcast. The other keys are joined as usual; none has more rows than a partition's
even share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readalike import params


def hot_keys(df: DataFrame, keys: list[str], share: int | None = None) -> DataFrame:
    """Keys that hold more than 1 / ``share`` of the rows: fewer than ``share`` of them."""
    if share is None:
        share = max(params.HOT_SHARE, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") * share > total).select(*keys)


def join_per_key(df: DataFrame, per_key: DataFrame, key: str | list[str],
                 how: str = "inner") -> DataFrame:
    """``df`` joined (inner or left_semi) with a table of one, or few, rows per key.

    ``df`` is read for the hot keys, their rows and the rest, so it should be a
    stored table or a cheap plan.
    """
    keys = [key] if isinstance(key, str) else key
    hot = F.broadcast(hot_keys(df, keys))
    hot_rows = F.broadcast(per_key.join(hot, keys, "left_semi"))
    cold = df.join(hot, keys, "left_anti")
    return df.join(hot_rows, keys, how).unionByName(cold.join(per_key, keys, how))
