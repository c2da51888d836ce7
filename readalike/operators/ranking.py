"""Top rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group, numbered from 1.

    The ``rank <= k`` filter right above ``row_number`` makes Spark keep at most
    ``k`` rows per group in every task before the shuffle, so a hot group
    reaches its final task already cut down.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def at_most(df: DataFrame, n: int) -> bool:
    """Size check before a plan that is only good for few rows."""
    return df.limit(n + 1).count() <= n


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition ahead of a join that multiplies rows.

    Twice the usual number of partitions, as each makes far more rows than it
    reads. A number that is named, and differs from the usual one, is not
    coalesced by input bytes. Only for keys whose groups are bounded.
    """
    partitions = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)
