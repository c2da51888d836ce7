"""Score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readalike import params


def settle(score: Column) -> Column:
    """Nine decimals, so that summation order cannot decide a ranking."""
    return F.round(score, 9)


def published(score: Column) -> Column:
    return F.round(score, 6)


def bayesian_average(votes: Column, mean: Column, credible: Column, prior: Column) -> Column:
    """Weighted mean of an item's own mean and the overall mean."""
    return (votes / (votes + credible)) * mean + (credible / (votes + credible)) * prior


def gem_score(similarity: Column, rating_count: Column) -> Column:
    """Similarity divided by the log of popularity; null when nobody rated."""
    return settle(similarity / F.nullif(F.log(1.0 + rating_count), F.lit(0.0)))


def linear_fusion(cf: Column, semantic: Column, alpha: float = params.FUSION_ALPHA) -> Column:
    return alpha * F.coalesce(cf, F.lit(0.0)) + (1 - alpha) * F.coalesce(semantic, F.lit(0.0))


def rrf_bonus(cf_rank: Column, semantic_rank: Column) -> Column:
    """Reciprocal-rank bonus for items found by both lists, else 0."""
    k = params.RRF_CONSTANT
    both = cf_rank.isNotNull() & semantic_rank.isNotNull()
    return F.when(both, 1.0 / (k + cf_rank) + 1.0 / (k + semantic_rank)).otherwise(0.0)


def popularity_penalty(score: Column, rating_count: Column) -> Column:
    """Divide by the log of weighted popularity; null when nobody rated."""
    return score / F.nullif(F.log(1.0 + params.POPULARITY_WEIGHT * rating_count), F.lit(0.0))


def min_max(score: Column, low: Column, high: Column) -> Column:
    """Scale to 0..1; a list of equal scores becomes 1.0."""
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))
