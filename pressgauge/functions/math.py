"""Ratios, weights and the risk formula."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def effective_weight(dup_weight: Column, region_spread: Column) -> Column:
    return dup_weight / F.sqrt(F.greatest(F.coalesce(region_spread, F.lit(1)), F.lit(1)).cast("double"))


def posterior_share(n: Column, total: Column, prior: Column, strength: float) -> Column:
    return (n + prior * F.lit(strength)) / (total + F.lit(strength))


def support(total: Column, k: float) -> Column:
    return F.sqrt(total / (total + F.lit(k)))


def positive(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def clip(value: Column, bound: float) -> Column:
    return F.least(F.greatest(value, F.lit(-bound)), F.lit(bound))


def zscore(value: Column, mean: Column, std: Column, bound: float) -> Column:
    """0 where the spread is missing or zero."""
    return F.when(std > 0, clip((value - mean) / std, bound)).otherwise(F.lit(0.0))
