"""Score rules and their presentation as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INFINITY = float("inf")


def robustness(normal: Column, disrupted: Column, clip: bool = True) -> Column:
    """normal / disrupted in [0, 1]; 0 where the disrupted way is missing or infinite; 1 where it has no length."""
    ratio = normal / F.nullif(disrupted, F.lit(0.0))
    zero = F.lit(1.0) if clip else F.when(normal == 0, F.lit(1.0)).otherwise(F.lit(INFINITY))
    return F.when(disrupted.isNull() | (disrupted == INFINITY), F.lit(0.0)).when(disrupted == 0, zero).otherwise(F.least(F.lit(1.0), ratio) if clip else ratio)


def color(score: Column) -> Column:
    """rgb(red,green,0) from red (0) over yellow to green (1)."""
    channel = lambda c: F.least(F.lit(255.0), c * 510).cast("string")
    return F.concat(F.lit("rgb("), channel(1 - score), F.lit(","), channel(score), F.lit(",0)"))


def bucket(score: Column) -> Column:
    """1 (score 0), 2 (to a quarter), 3 (under three quarters), 4 (under one), 5 (one)."""
    return F.when(score == 0, 1).when(score <= 0.25, 2).when(score < 0.75, 3).when(score < 1, 4).otherwise(5)


def heat_weight(score: Column) -> Column:
    return 1 - score
