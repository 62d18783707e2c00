"""Pooled statistics of scores by clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.operators.pairing import KEYS


def long(scores: DataFrame, props: list[str] | None = None, nulls: bool = False) -> DataFrame:
    """clip_id, frame_no, prop, value. Only floating columns whose names do not begin with _."""
    names = [c for c, t in scores.dtypes if c not in KEYS and t in ("double", "float") and not c.startswith("_") and (props is None or c in props)]
    if not names:
        return scores.select(*KEYS, F.lit(None).cast("string").alias("prop"), F.lit(None).cast("double").alias("value")).limit(0)
    every = scores.unpivot(list(KEYS), names, "prop", "value")
    return every if nulls else every.where("value is not null")


def statistics(value: str = "value") -> list[Column]:
    """min, max, mean and the shifted harmonic mean n / sum(1 / (v + 1)) - 1, which is NaN unless
    every value is above -1. Nulls are no values; of none, all four are NaN."""
    v, nan = F.col(value), F.lit(float("nan"))
    above = v.isNotNull() & ~F.isnan(v) & (v > -1)
    inverse = F.sum(F.when(above, 1 / (F.when(above, v) + 1)))
    harmonic = F.when(~F.bool_and(F.when(v.isNotNull(), above)), nan).when(inverse == 0, F.lit(float("inf"))).otherwise(F.count(value) / F.when(inverse != 0, inverse) - 1)
    each = {"min": F.min(value), "max": F.max(value), "mean": F.avg(value), "harmonic_mean": harmonic}
    return [F.when(F.count(value) == 0, nan).otherwise(c).alias(n) for n, c in each.items()]


def pooled(scores: DataFrame, props: list[str] | None = None) -> DataFrame:
    """clip_id, prop, min, max, mean, harmonic_mean of a score table; a clip without a value of a score has NaN."""
    return long(scores, props, nulls=True).groupBy("clip_id", "prop").agg(*statistics())


def worst(scores: DataFrame, prop: str, k: int) -> DataFrame:
    """The k frames with the lowest score (a top-k report)."""
    return scores.orderBy(F.col(prop), *KEYS).limit(k)
