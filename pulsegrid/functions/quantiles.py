"""Quantiles with linear interpolation between the points (i - 0.5) / n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def midpoint_quantile(sorted_values: Column, p: float | Column) -> Column:
    """Quantile of a sorted array without missing values."""
    n = F.size(sorted_values)
    prob = F.lit(p) if isinstance(p, float) else p
    pos = F.least(F.greatest(n * prob + 0.5, F.lit(1.0)), n.cast("double"))
    low = F.floor(pos).cast("int")
    high = F.ceil(pos).cast("int")
    a = F.get(sorted_values, low - 1)
    b = F.get(sorted_values, high - 1)
    return F.when(n > 0, a + (pos - low) * (b - a))


def grouped_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """One row per group with one column per probability, by ranks rather than by collected lists.

    Each probability needs the two order statistics around its position, so only rank numbers and
    conditional maxima are aggregated. ``weight`` counts how often a row occurs.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    ranked = df.where(F.col(value).isNotNull()).withColumn("_w", w).withColumns(
        {
            "_to": F.sum("_w").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)),
            "_n": F.sum("_w").over(group),
        }
    )
    aggs = []
    for name, p in probs.items():
        pos = F.least(F.greatest(F.col("_n") * p + 0.5, F.lit(1.0)), F.col("_n").cast("double"))
        holds = lambda rank: (F.col("_to") >= rank) & (F.col("_to") - F.col("_w") < rank)
        low = F.max(F.when(holds(F.floor(pos)), F.col(value)))
        high = F.max(F.when(holds(F.ceil(pos)), F.col(value)))
        share = F.max(pos - F.floor(pos))
        aggs.append((low + share * (high - low)).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
