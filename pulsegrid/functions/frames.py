"""Small frame helpers: one-row facts, date order without a single task, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def attach_row(df: DataFrame, one_row: DataFrame, name: str = "_s") -> DataFrame:
    """A one-row aggregate as a struct column, by scalar subquery."""
    return df.withColumn(name, one_row.select(F.struct("*")).scalar())


def date_sequence(df: DataFrame, day: str, keys: list[str] | None = None) -> DataFrame:
    """Adds ``seq``, the 1-based position of a row in date order, numbered year by year.

    Years are numbered on their own and shifted by the counts of earlier years.
    """
    keys = keys or []
    rows = df.withColumn("_year", F.year(day))
    per_year = rows.groupBy(*keys, "_year").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_year").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = per_year.select(
        *keys, "_year", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_year").orderBy(day))
    return (
        rows.join(starts, [*keys, "_year"])
        .withColumn("seq", (F.col("_before") + inside).cast("long"))
        .drop("_year", "_before")
    )


def from_previous(
    df: DataFrame, keys: list[str], depth: int, aggregates: list[Column]
) -> DataFrame:
    """Aggregates over the ``depth`` previous rows of each row, by position ``seq``.

    Every row hands its values to the next ``depth`` positions; ``back`` tells how far back a value
    comes from. Rows without predecessors get missing values.
    """
    handed = df.withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(depth)))).withColumn(
        "seq", F.col("seq") + F.col("back")
    )
    return df.join(handed.groupBy(*keys, "seq").agg(*aggregates), [*keys, "seq"], "left")


def total_before(df: DataFrame, keys: list[str], day: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over earlier rows of the group; missing for the first row of the group."""
    rows = df.withColumn("_year", F.year(day))
    past = Window.partitionBy(*keys).orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    years = (
        rows.groupBy(*keys, "_year")
        .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_t"))
        .select(*keys, "_year", F.sum("_t").over(past).alias("_before"))
    )
    inside = F.sum(value).over(
        Window.partitionBy(*keys, "_year").orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    )
    order = F.row_number().over(Window.partitionBy(*keys, "_year").orderBy(day))
    first = (order == 1) & F.col("_before").isNull()
    return (
        rows.join(years, [*keys, "_year"])
        .withColumn(
            name,
            F.when(~first, F.coalesce(F.col("_before"), F.lit(0.0)) + F.coalesce(inside, F.lit(0.0))),
        )
        .drop("_year", "_before")
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
