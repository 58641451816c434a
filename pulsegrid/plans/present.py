"""Result tables in plain types: rounded doubles, text dates, long integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

DIGITS = 6


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Select and normalise columns so that equal results are equal values on any engine."""
    df = df.select(*columns) if columns else df
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
