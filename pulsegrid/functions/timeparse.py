"""Column-wise date parsing: the format with the fewest failures wins for the whole column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Accepted text formats, in order of preference.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
    "dd-MMM-yyyy",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "MM/dd/yyyy HH:mm",
    "dd-MMM-yyyy HH:mm",
)
DATETIME_FORMATS = (
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy HH:mm:ss",
    "dd-MMM-yyyy HH:mm",
    "dd-MMM-yyyy HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
    "dd-MMM-yyyy",
)
SERIAL_ORIGIN = "1899-12-30"


def read_as(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(F.trim(text), F.lit(fmt)).cast("timestamp_ntz")


def best_format(df: DataFrame, column: str, formats: tuple[str, ...]) -> str:
    """One pass over the column; ties go to the earlier format."""
    counts = df.agg(
        *[F.count_if(read_as(F.col(column), f).isNull()).alias(str(i)) for i, f in enumerate(formats)]
    ).first()
    failures = [counts[str(i)] or 0 for i in range(len(formats))]
    return formats[failures.index(min(failures))]


def best_formats(df: DataFrame, columns: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """The format of each column with the fewest failures, of all columns in one pass; ties go to the earlier format."""
    if not columns:
        return {}
    counts = df.agg(*[F.count_if(read_as(F.col(c), f).isNull()).alias(f"{n}_{i}") for n, (c, fs) in enumerate(columns.items()) for i, f in enumerate(fs)]).first()
    return {c: fs[min(range(len(fs)), key=lambda i: (counts[f"{n}_{i}"], i))] for n, (c, fs) in enumerate(columns.items())}


def _parse(df: DataFrame, column: str, formats: tuple[str, ...]) -> Column:
    kind = dict(df.dtypes)[column]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.col(column).cast("timestamp_ntz")
    if kind != "string":
        serial = F.col(column).cast("double")
        whole = F.floor(serial)
        seconds = F.round((serial - whole) * 86400).cast("int")
        midnight = F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), whole.cast("int")).cast("timestamp_ntz")
        return F.timestamp_add("SECOND", seconds, midnight)
    return read_as(F.col(column), best_format(df, column, formats))


def parse_datetimes(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _parse(df, c, DATETIME_FORMATS) for c in columns})


def parse_dates(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.to_date(_parse(df, c, DATE_FORMATS)) for c in columns})
