"""Raw bar files, their names, and cleaned bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulsegrid import config as C
from pulsegrid.functions import scalars as S

BAR_SCHEMA = (
    "file_name_clean string, Time timestamp_ntz, Open double, High double, Low double, "
    "Latest double, Volume double"
)
FILE_KEYS = [
    "file_name_clean",
    "root_code",
    "expiry_code",
    "contract_year",
    "bar_minutes",
    "download_date",
]


def scan_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, raw_line_no, line) with files split over tasks, whatever their size.

    A task numbers the lines of its own file blocks; the lines of earlier blocks of the same file
    are added from a small table with one row per block. Where the folder has a level ``file_name=...``, as Spark writes
    it, that is the file's name, and its parts are blocks in order.
    """
    text = spark.read.text(path)
    named = F.col("file_name") if "file_name" in text.columns else F.col("_metadata.file_name")
    lines = (
        text.select(
            named.alias("file_name"),
            F.struct(F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("start")).alias("block"),
            F.monotonically_increasing_id().alias("position"),
            F.col("value").alias("line"),
        )
    )
    blocks = lines.groupBy("file_name", "block").agg(
        F.min("position").alias("first_position"), F.count(F.lit(1)).alias("n_lines")
    )
    earlier = Window.partitionBy("file_name").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)))
    return (
        lines.join(blocks.drop("n_lines"), ["file_name", "block"])
        .select(
            "file_name",
            (F.col("before") + F.col("position") - F.col("first_position") + 1).alias("raw_line_no"),
            "line",
        )
    )


def line_bounds(lines: DataFrame) -> DataFrame:
    """Per file: last non-blank line, whether it is the provider footer, header check."""
    last = F.max(
        F.when(F.trim("line") != "", F.struct("raw_line_no", F.trim("line").alias("text")))
    )
    header = F.max(F.when(F.col("raw_line_no") == 1, F.regexp_replace(F.trim("line"), '"', "")))
    return (
        lines.groupBy("file_name")
        .agg(last.alias("last"), header.alias("header"))
        .select(
            "file_name",
            F.coalesce(F.col("last.raw_line_no"), F.lit(0)).alias("last_line_no"),
            S.holds(F.lower("last.text").contains(C.FOOTER_MARK)).alias("footer_present"),
            S.holds(F.lower("header") == C.RAW_HEADER.lower()).alias("header_ok"),
        )
    )


def data_lines(lines: DataFrame) -> DataFrame:
    """Lines between the header and the optional footer; trailing blank lines are dropped."""
    bounds = line_bounds(lines)
    body_end = F.col("last_line_no") - F.col("footer_present").cast("int")
    return (
        lines.join(bounds, "file_name")
        .where((F.col("raw_line_no") > 1) & (F.col("raw_line_no") <= body_end))
        .select("file_name", "raw_line_no", "line")
    )


def split_quoted(line: Column) -> Column:
    """Fields of a quoted CSV line: commas inside quotes do not separate."""
    return F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')


def decode_lines(body: DataFrame) -> DataFrame:
    """Typed fields of each data line; missing where a field does not parse."""
    fields = split_quoted(F.col("line"))
    numeric = {"Open": 1, "High": 2, "Low": 3, "Latest": 4, "Volume": 7}
    text = F.trim(F.regexp_replace(F.get("fields", F.lit(0)), '"', ""))
    plain = lambda i: F.trim(F.regexp_replace(F.get("fields", F.lit(i)), '[,%"]', ""))
    # Separate selects keep every field decoded once instead of once per use.
    read = body.withColumn("fields", fields).select(
        "file_name",
        "raw_line_no",
        (F.size("fields") >= 8).alias("parse_ok"),
        text.alias("time_text"),
        *[plain(i).try_cast("double").alias(name) for name, i in numeric.items()],
    )
    exact_minute = F.col("time_text").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$")
    return read.select(
        "file_name",
        "raw_line_no",
        "parse_ok",
        "time_text",
        F.when(exact_minute, F.col("time_text")).try_cast("timestamp_ntz").alias("wall_time"),
        *[S.known(F.col(name)).alias(name) for name in numeric],
    )


def file_metadata(name: Column) -> dict[str, Column]:
    """Contract facts spelled out in the file name; missing when the name does not follow the rule."""
    low = F.lower(name)
    part = lambda i: F.regexp_extract(low, C.RAW_NAME_PATTERN, i)
    ok = low.rlike(C.RAW_NAME_PATTERN)
    number = lambda i: part(i).try_cast("int")
    return {
        "name_ok": ok,
        "root_code": F.when(ok, part(1)),
        "expiry_code": F.when(ok, F.upper(part(2))),
        "contract_year": F.when(ok, F.lit(2000.0) + number(3)),
        "bar_minutes": F.when(ok, number(4).cast("double")),
        "download_date": F.when(
            ok, F.concat_ws("-", part(7), part(5), part(6)).try_cast("date")
        ),
    }


def usable_bars(bars: DataFrame) -> DataFrame:
    """Time, price and volume of cleaned bars; last one wins when a time is repeated."""
    return (
        bars.where(F.col("Time").isNotNull() & S.holds(S.known(F.col("Latest")) > 0))
        .groupBy("file_name_clean", "Time")
        .agg(F.max_by(F.struct("Latest", "Volume"), F.coalesce(
            F.col("raw_line_no") if "raw_line_no" in bars.columns else F.lit(0), F.lit(0))).alias("b"))
        .select("file_name_clean", "Time", "b.Latest", "b.Volume")
    )


def scan_clean_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Cleaned bars; the typed schema lets file filters and column selection reach the scan."""
    reader = spark.read.schema(BAR_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", "true").option("timestampNTZFormat", "yyyy-MM-dd HH:mm")
    return reader.format(fmt).load(path)


def missing_clean_files(summary: DataFrame, present: DataFrame) -> DataFrame:
    """Files the cleaning summary names with clean rows but that are not there."""
    expected = summary.select(F.col("file_name").alias("file_name_clean"), "n_clean_rows")
    return expected.join(present.select("file_name_clean").distinct(), "file_name_clean", "left_anti")


def expected_clean_bars(bars: DataFrame, summary: DataFrame) -> DataFrame:
    """Bars of files the cleaning summary knows; extra files are ignored."""
    known_files = summary.select(F.col("file_name").alias("file_name_clean"))
    return bars.join(known_files, "file_name_clean", "left_semi")
