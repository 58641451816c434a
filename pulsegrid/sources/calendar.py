"""Announcement calendar: aliases, default clocks, UTC conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid import config as C
from pulsegrid.functions import scalars as S
from pulsegrid.functions.timeparse import parse_dates

# Accepted column names and default clocks.
DATE_NAMES = ("event_date", "date", "meeting_date", "govc_date")
RELEASE_NAMES = ("decision_time_local", "pr_time", "press_release_time")
CONFERENCE_NAMES = ("press_conf_time_local", "pc_time", "press_conference_time")
REGIME_NAMES = ("timing_regime", "time_regime", "regime")
PLACE_NAMES = ("location", "city", "venue")
EARLY_CLOCK = {"pr": "13:45", "pc": "14:30"}
LATE_CLOCK = {"pr": "14:15", "pc": "14:45"}
EVENT_PREFIX = "ECB_"


def find_column(columns: list[str], names: tuple[str, ...]) -> str | None:
    """First alias that is present, whatever the case."""
    lower = {c.lower(): c for c in reversed(columns)}
    return next((lower[n.lower()] for n in names if n.lower() in lower), None)


def scheduled_clock(day: Column, which: str) -> Column:
    """Local release or conference time of a day by the clock in force."""
    text = F.when(day >= F.lit(C.LATE_CLOCK_FROM), LATE_CLOCK[which]).otherwise(EARLY_CLOCK[which])
    return day.cast("timestamp_ntz") + S.clock_to_interval(text)


def scheduled_release_utc(day: Column) -> Column:
    return S.wall_to_utc(scheduled_clock(day, "pr"), C.EVENT_ZONE)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return build_event_panel(spark.read.option("header", "true").csv(path))


def build_event_panel(raw: DataFrame) -> DataFrame:
    """One row per event date with local and UTC clocks."""
    date_name = find_column(raw.columns, DATE_NAMES)
    if date_name is None:
        raise ValueError("calendar: no date column")
    pr_name = find_column(raw.columns, RELEASE_NAMES)
    pc_name = find_column(raw.columns, CONFERENCE_NAMES)
    regime, place = find_column(raw.columns, REGIME_NAMES), find_column(raw.columns, PLACE_NAMES)
    day = F.col(date_name)
    parsed = parse_dates(raw, date_name).where(day.isNotNull())
    if pr_name and pc_name:
        midnight = day.cast("timestamp_ntz")
        clocks = {
            "pr": midnight + S.clock_to_interval(F.col(pr_name).cast("string")),
            "pc": midnight + S.clock_to_interval(F.col(pc_name).cast("string")),
        }
    else:
        clocks = {k: scheduled_clock(day, k) for k in ("pr", "pc")}
    rows = parsed.select(
        day.alias("event_date"),
        (F.col(regime) if regime else F.lit("")).cast("string").alias("time_regime"),
        (F.col(place) if place else F.lit("")).cast("string").alias("location"),
        clocks["pr"].alias("pr_datetime_local"),
        clocks["pc"].alias("pc_datetime_local"),
        F.monotonically_increasing_id().alias("_row"),
    )
    first = rows.groupBy("event_date").agg(
        F.min_by(
            F.struct("time_regime", "location", "pr_datetime_local", "pc_datetime_local"), "_row"
        ).alias("r")
    )
    panel = first.select("event_date", "r.*").withColumns(
        {
            "event_id": F.concat(F.lit(EVENT_PREFIX), F.date_format("event_date", "yyyyMMdd")),
            "pr_datetime_utc": S.wall_to_utc(F.col("pr_datetime_local"), C.EVENT_ZONE),
            "pc_datetime_utc": S.wall_to_utc(F.col("pc_datetime_local"), C.EVENT_ZONE),
            "event_time_zone": F.lit(C.EVENT_ZONE),
            "analysis_time_zone": F.lit(C.ANALYSIS_ZONE),
        }
    )
    for k in ("pr", "pc"):
        offset = S.minutes_between(F.col(f"{k}_datetime_utc"), F.col(f"{k}_datetime_local"))
        checked = F.when(
            F.assert_true(
                F.coalesce(offset.isin(60.0, 120.0), F.lit(True)),
                F.lit("unexpected UTC offset in the calendar"),
            ).isNull(),
            offset,
        )
        panel = panel.withColumn(f"{k}_utc_offset_minutes", checked)
    return panel


# Release clocks around the weeks in which the two zones change on different dates
# (event-zone wall clock, raw-zone wall clock, UTC).
CLOCK_CASES = (
    ("2020-03-12 13:45:00", "2020-03-12 07:45:00", "2020-03-12 12:45:00"),
    ("2020-12-10 13:45:00", "2020-12-10 06:45:00", "2020-12-10 12:45:00"),
    ("2023-03-16 14:15:00", "2023-03-16 08:15:00", "2023-03-16 13:15:00"),
    ("2023-09-14 14:15:00", "2023-09-14 07:15:00", "2023-09-14 12:15:00"),
    ("2024-06-06 14:15:00", "2024-06-06 07:15:00", "2024-06-06 12:15:00"),
)


def clock_self_test(spark: SparkSession) -> DataFrame:
    cases = spark.createDataFrame(CLOCK_CASES, "event_wall string, raw_wall string, expected string")
    ts = {c: F.col(c).cast("timestamp_ntz") for c in cases.columns}
    return cases.select(*[v.alias(k) for k, v in ts.items()]).withColumns(
        {
            "event_utc": S.wall_to_utc(F.col("event_wall"), C.EVENT_ZONE),
            "raw_utc": S.wall_to_utc(F.col("raw_wall"), C.RAW_ZONE),
        }
    ).withColumn(
        "ok", (F.col("event_utc") == F.col("expected")) & (F.col("raw_utc") == F.col("expected"))
    )


def clock_mismatches(panel: DataFrame) -> DataFrame:
    """Rows whose stored UTC release differs from the one recomputed from the local clock."""
    again = S.wall_to_utc(F.col("pr_datetime_local"), C.EVENT_ZONE)
    return panel.withColumn("recomputed_utc", again).where(
        ~F.col("recomputed_utc").eqNullSafe(F.col("pr_datetime_utc"))
    )
