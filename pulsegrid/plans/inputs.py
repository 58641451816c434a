"""Driver tables in the shapes of the study (see FIXTURES.md).

Hourly bars come from ``events``, daily paired bars from ``lineitem`` and a surprise series from
``orders``. Every mapping is an aggregation with map-side combining on keys that contain the time. Bars and
order sums are steps: a large table is read for them once in a run, however many later steps use them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.config import CleaningRules, DayQualityRules, GridRules, SelectionRules, WindowRules
from pulsegrid.functions import scalars as S
from pulsegrid.plans.stages import stage
from pulsegrid.session import durable

HOURLY = 60
HOURLY_ORIGIN = "2024-01-01"
SESSION_ORIGIN = "1995-01-01"
SESSION_DAYS = 10
LATE_SESSION = "1998-07-01"

HOURLY_CLEANING = CleaningRules(spike_gap_minutes=720.0)
HOURLY_QUALITY = DayQualityRules(60.0, 1.0, 180.0, 720.0)
HOURLY_SELECTION = SelectionRules(min_bars=18)
HOURLY_WINDOWS = WindowRules(60, 1.0, 180, 360, 180, 900, 180, 900, 0.80, 0.50, 180.0)
HOURLY_GRID = GridRules().scaled(12)
SESSION_QUALITY = DayQualityRules(1440.0, 1.0, 4320.0, 17280.0)
SESSION_GRID = GridRules(
    bar_minutes=1440,
    pre_ends=(-4 * 1440, -1440),
    post_ends=(0, 3 * 1440),
    volume_range=(-5 * 1440, -1440),
    min_coverage=0.75,
    min_returns=3,
    min_pairs=2,
)


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    folder: str

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")


def at_edges(rows: DataFrame, groups: DataFrame, keys: list[str], edge) -> DataFrame:
    """Rows of their group that ``edge`` holds for; null keys are a group of their own.

    A first or last value by several columns needs the rows at its leading column's edge only. That edge is a plain number,
    so the whole table is aggregated by hashing; max_by with a struct would sort it.
    """
    named = groups.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(named, same & edge).drop(*named.columns)


@stage
def hourly_bars(t: Tables) -> DataFrame:
    """One bar per event type and hour."""
    keys = ["event_type", "hour"]
    rows = t["events"].select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "ts", "event_id", "value")
    groups = durable(rows.groupBy(*keys).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("value").alias("High"), F.min("value").alias("Low"),
        F.count(F.lit(1)).cast("double").alias("Volume"),
    ))
    order = F.struct("ts", "event_id")
    edges = at_edges(
        rows, groups.select(*keys, "first", "last"), keys, F.col("ts").eqNullSafe(F.col("first")) | F.col("ts").eqNullSafe(F.col("last"))
    ).groupBy(*keys).agg(F.min_by("value", order).alias("Open"), F.max_by("value", order).alias("Latest"))
    both = [F.col(f"g.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    return (
        groups.alias("g").join(edges.alias("e"), both)
        .select(F.col("g.event_type").alias("file_name_clean"), F.col("g.hour").alias("Time"), "Open", "High", "Low", "Latest", "Volume")
        .withColumns(
            {
                "root_code": F.when(F.col("file_name_clean").isin("click", "view"), "fx").otherwise("gg"),
                "expiry_code": F.upper(F.substring("file_name_clean", 1, 1)),
                "contract_year": F.lit(2024.0),
                "bar_minutes": F.lit(60.0),
            }
        )
    )


def hourly_calendar(t: Tables) -> DataFrame:
    """An event on every third day of the data, released at 14:00 and discussed at 15:00 local time."""
    days = hourly_bars(t).select(F.to_date("Time").alias("event_date")).distinct().where(
        F.pmod(F.datediff("event_date", F.lit(HOURLY_ORIGIN)), F.lit(3)) == 0
    )
    return days.withColumns({"pr_time": F.lit("14:00"), "pc_time": F.lit("15:00")})


def dirty_lines(t: Tables) -> DataFrame:
    """Hourly bars written as quoted text lines with faults at fixed positions.

    The position n of a bar is 8 * (hours since the origin) + length of its contract name.
    """
    hour = (F.timestamp_diff("HOUR", F.lit(HOURLY_ORIGIN).cast("timestamp_ntz"), F.col("Time")))
    n = F.col("n")
    fault = lambda m: n % m == 0
    text = lambda c: c.cast("decimal(18,4)").cast("string")
    quoted = lambda *cs: F.concat(F.lit('"'), F.concat_ws('","', *cs), F.lit('"'))
    local = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("America/Chicago"), "Time"), "yyyy-MM-dd HH:mm")
    high = F.when(fault(103), F.col("Low") - 1).otherwise(F.col("High"))
    latest = F.when(fault(127), F.col("Latest") * 10).otherwise(F.col("Latest"))
    open_ = F.when(fault(101), F.lit(0.0)).otherwise(F.col("Open"))
    volume = F.when(fault(97), -F.col("Volume")).otherwise(F.col("Volume"))
    stamp = F.when(fault(109), F.lit("not a time")).otherwise(local)
    top = F.when(fault(127), F.greatest(high, latest)).otherwise(high)
    fields = [stamp, text(open_), text(top), text(F.col("Low")), text(latest), F.lit("0"), F.lit("0%"),
              volume.cast("long").cast("string")]
    rows = hourly_bars(t).withColumn("h", hour).withColumn("n", F.col("h") * 8 + F.length("file_name_clean"))
    body = rows.select(
        F.col("file_name_clean").alias("file_name"),
        F.explode(F.sequence(F.lit(0), F.when(fault(113), 1).otherwise(0))).alias("copy"),
        "h",
        F.when(fault(107), quoted(*fields[:5])).otherwise(quoted(*fields)).alias("line"),
    ).select("file_name", (2 * F.col("h") + 2 + F.col("copy")).alias("raw_line_no"), "line")
    files = rows.groupBy(F.col("file_name_clean").alias("file_name")).agg(F.max("h").alias("last"))
    header = files.select(
        "file_name", F.lit(1).cast("long").alias("raw_line_no"),
        F.lit('"Time","Open","High","Low","Latest","Change","%Change","Volume"').alias("line"),
    )
    footer = files.where(F.length("file_name") > 4).select(
        "file_name", (2 * F.col("last") + 9).alias("raw_line_no"),
        F.lit('"Downloaded from Barchart.com"').alias("line"),
    )
    return header.unionByName(body).unionByName(footer)


def session_of(day: F.Column) -> F.Column:
    return F.floor(F.datediff(day, F.lit(SESSION_ORIGIN)) / SESSION_DAYS).cast("int")


@stage
def session_bars(t: Tables) -> DataFrame:
    """One daily bar per line status (root), return flag (contract) and ship date."""
    keys = ["l_linestatus", "l_returnflag", "day"]
    rows = t["lineitem"].select("*", F.to_date("l_shipdate").alias("day"))
    groups = durable(rows.groupBy(*keys).agg(F.max("l_orderkey").alias("last"), F.sum("l_quantity").alias("Volume")))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    latest = at_edges(
        rows, groups.select(*keys, "last"), keys, F.col("l_orderkey").eqNullSafe(F.col("last"))
    ).groupBy(*keys).agg(F.max_by("l_extendedprice", order).alias("Latest"))
    both = [F.col(f"g.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    status, flag, day = (F.col(f"g.{k}") for k in keys)
    return groups.alias("g").join(latest.alias("e"), both).select(
        F.concat_ws("_", status, flag).alias("file_name_clean"),
        F.when(status == "O", "fx").otherwise("gg").alias("root_code"),
        day.cast("timestamp_ntz").alias("Time"),
        F.date_add(F.lit(SESSION_ORIGIN).cast("date"), session_of(day) * SESSION_DAYS).alias("trade_date"),
        "Latest",
        "Volume",
    )


def session_clocks(t: Tables) -> DataFrame:
    """One row per session: its release is on day 5, every third session is an event."""
    start = F.date_add(F.lit(SESSION_ORIGIN).cast("date"), F.col("session") * SESSION_DAYS)
    sessions = session_bars(t).select(session_of(F.to_date("Time")).alias("session")).distinct()
    release = F.date_add(start, 5).cast("timestamp_ntz")
    event = F.col("session") % 3 == 0
    name = F.date_format(start, "yyyyMMdd")
    return sessions.select(
        "session",
        start.alias("trade_date"),
        event.alias("is_event"),
        F.concat(F.when(event, F.lit("EVENT_")).otherwise(F.lit("CONTROL_")), name).alias("event_id"),
        release.alias("pseudo_pr_datetime_local"),
        release.alias("pseudo_pr_datetime_utc"),
    )


def session_calendar_columns(session: F.Column) -> dict[str, F.Column]:
    """Weekday block, late clock and year of a session."""
    start = F.date_add(F.lit(SESSION_ORIGIN).cast("date"), session * SESSION_DAYS)
    return {
        "weekday_number": (session % 5 + 2).cast("int"),
        "clock_late": (start >= F.lit(LATE_SESSION)).cast("double"),
        "regime_hike": (start >= F.lit("2000-01-01")).cast("double"),
        "month_number": F.month(start),
        "year_number": F.year(start),
    }


#: Series of surprises and the order priority each is taken over; the first takes all orders.
_SERIES = {"1m": None, "6m": "1", "1y": "2", "2y": "3", "3y": "4"}


@stage
def session_orders(t: Tables) -> DataFrame:
    """Sum and number of order prices per session and series."""
    price = F.col("o_totalprice")
    own = {m: price if p is None else F.when(F.substring("o_orderpriority", 1, 1) == p, price) for m, p in _SERIES.items()}
    return t["orders"].groupBy(session_of(F.to_date("o_orderdate")).alias("session")).agg(
        *[f(v).alias(f"{n}_{m}") for m, v in own.items() for n, f in (("sum", F.sum), ("n", F.count))]
    )


def session_surprises(t: Tables) -> DataFrame:
    """Surprise of each session: its mean order value against the overall mean, by priority as well."""
    per = session_orders(t)
    overall = per.agg(*[S.ratio(F.sum(f"sum_{m}"), F.sum(f"n_{m}")).alias(m) for m in _SERIES])
    start = F.date_add(F.lit(SESSION_ORIGIN).cast("date"), F.col("session") * SESSION_DAYS)
    mean = lambda m: S.ratio(F.col(f"sum_{m}"), F.col(f"n_{m}"))
    return per.select(
        "session",
        start.alias("event_date"),
        *[((mean(m) - overall.select(m).scalar()) / 1000).alias(f"ois_{m}_raw") for m in _SERIES],
    ).withColumn("shock_target", F.col("ois_1m_raw"))
