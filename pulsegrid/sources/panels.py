"""Typed readers of the study's panels: required columns, kinds, first row per key in file order.

A panel file is text with a header, or Parquet. Every column of the specification is brought to its kind; the formats of all date
columns are chosen in one counting pass. Rows without the columns a panel cannot do without are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid import config as C
from pulsegrid.functions import scalars as S
from pulsegrid.functions.timeparse import DATE_FORMATS, DATETIME_FORMATS, best_formats, read_as


@dataclass(frozen=True)
class PanelSpec:
    """``required`` and ``optional`` columns with their kinds: date, time, text, lower, number or truth."""

    label: str
    required: dict[str, str]
    optional: dict[str, str] = field(default_factory=dict)
    known: tuple[str, ...] = ()
    roots: bool = False
    #: One row for each value: the first in file order.
    first_of: str | None = None


def _kinds(kind: str, names: str) -> dict[str, str]:
    return dict.fromkeys(names.split(), kind)


# The columns of the study's panels.
DAY_QUALITY = PanelSpec(
    "contract_day_quality",
    {"trade_date": "date", "root_code": "text", "file_name_clean": "text", "ret_var": "number"},
    _kinds("number", "total_volume share_low_volume pct_expected_gaps n_bars"), ("trade_date", "root_code", "file_name_clean"))
EVENT_CALENDAR = PanelSpec(
    "event_calendar", {"event_date": "date", "event_id": "text", "pr_datetime_local": "time", "pr_datetime_utc": "time"},
    known=("event_date", "pr_datetime_local", "pr_datetime_utc"), first_of="event_date")
EVENT_STATE = PanelSpec(
    "event_state", {"event_date": "date"}, _kinds("number", "shock_target_10bp target_pca_10bp path_pca_10bp regime_hike state_pre_rv_z"),
    ("event_date",), first_of="event_date")
PREFERRED_CONTRACTS = PanelSpec(
    "preferred_contracts",
    {"event_date": "date"} | _kinds("text", "event_id root_code file_name_clean") | _kinds("time", "pr_datetime_local pc_datetime_local pr_datetime_utc pc_datetime_utc")
    | {"prelim_eligible": "truth"}, known=("event_date", "root_code", "file_name_clean"))
VALIDATION_WINDOWS = PanelSpec(
    "counterfactual_windows",
    {"trade_date": "date", "root_code": "lower", "is_event": "truth", "window_eligible": "truth", "pseudo_pr_datetime_utc": "time"}
    | _kinds("number", "log_BV_pre log_BV_post log_RV_pre log_RV_post jump_share_pre jump_share_post slow5_log_rv clock_late weekday_number month_number "
             "year_number shock_target_10bp target_pca_10bp path_pca_10bp regime_hike"),
    _kinds("number", "abnormal_log_BV abnormal_log_RV abnormal_jump_share"), ("trade_date",), roots=True)
DATE_MATRICES = PanelSpec(
    "date_matrices",
    {"trade_date": "date", "is_event": "truth", "pseudo_pr_datetime_utc": "time"}
    | _kinds("number", "clock_late weekday_number year_number slow_fx slow_gg qpre_11 qpre_12 qpre_22 d_11 d_12 d_22"),
    _kinds("number", "regime_hike q_target pre_state_fx pre_state_gg"),
    ("trade_date", "year_number", "clock_late", "weekday_number", "d_11", "d_12", "d_22"))
PANELS = (DAY_QUALITY, EVENT_CALENDAR, EVENT_STATE, PREFERRED_CONTRACTS, VALIDATION_WINDOWS, DATE_MATRICES)

_ORDER = "_place"


def read_panel(spark: SparkSession, path: str, spec: PanelSpec, fmt: str = "csv") -> DataFrame:
    """The panel's columns in their kinds; raises ValueError naming the panel and what it lacks."""
    reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
    raw = S.require_columns(reader.format(fmt).load(path), list(spec.required), spec.label)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    kinds = spec.required | {c: k for c, k in spec.optional.items() if c in raw.columns}
    return typed(raw.select(*kinds, place.alias(_ORDER)), spec, kinds)


def typed(raw: DataFrame, spec: PanelSpec, kinds: dict[str, str]) -> DataFrame:
    text = {c for c, t in raw.dtypes if t == "string"}
    dated = {c: DATE_FORMATS if k == "date" else DATETIME_FORMATS for c, k in kinds.items() if k in ("date", "time") and c in text}
    formats = best_formats(raw, dated)

    def brought(c: str, kind: str) -> Column:
        v = F.col(c)
        if kind in ("date", "time"):
            at = read_as(v, formats[c]) if c in text else v.cast("timestamp_ntz")
            return F.to_date(at) if kind == "date" else at
        if kind == "number":
            return S.to_number(v) if c in text else S.known(v.cast("double"))
        if kind == "truth":
            return S.to_flag(v) if c in text else v.cast("boolean")
        return F.lower(F.trim(v)) if kind == "lower" else F.trim(v)

    rows = raw.select(*[brought(c, k).alias(c) for c, k in kinds.items()], _ORDER)
    for c in spec.known:
        rows = rows.where(F.col(c).isNotNull() & ((F.col(c) != "") if kinds[c] in ("text", "lower") else F.lit(True)))
    if spec.roots:
        rows = rows.where(F.col("root_code").isin(*C.ROOTS))
    if spec.first_of is None:
        return rows.drop(_ORDER)
    others = [c for c in kinds if c != spec.first_of]
    first = rows.groupBy(spec.first_of).agg(F.min_by(F.struct(*(others or [_ORDER])), _ORDER).alias("first"))
    return first.select(spec.first_of, *[F.col(f"first.`{c}`").alias(c) for c in others])


STUDY_LEAD_DAYS = 60


def study_rows(rows: DataFrame, events: DataFrame, day: str = "trade_date", event_day: str = "event_date") -> DataFrame:
    """Rows from ``STUDY_LEAD_DAYS`` before the first event date to the last, of the study's roots, on Monday to Friday.

    The range is a subquery of one row, so on a table partitioned by ``day`` the folders outside it are never listed into
    the scan. Raises ValueError when no event has a date.
    """
    if events.where(F.col(event_day).isNotNull()).isEmpty():
        raise ValueError("event_state: no valid event dates")
    start = events.agg(F.date_sub(F.min(event_day), STUDY_LEAD_DAYS).alias("d")).scalar()
    end = events.agg(F.max(event_day).alias("d")).scalar()
    return rows.where((F.col(day) >= start) & (F.col(day) <= end)).where(F.col("root_code").isin(*C.ROOTS)).where(F.dayofweek(day).between(2, 6))
