"""Event windows: interval join of bars, window measures, wide panel, pre-window placebo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.config import RAW_ZONE, WindowRules
from pulsegrid.functions import scalars as S

EVENT_KEYS = [
    "event_date",
    "trade_date",
    "event_id",
    "root_code",
    "file_name_clean",
    "expiry_code",
    "contract_year",
]
WINDOWS = ("PR", "PC", "ANN")
CLOCKS = ["event_time_local", "event_time_utc", "window_start_utc", "window_end_utc"]


def event_windows(preferred: DataFrame, rules: WindowRules = WindowRules()) -> DataFrame:
    """Three windows per event and eligible contract."""
    m = S.shift_minutes
    pr, pc = F.col("pr_datetime_utc"), F.col("pc_datetime_utc")

    def window(name: str, local: str, at: Column, start: Column, end: Column) -> Column:
        return F.struct(
            F.lit(name).alias("window_name"),
            F.col(local).alias("event_time_local"),
            at.alias("event_time_utc"),
            start.alias("window_start_utc"),
            end.alias("window_end_utc"),
        )

    each = F.explode(
        F.array(
            window("PR", "pr_datetime_local", pr, m(pr, -rules.pr_pre), m(pr, rules.pr_post)),
            window("PC", "pc_datetime_local", pc, m(pc, -rules.pc_pre), m(pc, rules.pc_post)),
            window(
                "ANN", "pr_datetime_local", pr, m(pr, -rules.ann_pre_from_pr), m(pc, rules.ann_post_from_pc)
            ),
        )
    )
    return preferred.where("prelim_eligible").select(*EVENT_KEYS, each.alias("w")).select(*EVENT_KEYS, "w.*")


def window_bars(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Bars inside each window, both ends included.

    The interval becomes an equi join on (file, UTC day): a window names the days it touches. The
    window side has a few rows per event, so the planner ships it when its size allows.
    """
    days = windows.withColumn(
        "bar_day",
        F.explode(F.sequence(F.to_date("window_start_utc"), F.to_date("window_end_utc"))),
    )
    values = [c for c in ("Open", "High", "Low", "Latest", "Volume") if c in bars.columns]
    keyed = bars.select("file_name_clean", "Time", *values, F.to_date("Time").alias("bar_day"))
    return (
        keyed.join(days, ["file_name_clean", "bar_day"])
        .where(F.col("Time").between(F.col("window_start_utc"), F.col("window_end_utc")))
        .select(
            *EVENT_KEYS,
            "window_name",
            *CLOCKS,
            "Time", *values,
            S.minutes_between(F.col("event_time_utc"), F.col("Time")).alias("rel_event_minutes"),
        )
    )


def window_summary(
    windows: DataFrame, inside: DataFrame, rules: WindowRules = WindowRules()
) -> DataFrame:
    """Coverage, gaps and variation per window; windows without bars stay with zero coverage."""
    keys = ["event_date", "root_code", "file_name_clean", "window_name"]
    order = Window.partitionBy(*keys).orderBy("Time")
    rows = inside.withColumns(
        {
            "gap": S.minutes_between(F.lag("Time").over(order), F.col("Time")),
            "r": F.log("Latest") - F.lag(F.log("Latest")).over(order),
            "on_grid": F.pmod(
                F.timestamp_diff("SECOND", F.col("window_start_utc"), F.col("Time")),
                F.lit(rules.bar_minutes * 60),
            ) == 0,
        }
    )
    r = F.col("r")
    many = F.count(F.lit(1)) >= 2
    total = lambda x: F.when(many, F.coalesce(F.sum(x), F.lit(0.0)))
    measured = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs_bars"),
        F.count_if("on_grid").alias("n_on_grid"),
        F.bool_or(F.col("Time") == F.col("event_time_utc")).alias("exact_event_bar_present"),
        F.min("Time").alias("first_bar_time"),
        F.max("Time").alias("last_bar_time"),
        F.max("gap").alias("max_gap_minutes"),
        F.median("gap").alias("median_gap_minutes"),
        F.count_if(F.col("gap") > rules.max_gap_minutes).alias("n_long_gaps"),
        (F.count_if(F.col("Volume") <= rules.low_volume) / F.count(F.lit(1))).alias("share_low_volume"),
        total(r * r).alias("rv"),
        total(F.when(r > 0, r * r).otherwise(0.0)).alias("rsv_pos"),
        total(F.when(r < 0, r * r).otherwise(0.0)).alias("rsv_neg"),
        total(F.abs(r)).alias("abs_return_sum"),
        F.when(many, F.log(F.max_by("Latest", "Time") / F.min_by("Latest", "Time"))).alias("net_log_return"),
    )
    span = F.timestamp_diff("MINUTE", F.col("window_start_utc"), F.col("window_end_utc"))
    out = windows.join(measured, keys, "left").withColumns(
        {
            "n_expected_bars": F.floor(span / rules.bar_minutes) + 1,
            "n_obs_bars": F.coalesce("n_obs_bars", F.lit(0)),
            "n_long_gaps": F.coalesce("n_long_gaps", F.lit(0)),
            "exact_event_bar_present": S.holds(F.col("exact_event_bar_present")),
        }
    )
    out = out.withColumn(
        "pct_expected_bars", F.coalesce(F.col("n_on_grid"), F.lit(0)) / F.col("n_expected_bars")
    ).drop("n_on_grid")
    eligible = (
        (F.col("pct_expected_bars") >= rules.min_pct_expected)
        & S.holds(F.col("share_low_volume") <= rules.max_share_low_volume)
        & (F.col("max_gap_minutes").isNull() | S.holds(F.col("max_gap_minutes") <= rules.max_gap_minutes))
        & F.col("exact_event_bar_present")
    )
    return out.withColumn("window_eligible", eligible)


WIDE_NUMBERS = (
    "n_obs_bars",
    "n_expected_bars",
    "pct_expected_bars",
    "share_low_volume",
    "max_gap_minutes",
    "rv",
    "rsv_pos",
    "rsv_neg",
    "abs_return_sum",
    "net_log_return",
)
WIDE_FLAGS = ("window_eligible", "exact_event_bar_present")


def wide_panel(summary: DataFrame) -> DataFrame:
    """One row per event and contract with the measures of the three windows side by side."""
    at = lambda name, col: F.max(F.when(F.col("window_name") == name, F.col(col)))
    aggs = [
        at(w, f"event_time_{zone}").alias(f"{w.lower()}_datetime_{zone}")
        for w in ("PR", "PC")
        for zone in ("local", "utc")
    ]
    for w in WINDOWS:
        aggs += [at(w, c).alias(f"{w}_{c}") for c in WIDE_NUMBERS]
        aggs += [
            F.bool_or((F.col("window_name") == w) & F.col(c)).alias(f"{w}_{c}") for c in WIDE_FLAGS
        ]
    return summary.groupBy(*EVENT_KEYS).agg(*aggs)


def window_coverage(summary: DataFrame) -> DataFrame:
    """Mean and sum of coverage, exact bars and eligibility per window."""
    parts = {
        "pct_expected_bars": F.col("pct_expected_bars"),
        "exact_event_bar_present": F.col("exact_event_bar_present").cast("double"),
        "window_eligible": F.col("window_eligible").cast("double"),
    }
    return summary.groupBy("window_name").agg(
        F.count(F.lit(1)).alias("n_windows"),
        *[F.avg(c).alias(f"mean_{n}") for n, c in parts.items()],
        *[F.sum(c).alias(f"sum_{n}") for n, c in parts.items()],
    )


def placebo_panel(inside: DataFrame, first: int = -15, last: int = -5) -> DataFrame:
    """Variation in the minutes before the release, from the release-window bars."""
    rows = inside.where(
        (F.col("window_name") == "PR") & F.col("rel_event_minutes").between(first, last)
    )
    order = Window.partitionBy("event_date", "root_code", "file_name_clean").orderBy("Time")
    r = F.col("r")
    many = F.count(F.lit(1)) >= 2
    total = lambda x: F.when(many, F.coalesce(F.sum(x), F.lit(0.0)))
    jump = F.when(many, F.log(F.max_by("Latest", "Time") / F.min_by("Latest", "Time")))
    return (
        rows.withColumn("r", F.log("Latest") - F.lag(F.log("Latest")).over(order))
        .groupBy(*EVENT_KEYS)
        .agg(
            F.count(F.lit(1)).alias("pre_PR_n_bars"),
            jump.alias("pre_PR_signed_jump"),
            F.abs(jump).alias("pre_PR_abs_jump"),
            total(r * r).alias("pre_PR_rv"),
            total(F.when(r < 0, r * r).otherwise(0.0)).alias("pre_PR_rsv_neg"),
            F.asinh(total(r * r)).alias("pre_asinh_PR_rv"),
            F.asinh(total(F.when(r < 0, r * r).otherwise(0.0))).alias("pre_asinh_PR_rsvneg"),
        )
    )


def alignment_audit(preferred: DataFrame, bars: DataFrame, bar_minutes: int = 5) -> DataFrame:
    """Exact bars one step before, at and after the release, and under the uncorrected clock.

    Every probe needs the bar at its time and the one a step earlier: both are looked up with one
    equi join on (file, time).
    """
    pr = F.col("pr_datetime_utc")
    legacy = S.wall_to_utc(F.col("pr_datetime_local"), RAW_ZONE)
    probe = lambda name, offset, at: F.struct(
        F.lit(name).alias("alignment"), offset.cast("double").alias("offset"), at.alias("at")
    )
    step = bar_minutes
    probes = F.array(
        probe(f"corrected_minus_{step}m", F.lit(-step), S.shift_minutes(pr, -step)),
        probe("corrected_primary", F.lit(0), pr),
        probe(f"corrected_plus_{step}m", F.lit(step), S.shift_minutes(pr, step)),
        probe("legacy_naive_clock", S.minutes_between(pr, legacy), legacy),
    )
    keys = ["event_date", "root_code", "file_name_clean", "alignment"]
    rows = (
        preferred.where(F.col("prelim_eligible") & pr.isNotNull())
        .select("event_date", "root_code", "file_name_clean", "pr_datetime_local", "pr_datetime_utc",
                F.explode(probes).alias("p"))
        .select("*", "p.alignment", F.col("p.offset").alias("offset_from_corrected_minutes"),
                F.col("p.at").alias("evaluation_time_utc"))
        .drop("p")
    )
    looks = rows.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("lag"), F.col("evaluation_time_utc").alias("Time")),
                F.struct(F.lit(1).alias("lag"), S.shift_minutes(F.col("evaluation_time_utc"), -step).alias("Time")),
            )
        ).alias("l"),
    ).select(*keys, "l.*")
    priced = bars.where(S.holds(F.col("Latest") > 0)).select("file_name_clean", "Time", "Latest", "Volume")
    now, before = F.col("lag") == 0, F.col("lag") == 1
    found = looks.join(priced, ["file_name_clean", "Time"]).groupBy(*keys).agg(
        F.bool_or(now).alias("exact_current_bar"),
        F.bool_or(before).alias("exact_lag_bar"),
        F.max(F.when(now, F.col("Latest"))).alias("p1"),
        F.max(F.when(before, F.col("Latest"))).alias("p0"),
        F.max(F.when(now, F.col("Volume"))).alias("volume"),
    )
    ret = F.log("p1") - F.log("p0")
    return rows.join(found, keys, "left").withColumns(
        {
            "exact_current_bar": S.holds(F.col("exact_current_bar")),
            "exact_lag_bar": S.holds(F.col("exact_lag_bar")),
            "log_return": ret,
            "abs_log_return": F.abs(ret),
        }
    ).withColumn("exact_return_pair", F.col("exact_current_bar") & F.col("exact_lag_bar")).drop("p0", "p1")


def alignment_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("alignment").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col("exact_return_pair").cast("double")).alias("share_exact_return_pairs"),
        F.median("abs_log_return").alias("median_abs_log_return"),
        F.avg("abs_log_return").alias("mean_abs_log_return"),
        F.median("volume").alias("median_volume"),
    )


