"""Realized variation: bipower components and exact-grid windows around a release."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.config import HIKES_FROM, LATE_CLOCK_FROM, GridRules
from pulsegrid.functions import scalars as S
from pulsegrid.sources.calendar import scheduled_clock, scheduled_release_utc

BIPOWER = math.pi / 2


def bipower_components(bar_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Realized, bipower and jump variation per event and root, from ordered bar returns."""
    keys = keys or ["event_date", "root_code"]
    order = Window.partitionBy(*keys).orderBy("bar_time")
    rows = bar_rows.where(S.known(F.col("r_bar")).isNotNull()).withColumn(
        "product", F.abs("r_bar") * F.lag(F.abs("r_bar")).over(order)
    )
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("PR_n_obs_bars_BNS"),
        F.sum("r_bar").alias("PR_net_log_return_BNS"),
        F.sum(F.col("r_bar") * F.col("r_bar")).alias("RV_PR_BNS"),
        (F.lit(BIPOWER) * F.sum("product")).alias("BV_PR"),
    )
    jump = F.greatest(F.col("RV_PR_BNS") - F.col("BV_PR"), F.lit(0.0))
    return out.withColumn("JV_PR", jump).withColumns(
        {
            "jump_share_BNS": S.ratio(F.col("JV_PR"), F.col("RV_PR_BNS")),
            "asinh_BV_PR": F.asinh("BV_PR"),
            "asinh_JV_PR": F.asinh("JV_PR"),
        }
    )


def bipower_feasibility(
    components: DataFrame, min_bars: int = 5, min_share: float = 0.80, min_median: float = 5
) -> DataFrame:
    """One row that says whether bar counts support the jump components."""
    m = F.col("PR_n_obs_bars_BNS")
    one = components.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(m >= min_bars).alias("n_groups_ok"),
        F.median(m).alias("median_bars"),
        F.min(m).alias("min_bars"),
        F.max(m).alias("max_bars"),
        F.count("BV_PR").alias("n_bv"),
        F.count("JV_PR").alias("n_jv"),
    ).withColumn("share_groups_ok", F.col("n_groups_ok") / F.greatest(F.col("n_groups"), F.lit(1)))
    status = (
        F.when(F.col("share_groups_ok") < min_share, "too_few_groups_with_enough_bars")
        .when(F.col("median_bars") < min_median, "median_bar_count_too_small")
        .when((F.col("n_bv") == 0) | (F.col("n_jv") == 0), "bns_components_not_computable")
        .otherwise("ok")
    )
    return one.withColumn("status", status).drop("n_bv", "n_jv")


def release_clocks(days: DataFrame, events: DataFrame) -> DataFrame:
    """Release time of every day: the announced one on event dates, the scheduled one otherwise."""
    ev = events.select(
        F.col("event_date").alias("trade_date"),
        F.col("event_id").alias("_id"),
        F.col("pr_datetime_local").alias("_local"),
        F.col("pr_datetime_utc").alias("_utc"),
    )
    day = F.col("trade_date")
    control = F.concat(F.lit("CONTROL_"), F.date_format(day, "yyyyMMdd"))
    return (
        days.select("trade_date").distinct().join(ev, "trade_date", "left").select(
            "trade_date",
            F.col("_id").isNotNull().alias("is_event"),
            F.coalesce("_id", control).alias("event_id"),
            F.coalesce("_local", scheduled_clock(day, "pr")).alias("pseudo_pr_datetime_local"),
            F.coalesce("_utc", scheduled_release_utc(day)).alias("pseudo_pr_datetime_utc"),
        )
    )


def grid_slots(bars: DataFrame, clocks: DataFrame, rules: GridRules = GridRules()) -> DataFrame:
    """Bars on the exact grid around each day's release, with their returns.

    The calendar has one row per day and names the UTC days its grid touches; bars join it on the day
    alone, so only the few bars per contract-day that sit on the grid are shuffled afterwards.
    A return exists when the bar and the bar exactly one step earlier are both there.
    """
    step = rules.bar_minutes
    first = min(rules.pre_ends[0] - step, rules.volume_range[0])
    last = rules.post_ends[1]
    release = F.col("pseudo_pr_datetime_utc")
    touched = clocks.select(
        "trade_date",
        "pseudo_pr_datetime_utc",
        F.explode(
            F.sequence(
                F.to_date(S.shift_minutes(release, first)), F.to_date(S.shift_minutes(release, last))
            )
        ).alias("bar_day"),
    )
    seconds = F.timestamp_diff("SECOND", release, F.col("Time"))
    on_grid = (
        bars.where(S.holds(F.col("Latest") > 0))
        .select("file_name_clean", "root_code", "Time", "Latest", "Volume", F.to_date("Time").alias("bar_day"))
        .join(touched, "bar_day")
        .withColumn("offset", seconds)
        .where(F.col("offset").between(first * 60, last * 60) & (F.pmod("offset", F.lit(step * 60)) == 0))
        .withColumn("slot", (F.col("offset") / (step * 60)).cast("int"))
    )
    order = Window.partitionBy("trade_date", "root_code", "file_name_clean").orderBy("slot")
    linked = F.lag("slot").over(order) == F.col("slot") - 1
    rows = on_grid.select(
        "trade_date", "root_code", "file_name_clean", "slot", "Volume",
        F.when(linked, F.log("Latest") - F.lag(F.log("Latest")).over(order)).alias("r"),
    )
    return rows.withColumn(
        "r_before",
        F.when(F.lag("slot").over(order) == F.col("slot") - 1, F.lag("r").over(order)),
    )


def grid_variation(slots: DataFrame, rules: GridRules = GridRules()) -> DataFrame:
    """Coverage, volume and variation before and after the release per day, root and contract."""
    step = rules.bar_minutes
    keys = ["trade_date", "root_code", "file_name_clean"]
    aggs = []
    for side, (lo, hi) in {"pre": rules.pre_ends, "post": rules.post_ends}.items():
        lo, hi = lo // step, hi // step
        inside = F.col("slot").between(lo, hi)
        r = F.when(inside, F.col("r"))
        # The product stays inside the side: its first slot has no predecessor there.
        pair = F.when(F.col("slot").between(lo + 1, hi), F.abs("r") * F.abs("r_before"))
        aggs += [
            F.count(r).alias(f"n_{side}_returns"),
            F.count(pair).alias(f"n_{side}_pairs"),
            F.sum(r * r).alias(f"sq_{side}"),
            F.sum(pair).alias(f"bp_{side}"),
        ]
    vlo, vhi = (v // step for v in rules.volume_range)
    volume = F.when(F.col("slot").between(vlo, vhi), F.coalesce("Volume", F.lit(0.0)))
    out = slots.groupBy(*keys).agg(*aggs, F.sum(volume).alias("pre_volume"))
    cols = {}
    for side, (lo, hi) in {"pre": rules.pre_ends, "post": rules.post_ends}.items():
        expected = (hi - lo) // step + 1
        enough = F.col(f"n_{side}_returns") >= rules.min_returns
        rv = F.when(enough, F.col(f"sq_{side}"))
        bv = F.when(
            enough & (F.col(f"n_{side}_pairs") >= rules.min_pairs), F.lit(BIPOWER) * F.col(f"bp_{side}")
        )
        jv = F.when(bv.isNotNull(), F.greatest(rv - bv, F.lit(0.0)))
        cols |= {
            f"n_{side}_expected": F.lit(expected),
            f"{side}_coverage": F.col(f"n_{side}_returns") / F.lit(expected),
            f"RV_{side}": rv,
            f"BV_{side}": bv,
            f"JV_{side}": jv,
            f"jump_share_{side}": S.ratio(jv, rv),
        }
    out = out.withColumns(cols)
    return out.drop(*[f"{n}_{s}" for n in ("sq", "bp") for s in ("pre", "post")],
                    "n_pre_pairs", "n_post_pairs")


def root_day_candidates(
    days: DataFrame, clocks: DataFrame, measures: DataFrame, rules: GridRules = GridRules()
) -> DataFrame:
    """Contract-days with release clock, grid measures and their rank within the root-day.

    Only values known before the release enter the rank.
    """
    keys = ["trade_date", "root_code", "file_name_clean"]
    rows = (
        days.select(*keys, S.optional(days, "ret_var").alias("day_rv"))
        .join(clocks, "trade_date")
        .join(measures, keys, "left")
    )
    zero = ["n_pre_returns", "n_post_returns", "pre_coverage", "post_coverage"]
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    side_ok = lambda s: S.holds(
        (F.col(f"{s}_coverage") >= rules.min_coverage)
        & (F.col(f"n_{s}_returns") >= rules.min_returns)
        & F.col(f"BV_{s}").isNotNull()
    )
    rows = rows.withColumns({"pre_eligible": side_ok("pre"), "post_eligible": side_ok("post")})
    order = Window.partitionBy("trade_date", "root_code").orderBy(
        F.desc("pre_eligible"),
        F.desc_nulls_last("pre_coverage"),
        F.desc_nulls_last(F.log1p(F.greatest(F.col("pre_volume"), F.lit(0.0)))),
        F.asc("file_name_clean"),
    )
    return rows.withColumn("selected", F.row_number().over(order) == 1)


def root_day_windows(candidates: DataFrame) -> DataFrame:
    """The chosen contract of every root-day with calendar columns and log measures."""
    status = (
        F.when(~F.col("pre_eligible"), "no_pre_eligible_contract")
        .when(~F.col("post_eligible"), "post_window_ineligible")
        .otherwise("ok")
    )
    day = F.col("trade_date")
    logs = {f"log_{m}_{s}": S.positive_log(F.col(f"{m}_{s}")) for m in ("RV", "BV") for s in ("pre", "post")}
    return candidates.where("selected").drop("selected").withColumns(
        logs
        | {
            "selection_status": status,
            "window_eligible": F.col("pre_eligible") & F.col("post_eligible"),
            "log_day_rv": S.positive_log(F.col("day_rv")),
            "root_gg": (F.col("root_code") == "gg").cast("double"),
            "regime_hike": (day >= F.lit(HIKES_FROM)).cast("double"),
            "clock_late": (day >= F.lit(LATE_CLOCK_FROM)).cast("double"),
            "weekday_number": F.dayofweek(day),
            "month_number": F.month(day),
            "year_number": F.year(day),
        }
    )
