"""Contract-day quality, file quality, contract selection and event coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.config import DayQualityRules, SelectionRules
from pulsegrid.functions import scalars as S
from pulsegrid.sources.bars import FILE_KEYS


def with_trade_date(bars: DataFrame) -> DataFrame:
    """Trade date is the UTC calendar day unless the bars bring their own session date."""
    return bars if "trade_date" in bars.columns else bars.withColumn("trade_date", F.to_date("Time"))


def contract_day_quality(bars: DataFrame, rules: DayQualityRules = DayQualityRules()) -> DataFrame:
    """Bar count, volume, gaps and variation per contract and day.

    One exchange on (contract, day) serves the lag and the aggregate. A day holds at most one bar per
    grid time, so a busy contract is spread over its days.
    """
    bars = with_trade_date(bars)
    keys = [k for k in FILE_KEYS if k in bars.columns] + ["trade_date"]
    order = Window.partitionBy("file_name_clean", "trade_date").orderBy("Time")
    gap = S.minutes_between(F.lag("Time").over(order), F.col("Time"))
    step = F.log("Latest") - F.lag(F.log("Latest")).over(order)
    rows = bars.withColumns({"gap": gap, "ret": step})
    thin = (F.col("Volume") <= rules.low_volume).cast("double")
    g = F.col("gap")
    expected = F.abs(g - rules.bar_minutes) < 1e-9
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.coalesce(F.sum("Volume"), F.lit(0.0)).alias("total_volume"),
        F.median("Volume").alias("median_volume"),
        F.avg("Volume").alias("mean_volume"),
        F.min("Volume").alias("min_volume"),
        F.max("Volume").alias("max_volume"),
        F.coalesce(F.sum(thin), F.lit(0.0)).alias("n_low_volume"),
        (F.coalesce(F.sum(thin), F.lit(0.0)) / F.count(F.lit(1))).alias("share_low_volume"),
        F.min("Time").alias("first_bar_time"),
        F.max("Time").alias("last_bar_time"),
        S.minutes_between(F.min("Time"), F.max("Time")).alias("span_minutes"),
        F.count("gap").alias("n_gaps"),
        F.count_if(expected).alias("n_expected_gaps"),
        F.avg(expected.cast("double")).alias("pct_expected_gaps"),
        F.max("gap").alias("max_gap_minutes"),
        F.median("gap").alias("median_gap_minutes"),
        F.count_if(g > rules.long_gap_minutes).alias("n_long_gaps"),
        F.count_if(g > rules.very_long_gap_minutes).alias("n_very_long_gaps"),
        F.when(F.count("gap") > 0, F.coalesce(F.sum(F.col("ret") * F.col("ret")), F.lit(0.0))).alias("ret_var"),
        F.when(F.count("gap") > 0, F.coalesce(F.sum(F.abs("ret")), F.lit(0.0))).alias("abs_return_sum"),
    )


def file_quality(days: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Averages of the daily rows per file; files without bars keep a row with zero days."""
    keys = [k for k in FILE_KEYS if k in days.columns]
    out = days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg("n_bars").alias("avg_bars_per_day"),
        F.avg("total_volume").alias("avg_daily_volume"),
        F.median("total_volume").alias("median_daily_volume"),
        F.avg("share_low_volume").alias("avg_share_low_volume"),
        F.avg("pct_expected_gaps").alias("avg_pct_expected_gaps"),
        F.avg("max_gap_minutes").alias("avg_max_gap_minutes"),
        F.avg("ret_var").alias("avg_ret_var"),
    )
    if files is None:
        return out
    common = [k for k in keys if k in files.columns]
    return files.select(*common).join(out, common, "left").withColumn(
        "n_days", F.coalesce("n_days", F.lit(0))
    )


def root_report(rows: DataFrame) -> DataFrame:
    """Counts and averages of contract-days per root."""
    return rows.groupBy("root_code").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg("n_bars").alias("avg_bars"),
        F.avg("total_volume").alias("avg_volume"),
        F.avg("share_low_volume").alias("avg_share_low_volume"),
        F.avg("pct_expected_gaps").alias("avg_pct_expected_gaps"),
    )


def _min_max(col: str, over) -> F.Column:
    x = F.col(col).cast("double")
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(low == high, F.lit(1.0)).otherwise((x - low) / (high - low))


def contract_candidates(
    days: DataFrame, events: DataFrame, rules: SelectionRules = SelectionRules()
) -> DataFrame:
    """Contract-days on event dates with eligibility, weighted score and rank in their root-day."""
    ev = events.withColumn("trade_date", F.col("event_date"))
    joined = days.join(ev, "trade_date")
    eligible = S.holds(
        (F.col("n_bars") >= rules.min_bars)
        & (F.col("total_volume") >= rules.min_total_volume)
        & (F.col("share_low_volume") <= rules.max_share_low_volume)
        & (F.col("pct_expected_gaps") >= rules.min_pct_expected_gaps)
    )
    rows = joined.withColumns(
        {
            "prelim_eligible": eligible,
            "log_total_volume": F.log1p("total_volume"),
            "one_minus_lowvol": 1 - F.col("share_low_volume"),
        }
    )
    group = Window.partitionBy("event_date", "root_code")
    score = (
        rules.weight_volume * _min_max("log_total_volume", group)
        + rules.weight_bars * _min_max("n_bars", group)
        + rules.weight_lowvol * _min_max("one_minus_lowvol", group)
        + rules.weight_gaps * _min_max("pct_expected_gaps", group)
    )
    rank = F.row_number().over(
        group.orderBy(F.desc_nulls_last("selection_score"), F.asc("file_name_clean"))
    )
    return rows.withColumn("selection_score", score).withColumn("rank_within_root_day", rank)


def preferred_contracts(candidates: DataFrame) -> DataFrame:
    """First contract per root-day by eligibility, score (missing first) and rank."""
    order = Window.partitionBy("event_date", "root_code").orderBy(
        F.desc("prelim_eligible"), F.desc_nulls_first("selection_score"), F.asc("rank_within_root_day")
    )
    return candidates.withColumn("_first", F.row_number().over(order)).where("_first = 1").drop("_first")


def event_coverage(events: DataFrame, candidates: DataFrame, preferred: DataFrame) -> DataFrame:
    """Candidates and preferred contracts per event; events without any stay."""
    count = lambda root: F.count_if(F.col("root_code") == root)
    cand = candidates.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n_candidates_total"),
        count("fx").alias("n_candidates_fx"),
        count("gg").alias("n_candidates_gg"),
    )
    pref = preferred.groupBy("event_date").agg(
        *[(count(r) > 0).alias(f"has_preferred_{r}") for r in ("fx", "gg")],
        *[
            F.bool_or((F.col("root_code") == r) & F.col("prelim_eligible")).alias(f"pref_{r}_eligible")
            for r in ("fx", "gg")
        ],
    )
    numbers = ["n_candidates_total", "n_candidates_fx", "n_candidates_gg"]
    flags = [f"has_preferred_{r}" for r in ("fx", "gg")] + [f"pref_{r}_eligible" for r in ("fx", "gg")]
    return (
        events.join(cand, "event_date", "left")
        .join(pref, "event_date", "left")
        .withColumns(
            {n: F.coalesce(F.col(n), F.lit(0)) for n in numbers}
            | {f: S.holds(F.col(f)) for f in flags}
        )
    )


def top_rows(df: DataFrame, by: list, n: int = 10) -> DataFrame:
    """The first rows of a report."""
    return df.orderBy(*by).limit(n)
