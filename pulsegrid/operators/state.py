"""Event state vector: event-level collapse, lags, rolling memory, z-scores, long panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.config import HIKES_FROM, PURCHASES_FROM
from pulsegrid.functions.frames import attach_row, date_sequence, from_previous, total_before

FIRST_VALUES = ("shock_target_10bp", "target_pca_10bp", "path_pca_10bp")
MEANS = {
    "state_pre_rv": "pre_asinh_PR_rv",
    "state_pre_rsvneg": "pre_asinh_PR_rsvneg",
    "state_pre_absjump": "pre_PR_abs_jump",
    "mean_PR_abs_jump": "PR_abs_jump",
    "mean_asinh_PR_rv": "asinh_PR_rv",
    "mean_asinh_PR_rsvneg": "asinh_PR_rsv_neg",
}
SCORED = (
    "shock_target_10bp",
    "target_pca_10bp",
    "path_pca_10bp",
    "state_pre_rv",
    "state_pre_rsvneg",
    "state_pre_absjump",
    "lag1_target_10bp",
    "ma3_target_10bp",
    "ma3_abs_target_10bp",
    "cumabs_target_10bp",
    "lag1_pre_rv_state",
    "lag1_pre_rsvneg_state",
    "cum_target_within_regime_10bp",
)


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, (x - mean) / sd)


def with_z_scores(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
    )
    s = F.col("_s")
    return attach_row(df, stats).withColumns(
        {f"{c}_z": z_score(F.col(c), s[f"m_{c}"], s[f"s_{c}"]) for c in columns}
    ).drop("_s")


def event_state(panel: DataFrame, regime_starts=(PURCHASES_FROM, HIKES_FROM)) -> DataFrame:
    """One row per event date with its own measures and what earlier events say."""
    first = lambda c: F.min_by(
        F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("root_code"))
    ).alias(c)
    maturities = [c for c in panel.columns if c.startswith("ois_") and c.endswith("_raw")]
    events = panel.groupBy("event_date").agg(
        *[first(c) for c in (*FIRST_VALUES, *maturities)],
        *[F.avg(src).alias(name) for name, src in MEANS.items()],
    )
    day = F.col("event_date")
    app, hike = (F.lit(d) for d in regime_starts)
    events = events.withColumns(
        {
            "regime_preapp": (day < app).cast("double"),
            "regime_app": ((day >= app) & (day < hike)).cast("double"),
            "regime_hike": (day >= hike).cast("double"),
            "regime_id": F.when(day < app, 1).when(day < hike, 2).otherwise(3),
        }
    )
    x = F.col("shock_target_10bp")
    at = lambda c, back: F.max(F.when(F.col("back") == back, F.col(c)))
    ordered = from_previous(
        date_sequence(events, "event_date"),
        [],
        3,
        [
            at("shock_target_10bp", 1).alias("lag1_target_10bp"),
            at("shock_target_10bp", 2).alias("lag2_target_10bp"),
            F.avg(x).alias("ma3_target_10bp"),
            F.avg(F.abs(x)).alias("ma3_abs_target_10bp"),
            F.coalesce(F.sum(F.abs(x)), F.lit(0.0)).alias("cumabs_target_10bp"),
            at("state_pre_rv", 1).alias("lag1_pre_rv_state"),
            at("state_pre_rsvneg", 1).alias("lag1_pre_rsvneg_state"),
        ],
    )
    ordered = total_before(
        ordered, ["regime_id"], "event_date", "shock_target_10bp", "cum_target_within_regime_10bp"
    )
    return with_z_scores(ordered, SCORED)


def long_state_panel(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Event state joined to every panel row, with the interactions used by the models."""
    extra = [c for c in events.columns if c not in panel.columns and c not in ("event_id", "seq", "regime_id")]
    shock = F.col("shock_target_10bp")
    return panel.join(events.select("event_date", *extra), "event_date", "left").withColumns(
        {
            "target_x_hike": shock * F.col("regime_hike"),
            "target_x_preRV": shock * F.col("state_pre_rv_z"),
            "target_x_memory": shock * F.col("ma3_target_10bp_z"),
            "target_x_preRSVneg": shock * F.col("state_pre_rsvneg_z"),
        }
    )


def slow_state(windows: DataFrame, days: int = 5) -> DataFrame:
    """Mean log variance of the last known earlier days per root.

    Known days are numbered per root; a day looks at the numbers just below its own count.
    """
    known = windows.where(F.col("log_day_rv").isNotNull()).select("root_code", "trade_date", "log_day_rv")
    numbered = date_sequence(known, "trade_date", ["root_code"])
    reach = numbered.select(
        "root_code", "log_day_rv", F.explode(F.sequence(F.col("seq"), F.col("seq") + days - 1)).alias("upto")
    )
    means = reach.groupBy("root_code", "upto").agg(F.avg("log_day_rv").alias("slow5_log_rv"))
    marks = windows.select("root_code", "trade_date", F.col("log_day_rv").isNotNull().cast("double").alias("one"))
    counted = total_before(marks, ["root_code"], "trade_date", "one", "earlier").select(
        "root_code", "trade_date", F.col("earlier").cast("long").alias("upto")
    )
    return windows.join(counted, ["root_code", "trade_date"]).join(
        means, ["root_code", "upto"], "left"
    ).drop("upto")


def merge_event_state(windows: DataFrame, events: DataFrame) -> DataFrame:
    cols = [c for c in ("shock_target_10bp", "target_pca_10bp", "path_pca_10bp", "state_pre_rv_z")
            if c in events.columns]
    state = events.select(F.col("event_date").alias("trade_date"), *cols, F.lit(True).alias("_m"))
    return windows.join(state, "trade_date", "left").withColumn(
        "is_event_with_state", F.col("is_event") & F.coalesce("_m", F.lit(False))
    ).drop("_m")


def pre_state_on_controls(windows: DataFrame) -> DataFrame:
    """Pre-release log variation scored by the controls of the same root."""
    control = ~F.col("is_event") & F.col("window_eligible") & F.col("log_BV_pre").isNotNull()
    x = F.when(control, F.col("log_BV_pre"))
    stats = windows.groupBy("root_code").agg(
        F.avg(x).alias("pre_state_control_mean"), F.stddev_samp(x).alias("pre_state_control_sd")
    )
    return windows.join(stats, "root_code", "left").withColumn(
        "pre_state_z",
        z_score(F.col("log_BV_pre"), F.col("pre_state_control_mean"), F.col("pre_state_control_sd")),
    )


def shock_energy(windows: DataFrame) -> DataFrame:
    t, p, q, z = (F.col(c) for c in ("target_pca_10bp", "path_pca_10bp", "shock_target_10bp", "pre_state_z"))
    return windows.withColumns({"q_target": q * q, "q_factor": t * t + p * p}).withColumns(
        {"q_target_x_pre": F.col("q_target") * z, "q_factor_x_pre": F.col("q_factor") * z}
    )


