"""Release panel: semivariance measures, surprises, pre-window placebo, factors, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.config import HIKES_FROM, PURCHASES_FROM
from pulsegrid.functions import scalars as S
from pulsegrid.sources.surprises import PREFIX

FACTOR_TARGET = "ois_1m_raw"
FACTOR_PATH = ("ois_6m_raw", "ois_1y_raw", "ois_2y_raw", "ois_3y_raw")


def baseline_panel(wide: DataFrame, surprises: DataFrame | None = None) -> DataFrame:
    """Eligible release windows with shares, imbalance and surprises."""
    rv, pos, neg = (F.col(f"PR_{c}") for c in ("rv", "rsv_pos", "rsv_neg"))
    net = F.col("PR_net_log_return")
    rows = wide.where("PR_window_eligible").withColumns(
        {
            "log_PR_rv": S.positive_log(rv),
            "log_PR_rsv_pos": S.positive_log(pos),
            "log_PR_rsv_neg": S.positive_log(neg),
            "PR_abs_net_return": F.abs(net),
            "PR_signed_jump": net,
            "PR_neg_share": S.ratio(neg, rv),
            "PR_pos_share": S.ratio(pos, rv),
            "PR_semivariance_imbalance": pos - neg,
            "PR_semivariance_ratio": S.ratio(pos, neg),
            "analysis_sample": F.lit("PR_baseline"),
        }
    )
    return rows if surprises is None else rows.join(surprises, "event_date", "left")


def match_summary(panel: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """How many panel rows found a surprise."""
    cols = columns or [c for c in panel.columns if c.startswith(PREFIX)]
    any_value = F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()
    return panel.agg(
        F.count(F.lit(1)).alias("n_pr_rows"),
        F.count_if(any_value).alias("n_rows_matched"),
        F.count_if(~any_value).alias("n_rows_unmatched"),
        F.avg(any_value.cast("double")).alias("match_rate"),
    )


def panel_report(panel: DataFrame) -> DataFrame:
    """Row, event and root counts with mean coverage and return size."""
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("event_date").alias("n_events"),
        F.count_distinct("root_code").alias("n_roots"),
        F.avg("PR_pct_expected_bars").alias("mean_coverage"),
        F.avg("PR_share_low_volume").alias("mean_share_low_volume"),
        F.avg("PR_abs_net_return").alias("mean_abs_net_return"),
    )


def shares_out_of_range(panel: DataFrame) -> DataFrame:
    return panel.where((F.col("PR_neg_share") < 0) | (F.col("PR_neg_share") > 1))


def _by_event(panel: DataFrame, columns: list[str]) -> DataFrame:
    """First known value per event, in root order."""
    return panel.groupBy("event_date").agg(
        *[F.min_by(F.when(F.col(c).isNotNull(), F.col(c)),
                   F.when(F.col(c).isNotNull(), F.col("root_code"))).alias(c) for c in columns]
    )


def target_path_factors(panel: DataFrame, row_scaled: bool = False) -> DataFrame:
    """Event-level target and path factors of the surprise curve.

    The path is the first principal component of four standardised maturities, oriented to move with
    their average and made orthogonal to the target, then rescaled to the target's spread. All of it
    follows from one 5 x 5 second-moment row, so a single aggregate is read back and the scores are a
    plain column expression.

    ``row_scaled``: a missing target counts as zero, the raw target is partialled out and the
    rescaling uses panel rows instead of events.
    """
    events = _by_event(panel, [FACTOR_TARGET, *FACTOR_PATH])
    raw_target = F.col(FACTOR_TARGET)
    target = F.coalesce(raw_target, F.lit(0.0)) if row_scaled else raw_target
    partial = target if row_scaled else target / 10
    events = events.withColumns({"_t": target / 10, "_p": partial})
    known = F.col("_p").isNotNull()
    for c in FACTOR_PATH:
        known = known & F.col(c).isNotNull()
    names = [*FACTOR_PATH, "_p"]
    ok = events.where(known)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = ok.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[F.covar_samp(a, b).alias(f"c_{a}__{b}") for a, b in pairs],
    ).first()
    if moments["n"] < 5:
        path: Column = F.lit(None).cast("double")
    else:
        cov = np.array([[moments[f"c_{a}__{b}"] if (a, b) in pairs else moments[f"c_{b}__{a}"]
                         for b in names] for a in names])
        mean = np.array([moments[f"m_{c}"] for c in names])
        sd = np.sqrt(np.diag(cov)[:4])
        sd[sd == 0] = 1.0
        load = np.linalg.eigh(cov[:4, :4] / np.outer(sd, sd))[1][:, -1] / sd
        if load @ cov[:4, :4] @ np.ones(4) < 0:
            load = -load
        slope = (load @ cov[:4, 4]) / cov[4, 4] if cov[4, 4] > 0 else 0.0
        full = np.append(load, -slope)
        path = sum((F.col(c) - F.lit(float(m))) * F.lit(float(w)) for c, m, w in zip(names, mean, full))
        path = F.when(known, path)
    scored = events.withColumn("_path", path)
    spread_rows = panel.select("event_date").join(scored, "event_date") if row_scaled else scored
    spread = spread_rows.agg(
        F.stddev_samp("_path").alias("sp"), F.stddev_samp("_t").alias("st")
    ).first()
    factor = F.col("_path")
    if spread["sp"] and spread["st"] is not None:
        factor = factor / F.lit(spread["sp"]) * F.lit(spread["st"])
    return scored.select(
        "event_date", F.col("_t").alias("target_pca_10bp"), factor.alias("path_pca_10bp")
    )


def signal_panel(panel: DataFrame, placebo: DataFrame | None, factors: DataFrame | None = None) -> DataFrame:
    """Outcome transforms, pre-window placebo, scaled surprises and factors."""
    if placebo is not None:
        shared = [c for c in placebo.columns if c in panel.columns]
        panel = panel.join(placebo, shared, "left")
    unit = F.col("shock_target") / 10
    gg = (F.col("root_code") == "gg").cast("double")
    rows = panel.withColumns(
        {
            "PR_abs_jump": F.abs("PR_signed_jump"),
            "asinh_PR_rv": F.asinh("PR_rv"),
            "asinh_PR_rsv_neg": F.asinh("PR_rsv_neg"),
            "root_gg": gg,
            "shock_target_10bp": unit,
            "abs_target_10bp": F.abs(unit),
            "shock_target_x_gg": unit * gg,
            "shock_pos_10bp": F.greatest(unit, F.lit(0.0)),
            "shock_neg_mag_10bp": F.greatest(-unit, F.lit(0.0)),
        }
    )
    if factors is None:
        missing = F.lit(None).cast("double")
        rows = rows.withColumns({"target_pca_10bp": missing, "path_pca_10bp": missing})
    else:
        rows = rows.join(factors, "event_date", "left")
    t, p = F.col("target_pca_10bp"), F.col("path_pca_10bp")
    day = F.col("event_date")
    return rows.withColumns(
        {
            "abs_target_pca_10bp": F.abs(t),
            "abs_path_pca_10bp": F.abs(p),
            "target_pca_x_gg": t * F.col("root_gg"),
            "pos_pca_10bp": F.greatest(t, F.lit(0.0)),
            "neg_mag_pca_10bp": F.greatest(-t, F.lit(0.0)),
            "regime_app": ((day >= F.lit(PURCHASES_FROM)) & (day < F.lit(HIKES_FROM))).cast("double"),
        }
    )


def component_panel(panel: DataFrame) -> DataFrame:
    """Directional and dispersion parts of the realized variance."""
    m, rv, net = F.col("PR_n_obs_bars"), F.col("PR_rv"), F.col("PR_net_log_return")
    direction = F.when(m > 0, net * net / F.greatest(m.cast("double"), F.lit(1.0)))
    rest = rv - direction
    rest = F.when((rest > -1e-12) & (rest < 0), F.lit(0.0)).otherwise(rest)
    share = lambda x: F.when(rv != 0, x / rv)
    return panel.withColumns({"directional_var": direction, "dispersion_var": rest}).withColumns(
        {
            "directional_share": share(F.col("directional_var")),
            "dispersion_share": share(F.col("dispersion_var")),
            "asinh_directional_var": F.asinh("directional_var"),
            "asinh_dispersion_var": F.asinh("dispersion_var"),
        }
    )
