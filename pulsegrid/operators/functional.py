"""Purified shocks, threshold search and splines in the pre-release state."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.frames import dot
from pulsegrid.functions.quantiles import grouped_quantiles
from pulsegrid.functions.scalars import truncated_cubic_basis
from pulsegrid.operators import regression as R
from pulsegrid.operators.regression import EFFECT_SCHEMA, t_columns

FIRST_STAGE = R.Model("first_stage", "shock_target_10bp", ("regime_hike", "state_pre_rv_z"))


def fit_and_leverage() -> Column:
    x = F.col("x")
    return F.struct(dot(x, F.col("beta")).alias("fitted"), R.leverage(x, F.col("inverse")).alias("leverage"))


def purify_shocks(events: DataFrame, model: R.Model = FIRST_STAGE) -> DataFrame:
    """Shock net of what the state predicts, in sample and leaving the event out.

    Leaving one row out changes its residual to e / (1 - h), so no refit is needed.
    """
    rows = R.design(events, [model], ["event_date"])
    fit = R.fits(R.gram(rows, ["model_name"]), R.battery(events, [model]))
    scored = rows.join(fit.select("model_name", "beta", "inverse"), "model_name").withColumn(
        "f", fit_and_leverage()
    )
    resid = F.col("y") - F.col("f.fitted")
    left_out = resid / (1 - F.col("f.leverage"))
    return scored.select(
        "event_date",
        F.col("y").alias("shock_target_10bp"),
        F.col("f.fitted").alias("shock_pred_in"),
        resid.alias("shock_resid_in"),
        (F.col("y") - left_out).alias("shock_pred_loo"),
        left_out.alias("shock_resid_loo"),
    )


def purification_summary(purified: DataFrame) -> DataFrame:
    y, e, u = (F.col(c) for c in ("shock_target_10bp", "shock_resid_in", "shock_resid_loo"))
    tss = F.var_samp(y) * (F.count(y) - 1)
    return purified.agg(
        F.count(F.lit(1)).alias("n_events"),
        (1 - F.sum(e * e) / tss).alias("r2_in_sample"),
        (1 - F.sum(u * u) / tss).alias("r2_leave_one_out"),
        F.avg(F.abs(u)).alias("mean_abs_resid_loo"),
        F.stddev_samp(u).alias("sd_resid_loo"),
    )


def purified_panel(panel: DataFrame, purified: DataFrame) -> DataFrame:
    joined = panel.join(
        purified.select("event_date", F.col("shock_resid_loo").alias("shock_purified_10bp")), "event_date", "left"
    )
    shock = F.col("shock_purified_10bp")
    states = {"hike": "regime_hike", "preRV": "state_pre_rv_z", "memory": "ma3_target_10bp_z",
              "preRSVneg": "state_pre_rsvneg_z"}
    return joined.withColumns({f"target_purified_x_{k}": shock * F.col(c) for k, c in states.items()})


THRESHOLD_TERMS = ("shock_target_10bp", "state", "threshold_hi", "shock_x_threshold_hi", "root_gg")
THRESHOLD_EFFECTS = [
    R.Effect("slope_low", (("shock_target_10bp", 1.0),), None, "q_le_c"),
    R.Effect("slope_high", (("shock_target_10bp", 1.0), ("shock_x_threshold_hi", 1.0)), None, "q_gt_c"),
    R.Effect("delta_high_minus_low", (("shock_x_threshold_hi", 1.0),), None, "threshold_delta"),
]


def _functional_rows(panel: DataFrame, models: list[tuple[str, str, str]]) -> DataFrame:
    """Complete rows of every (name, outcome, state variable)."""
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("base"), F.col(y).cast("double").alias("y"), F.col(q).cast("double").alias("q"))
                for n, y, q in models
            ]
        )
    )
    return (
        panel.select("event_date", F.col("shock_target_10bp").alias("shock"), "root_gg", each.alias("m"))
        .select("event_date", "shock", "root_gg", "m.*")
        .dropna()
    )


def threshold_search(
    panel: DataFrame,
    models: list[tuple[str, str, str]],
    probs: tuple[float, ...] = tuple(round(0.20 + 0.05 * i, 2) for i in range(13)),
    min_share: float = 0.15,
    min_rows: int = 10,
) -> DataFrame:
    """Best-fitting threshold of each model with its fit: (base, threshold_c, n_left, n_right, fit)."""
    rows = _functional_rows(panel, models)
    per_event = rows.groupBy("base", "event_date").agg(F.avg("q").alias("q"))
    names = {f"c{i:02d}": p for i, p in enumerate(probs)}
    grid = grouped_quantiles(per_event, ["base"], "q", names).select(
        "base", F.posexplode(F.array_distinct(F.array(*names))).alias("cand", "threshold_c")
    )
    spread = rows.join(grid, "base").withColumns(
        {
            "hi": (F.col("q") > F.col("threshold_c")).cast("double"),
            "model_name": F.concat_ws("#", "base", F.lpad(F.col("cand").cast("string"), 2, "0")),
        }
    )
    sizes = spread.groupBy("model_name", "base", "threshold_c").agg(
        F.count_if(F.col("hi") == 0).alias("n_left"), F.count_if(F.col("hi") == 1).alias("n_right"), F.count(F.lit(1)).alias("n")
    )
    smallest = F.greatest(F.lit(min_rows), F.ceil(F.col("n") * min_share))
    allowed = sizes.where((F.col("n_left") >= smallest) & (F.col("n_right") >= smallest))
    vectors = spread.join(allowed.select("model_name"), "model_name", "left_semi").select(
        "model_name",
        F.col("event_date").cast("string").alias("cluster"),
        F.array(F.lit(1.0), "shock", "q", "hi", F.col("shock") * F.col("hi"), "root_gg").alias("x"),
        "y",
    )
    spec = panel.sparkSession.createDataFrame(
        [
            (f"{n}#{i:02d}", y, ["Intercept", *[q if t == "state" else t for t in THRESHOLD_TERMS]])
            for n, y, q in models
            for i in range(len(probs))
        ],
        "model_name string, outcome string, terms array<string>",
    )
    fitted = R.fits(R.gram(vectors, ["model_name"]), spec)
    order = Window.partitionBy("base").orderBy("sse", "model_name")
    best = (
        fitted.join(allowed, "model_name")
        .withColumn("_r", F.row_number().over(order))
        .where("_r = 1")
        .drop("_r", "n")
    )
    scores = R.cluster_scores(vectors, best)
    full = R.with_covariance(best.drop("base", "threshold_c", "n_left", "n_right"), R.score_products(scores))
    return full.join(best.select("model_name", "base", "threshold_c", "n_left", "n_right"), "model_name")


def spline_fits(
    panel: DataFrame,
    models: list[tuple[str, str, str]],
    knots: tuple[float, ...] = (0.25, 0.50, 0.75),
    grid: tuple[float, ...] = tuple(-2 + 0.5 * i for i in range(9)),
) -> tuple[DataFrame, DataFrame]:
    """(fits, slope rows on the grid) of a varying slope with truncated cubic terms.

    Knots are quantiles of the distinct state values; they stay a column, so the slope weights do too.
    """
    rows = _functional_rows(panel, models)
    names = {f"k{i}": p for i, p in enumerate(knots)}
    where = grouped_quantiles(rows.select("base", "q").distinct(), ["base"], "q", names)
    k = [F.col(c) for c in names]

    def vector(q: Column, shock: Column) -> list[Column]:
        return [shock, shock * q, *[shock * b for b in truncated_cubic_basis(q, k)]]

    joined = rows.join(where, "base")
    shocked = vector(F.col("q"), F.col("shock"))
    vectors = joined.select(
        F.col("base").alias("model_name"),
        F.col("event_date").cast("string").alias("cluster"),
        F.array(F.lit(1.0), "q", shocked[0], shocked[1], "root_gg", *shocked[2:]).alias("x"),
        "y",
    )
    spline = [f"shock_x_spline_{i + 1}" for i in range(len(knots))]
    spec = panel.sparkSession.createDataFrame(
        [(n, y, ["Intercept", q, "shock_target_10bp", "shock_x_q", "root_gg", *spline]) for n, y, q in models],
        "model_name string, outcome string, terms array<string>",
    )
    fitted = R.cluster_fit(vectors, spec)
    points = where.withColumnRenamed("base", "model_name").withColumn(
        "state_value", F.explode(F.array(*[F.lit(g) for g in grid]))
    )
    one = F.lit(1.0)
    load = vector(F.col("state_value"), one)
    points = points.select(
        "model_name", "state_value", F.array(F.lit(0.0), F.lit(0.0), load[0], load[1], F.lit(0.0), *load[2:]).alias("load")
    )
    return fitted, weighted_effects(fitted.join(points, "model_name"))


def weighted_effects(rows: DataFrame) -> DataFrame:
    """Estimates for fitted models joined with a weight vector ``load`` and a ``state_value``."""
    names = [c.split()[0] for c in EFFECT_SCHEMA.split(", ")]

    def each(parts):
        for pdf in parts:
            out = []
            for r in pdf.to_dict("records"):
                size = r["n_params"]
                cov = r["covariance"].reshape(size, size)
                est, var = r["load"] @ r["beta"], r["load"] @ cov @ r["load"]
                se = math.sqrt(max(var, 0.0))
                out.append(
                    {"model_name": r["model_name"], "outcome": r["outcome"],
                     "effect_name": f"slope_q_{r['state_value']:g}", "state_value": r["state_value"],
                     "estimate": est, "se": se, "note": "spline_grid"}
                    | {c: float(v) for c, v in t_columns(est, se, r["df"]).items()}
                )
            if out:
                yield pd.DataFrame(out)[names]

    return R.no_nan(rows.mapInPandas(each, EFFECT_SCHEMA))


