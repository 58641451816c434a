"""Residual predictability: cross-fits, history tests, expanding forecasts, long memory."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import packed, tails
from pulsegrid.functions.frames import date_sequence, dot, from_previous, total_before
from pulsegrid.functions.quantiles import grouped_quantiles
from pulsegrid.operators import regression as R
from pulsegrid.operators.regression import no_nan
from pulsegrid.operators.resampling import block_bootstrap_mean
from pulsegrid.session import durable

# State blocks of the full model and forecasting history.
STATE_BLOCKS = (
    ("regime_hike", "target_x_hike"),
    ("state_pre_rv_z", "target_x_preRV"),
    ("state_pre_rsvneg_z", "target_x_preRSVneg"),
    ("ma3_target_10bp_z", "target_x_memory"),
    ("T_e", "target_x_T"),
    ("P_e", "target_x_P"),
)
HISTORY = ("hist_y_lag1", "hist_y_lag2", "hist_shock_lag1", "hist_shock_lag2", "hist_preRV_lag1")
ALPHAS = (0.50, 0.60, 0.65, 0.70)
D_BOUNDS = (-0.45, 0.75)


def usable_columns(panel: DataFrame, names: list[str], at_least: int = 60) -> list[str]:
    """Columns with enough known values and some spread, in one aggregate."""
    have = [n for n in names if n in panel.columns]
    row = panel.agg(*[F.count(n).alias(f"n_{n}") for n in have], *[F.stddev_samp(n).alias(f"s_{n}") for n in have]).first()
    return [n for n in have if row[f"n_{n}"] >= at_least and (row[f"s_{n}"] or 0) > 0]


def specifications(panel: DataFrame) -> dict[str, tuple[str, ...]]:
    """Mean, tension and full-state regressors; the full model keeps the blocks the data can serve."""
    usable = set(usable_columns(panel, [c for b in STATE_BLOCKS for c in b]))
    full = ["shock_target_10bp"]
    for block in STATE_BLOCKS:
        if set(block) <= usable:
            full += block
    return {
        "M0_mean": ("shock_target_10bp", "root_gg"),
        "M1_tension": ("shock_target_10bp", "state_pre_rv_z", "target_x_preRV", "root_gg"),
        "M2_full": (*full, "root_gg"),
    }


def battery(specs: dict[str, tuple[str, ...]], outcomes: list[str]) -> list[R.Model]:
    return [R.Model(f"{y}|{n}", y, x) for y in outcomes for n, x in specs.items()]


def date_products(rows: DataFrame) -> DataFrame:
    """(model_name, event_date, g): packed cross products of (x, y) per model and date."""
    return packed.summed(rows.select("model_name", "event_date", packed.products(F.concat("x", F.array("y"))).alias("g")), ["model_name", "event_date"], "g")


def trained(sums: DataFrame) -> DataFrame:
    """Coefficients of every (model, date) whose training rows outnumber its columns."""
    known = sums.withColumn("n_train_obs", F.round(F.get("g", F.lit(0))).cast("long")).where(F.col("n_train_obs") > packed.side(F.col("g")) - 1)
    return packed.solved(known, ["model_name", "event_date", "n_train_obs", "n_train_events"], "g")


def cross_fit(panel: DataFrame, models: list[R.Model]) -> DataFrame:
    """Predictions of every event from a fit to all other events.

    Each event's cross products are subtracted from the total; every (model, event) is a solve of its own.
    """
    rows = R.design(panel, models, ["event_date", "root_code", "shock_target_10bp", "state_pre_rv_z"])
    per_event = durable(date_products(rows))
    total = packed.summed(per_event, ["model_name"], "g").join(per_event.groupBy("model_name").agg((F.count(F.lit(1)) - 1).alias("n_train_events")), "model_name")
    others = per_event.join(total.withColumnRenamed("g", "total"), "model_name").select(
        "model_name", "event_date", "n_train_events", F.zip_with("total", "g", lambda x, y: x - y).alias("g"))
    betas = trained(others).withColumnsRenamed({"beta": "b", "rank": "rank_x"}).withColumn("n_parameters", F.size("b"))
    fitted = dot(F.col("x"), F.col("b"))
    name = F.split("model_name", r"\|")
    return rows.join(betas, ["model_name", "event_date"]).select(
        "event_date", "root_code", F.get(name, F.lit(0)).alias("outcome"), F.get(name, F.lit(1)).alias("model_name"),
        F.col("y").alias("observed_y"), fitted.alias("fitted_cf"), (F.col("y") - fitted).alias("residual_cf"),
        "shock_target_10bp", "state_pre_rv_z", "n_train_obs", "n_train_events", "n_parameters", "rank_x",
        (F.col("rank_x") < F.col("n_parameters")).alias("rank_deficient"),
    )


def _lags(x: np.ndarray, depth: int) -> list[np.ndarray]:
    return [np.r_[np.full(min(k, len(x)), np.nan), x[: max(len(x) - k, 0)]] for k in range(1, depth + 1)]


def _f_statistic(y: np.ndarray, z: np.ndarray) -> tuple[float, int, int]:
    ok = np.isfinite(y) & np.isfinite(z).all(axis=1)
    y, z = y[ok], z[ok]
    n, q = z.shape
    if n <= q + 1:
        return math.nan, n, q
    x = np.column_stack([np.ones(n), z])
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    rss = float(((y - x @ beta) ** 2).sum())
    if rank < q + 1 or rss <= 0:
        return math.nan, n, q
    restricted = float(((y - y.mean()) ** 2).sum())
    return max((restricted - rss) / q / (rss / (n - q - 1)), 0.0), n, q


def _block_signs(seed: int, draw: int, n: int, block: int) -> np.ndarray:
    """Signs of one draw, a pure function of (seed, draw): equal inside blocks, shifted around the circle."""
    rng = np.random.Generator(np.random.Philox(key=seed, counter=draw))
    signs = np.repeat(rng.integers(0, 2, -(-n // block)) * 2.0 - 1.0, block)[:n]
    return np.roll(signs, int(rng.integers(0, block)))


def history_tests(
    residuals: DataFrame, max_lag: int = 3, draws: int = 999, block: int = 5, seed: int = 1, min_length: int = 30, per_task: int = 32
) -> DataFrame:
    """Joint tests that residual lags, or lags of residual, shock and state, predict the residual.

    A task holds one series (one row per event date), one lag order and one share of the draws.
    """
    keys = ["outcome", "model_name", "root_code"]
    size, parts = per_task, -(-draws // per_task)
    spread = residuals.select(*keys, "event_date", "residual_cf", "shock_target_10bp", "state_pre_rv_z").withColumns(
        {
            "lag_order": F.explode(F.sequence(F.lit(1), F.lit(max_lag))),
            "test_type": F.explode(F.array(F.lit("residual_lags"), F.lit("extended_history"))),
        }
    ).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_date", kind="stable")
        depth, part = int(pdf["lag_order"].iloc[0]), int(pdf["part"].iloc[0])
        extended = pdf["test_type"].iloc[0] == "extended_history"
        if extended:
            pdf = pdf.dropna(subset=["residual_cf", "shock_target_10bp", "state_pre_rv_z"])
        y = pdf["residual_cf"].to_numpy(float)
        fixed = [v for c in ("shock_target_10bp", "state_pre_rv_z") for v in _lags(pdf[c].to_numpy(float), depth)] if extended else []
        stat, n, q = _f_statistic(y, np.column_stack(_lags(y, depth) + fixed)) if len(y) > depth else (math.nan, 0, 0)
        exceed = usable = 0
        if math.isfinite(stat) and len(y) > depth + 5:
            for draw in range(part * size + 1, min((part + 1) * size, draws) + 1):
                star = y.mean() + (y - y.mean()) * _block_signs(seed, draw, len(y), block)
                f = _f_statistic(star, np.column_stack(_lags(star, depth) + fixed))[0]
                usable += math.isfinite(f)
                exceed += math.isfinite(f) and f >= stat
        p = float(tails.f_upper(stat, q, n - q - 1)) if math.isfinite(stat) else math.nan
        first = {c: pdf[c].iloc[0] for c in [*keys, "test_type", "lag_order"]} if len(pdf) else {}
        return pd.DataFrame([first | {"n_obs": n, "n_restrictions": q, "f_stat": stat, "p_classical": p, "exceed": exceed,
                                      "usable": usable, "length": len(y)}] if first else [], columns=names)

    names = [*keys, "test_type", "lag_order", "n_obs", "n_restrictions", "f_stat", "p_classical", "exceed", "usable", "length"]
    schema = ("outcome string, model_name string, root_code string, test_type string, lag_order int, n_obs long, "
              "n_restrictions int, f_stat double, p_classical double, exceed long, usable long, length long")
    out = no_nan(spread.groupBy(*keys, "test_type", "lag_order", "part").applyInPandas(each, schema))
    return out.where(F.col("length") >= min_length).groupBy(*keys, "test_type", "lag_order").agg(
        *[F.max(c).alias(c) for c in ("n_obs", "n_restrictions", "f_stat", "p_classical")],
        F.when(F.sum("usable") > 0, (1 + F.sum("exceed")) / (1 + F.sum("usable"))).alias("p_block_wild"),
    )


def with_history(panel: DataFrame, outcome: str) -> DataFrame:
    """Lags of outcome, shock and pre-release state per root."""
    at = lambda c, back: F.max(F.when(F.col("back") == back, F.col(c)))
    ordered = date_sequence(panel, "event_date", ["root_code"])
    return from_previous(
        ordered, ["root_code"], 2,
        [
            at(outcome, 1).alias("hist_y_lag1"), at(outcome, 2).alias("hist_y_lag2"),
            at("shock_target_10bp", 1).alias("hist_shock_lag1"), at("shock_target_10bp", 2).alias("hist_shock_lag2"),
            at("state_pre_rv_z", 1).alias("hist_preRV_lag1"),
        ],
    )


def expanding_forecasts(panel: DataFrame, outcome: str, specs: dict[str, tuple[str, ...]], min_events: int = 45) -> DataFrame:
    """Forecasts of each event from earlier events only, with and without history terms.

    Cross products are summed per date and accumulated over dates, and every (model, date) is a solve of its own.
    """
    rows = with_history(panel, outcome)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in HISTORY)
    models = []
    for name, x in specs.items():
        models.append(R.Model(f"{name}|state", outcome, x, complete))
        models.append(R.Model(f"{name}|history", outcome, (*x, *[h for h in HISTORY if h not in x])))
    vectors = R.design(rows, models, ["event_date", "root_code"])
    per_date = durable(date_products(vectors))
    # Sums over earlier dates, place by place: year totals first, then inside the year.
    places = per_date.select("model_name", "event_date", F.posexplode("g").alias("place", "v"))
    before = total_before(places, ["model_name", "place"], "event_date", "v", "sum").where("sum IS NOT NULL")
    sums = before.groupBy("model_name", "event_date").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "sum"))), lambda e: e["sum"]).alias("g"))
    nth = date_sequence(per_date.select("model_name", "event_date"), "event_date", ["model_name"]).select(
        "model_name", "event_date", (F.col("seq") - 1).cast("int").alias("n_train_events"))
    betas = trained(sums.join(nth, ["model_name", "event_date"]).where(F.col("n_train_events") >= min_events)).withColumnRenamed("beta", "b")
    name = F.split("model_name", r"\|")
    tall = vectors.join(betas, ["model_name", "event_date"]).select(
        "event_date", "root_code", F.get(name, F.lit(0)).alias("state_model"), F.get(name, F.lit(1)).alias("kind"), "y",
        dot(F.col("x"), F.col("b")).alias("pred"), "n_train_obs", "n_train_events",
    )
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("pred")))
    wide = tall.groupBy("event_date", "root_code", "state_model").agg(
        F.max("y").alias("observed_y"), of("state").alias("pred_state"), of("history").alias("pred_state_history"),
        F.max("n_train_obs").alias("n_train_obs"), F.max("n_train_events").alias("n_train_events"),
    ).where("pred_state is not null and pred_state_history is not null")
    err = lambda c: F.pow(F.col("observed_y") - F.col(c), 2)
    return wide.withColumns(
        {"outcome": F.lit(outcome), "sqerr_state": err("pred_state"), "sqerr_state_history": err("pred_state_history")}
    ).withColumn("loss_diff", F.col("sqerr_state") - F.col("sqerr_state_history"))


def forecast_summary(forecasts: DataFrame, draws: int = 999, block: int = 5, seed: int = 1) -> DataFrame:
    """Mean squared errors, their gap and its block-bootstrap interval, per root and pooled."""
    keys = ["outcome", "state_model", "root_code"]
    both = forecasts.withColumn("root_code", F.explode(F.array("root_code", F.lit("pooled"))))
    stats = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_forecast_rows"), F.count_distinct("event_date").alias("n_forecast_events"),
        F.avg("sqerr_state").alias("mse_state"), F.avg("sqerr_state_history").alias("mse_state_history"),
    ).withColumn("delta_mse", F.col("mse_state") - F.col("mse_state_history"))
    events = date_sequence(both.groupBy(*keys, "event_date").agg(F.avg("loss_diff").alias("gap")), "event_date", keys)
    means = block_bootstrap_mean(events, keys, "gap", draws, block, seed)
    bounds = grouped_quantiles(means, keys, "mean", {"ci_low": 0.025, "ci_high": 0.975})
    above = means.groupBy(*keys).agg(F.avg((F.col("mean") > 0).cast("double")).alias("prob_delta_positive"))
    return stats.join(bounds, keys, "left").join(above, keys, "left").withColumns(
        {"bootstrap_rep": F.lit(draws), "block_length": F.lit(block)}
    )


def periodogram(series: DataFrame, keys: list[str], value: str, day: str = "event_date", alpha: float = max(ALPHAS)) -> DataFrame:
    """Power at the first Fourier frequencies of each demeaned series: sums of x cos and x sin."""
    known = date_sequence(series.where(F.col(value).isNotNull()).select(*keys, day, value), day, keys)
    size = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    rows = known.join(size, keys).withColumn("m", frequencies(F.col("n"), F.lit(alpha))).where("m >= 2")
    spread = rows.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("m"))))
    angle = F.lit(2 * math.pi) * F.col("j") * (F.col("seq") - 1) / F.col("n")
    x = F.col(value) - F.col("mean")
    sums = spread.groupBy(*keys, "j", "n").agg(F.sum(x * F.cos(angle)).alias("c"), F.sum(x * F.sin(angle)).alias("s"))
    return sums.select(
        *keys, "j", "n", (F.lit(2 * math.pi) * F.col("j") / F.col("n")).alias("frequency"),
        ((F.col("c") * F.col("c") + F.col("s") * F.col("s")) / (F.lit(2 * math.pi) * F.col("n"))).alias("power"),
    )


def frequencies(n, alpha):
    """Number of frequencies: floor(n ^ alpha), at least 5, at most (n - 1) / 2."""
    return F.least(F.greatest(F.floor(F.pow(n.cast("double"), alpha)), F.lit(5)), F.floor((n - 1) / 2)).cast("int")


def local_whittle(power: DataFrame, keys: list[str], alphas: tuple[float, ...] = ALPHAS, min_length: int = 30) -> DataFrame:
    """Memory parameter d per series and bandwidth, by nested grids inside the bounds.

    Each pass scores a few d values per series with one aggregate and narrows the grid around the best.
    """
    rows = power.where(F.col("n") >= min_length).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    rows = rows.withColumn("m", frequencies(F.col("n"), F.col("alpha"))).where(F.col("j") <= F.col("m"))
    by = [*keys, "alpha", "n", "m"]
    power_ = F.greatest(F.col("power"), F.lit(2.2250738585072014e-308))
    rows = rows.select(*by, F.log("frequency").alias("lf"), power_.alias("p"))
    low, high = D_BOUNDS
    best, step = rows.select(*by).distinct().withColumn("d", F.lit((low + high) / 2)), (high - low) / 2
    for points in (60, 20, 20, 20, 20):
        tried = best.withColumn("d0", F.explode(F.sequence(F.lit(-points), F.lit(points)))).select(
            *by, F.least(F.greatest(F.col("d") + F.col("d0") * F.lit(step / points), F.lit(low)), F.lit(high)).alias("d")
        )
        d = F.col("d")
        score = F.log(F.avg(F.exp(2 * d * F.col("lf")) * F.col("p"))) - 2 * d * F.avg("lf")
        best = rows.join(tried, by).groupBy(*by, "d").agg(score.alias("obj")).groupBy(*by).agg(F.min_by("d", "obj").alias("d"))
        step = step / points
    se = 1 / (2 * F.sqrt(F.col("m").cast("double")))
    return best.select(
        *keys, "alpha", F.col("n").alias("n_obs"), F.col("m").alias("m_frequencies"), F.col("d").alias("d_hat"),
        (F.col("d") + 0.5).alias("H_hat"), se.alias("asymptotic_se"), (F.col("d") - 1.96 * se).alias("ci_low"), (F.col("d") + 1.96 * se).alias("ci_high"),
    )


