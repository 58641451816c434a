"""Batteries of regressions as aggregates of sufficient statistics.

All models of a battery are fitted together. Each complete row of each model becomes a vector
(1, regressors, outcome). Cross products are summed per model in Spark, with map-side combining; a second
pass sums scores per (model, cluster). Fits that leave a group out subtract that group's cross products.
Only the k x k solve runs in NumPy, once per model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import packed, tails
from pulsegrid.functions.frames import dot


@dataclass(frozen=True)
class Model:
    name: str
    outcome: str
    terms: tuple[str, ...]
    where: str | None = None
    cluster: str = "event_date"


FIT_SCHEMA = (
    "model_name string, outcome string, terms array<string>, beta array<double>, inverse array<double>, "
    "n_obs long, n_params int, rank_design int, sse double, tss double, r2 double, adj_r2 double, "
    "mean_depvar double, sd_depvar double"
)


def design(panel: DataFrame, models: list[Model], extra: list[str] | None = None) -> DataFrame:
    """(model_name, cluster, x, y) for the complete rows of every model; one scan for the battery."""
    have = set(panel.columns)
    usable = [m for m in models if set(m.terms) | {m.outcome} <= have]
    candidates = []
    for m in usable:
        needed = [F.col(c).isNotNull() for c in (m.outcome, *m.terms, m.cluster)]
        keep = F.expr(m.where) if m.where else F.lit(True)
        for c in needed:
            keep = keep & c
        candidates.append(
            F.when(
                keep,
                F.struct(
                    F.lit(m.name).alias("model_name"),
                    F.col(m.cluster).cast("string").alias("cluster"),
                    F.array(F.lit(1.0), *[F.col(t).cast("double") for t in m.terms]).alias("x"),
                    F.col(m.outcome).cast("double").alias("y"),
                ),
            )
        )
    rows = panel.select(*(extra or []), F.explode(F.array(*candidates)).alias("d"))
    return rows.where("d is not null").select(*(extra or []), "d.*")


def battery(panel: DataFrame, models: list[Model]) -> DataFrame:
    """(model_name, outcome, terms): the specification as data, for models the panel can serve."""
    have = set(panel.columns)
    rows = [(m.name, m.outcome, ["Intercept", *m.terms]) for m in models if set(m.terms) | {m.outcome} <= have]
    return panel.sparkSession.createDataFrame(rows, "model_name string, outcome string, terms array<string>")


def gram(rows: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Sums of cross products (keys, i, j, v) of the vectors (x, y)."""
    w = F.lit(1.0) if weight is None else weight
    z = rows.select(*keys, F.concat("x", F.array("y")).alias("z"), w.alias("w"))
    left = z.select(*keys, "z", "w", F.posexplode("z").alias("i", "zi"))
    both = left.select(*keys, "w", "i", "zi", F.posexplode("z").alias("j", "zj"))
    return both.groupBy(*keys, "i", "j").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("v"))


def square(i, j, v) -> np.ndarray:
    size = int(max(i)) + 1
    out = np.zeros((size, size))
    out[np.asarray(i, int), np.asarray(j, int)] = v
    return out


def solve(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients, inverse cross products and rank from the cross products of (x, y)."""
    xx, xy = g[:-1, :-1], g[:-1, -1]
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    values, vectors = np.linalg.eigh(xx / np.outer(scale, scale))
    keep = values > max(values.max(), 0.0) * 1e-11
    inner = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
    inverse = inner / np.outer(scale, scale)
    return inverse @ xy, inverse, int(keep.sum())


def squared_error(g: np.ndarray, beta: np.ndarray) -> float:
    c = np.append(-beta, 1.0)
    return float(max(c @ g @ c, 0.0))


def fit_row(g: np.ndarray) -> dict:
    beta, inverse, rank = solve(g)
    n, k = g[0, 0], len(beta)
    sse, mean = squared_error(g, beta), g[0, -1] / n
    tss = max(g[-1, -1] - n * mean * mean, 0.0)
    r2 = 1.0 - sse / tss if tss > 0 else np.nan
    return {
        "beta": beta.tolist(),
        "inverse": inverse.ravel().tolist(),
        "n_obs": int(round(n)),
        "n_params": k,
        "rank_design": rank,
        "sse": sse,
        "tss": tss,
        "r2": r2,
        "adj_r2": 1.0 - (1.0 - r2) * (n - 1) / max(n - k, 1),
        "mean_depvar": mean,
        "sd_depvar": float(np.sqrt(tss / (n - 1))) if n > 1 else np.nan,
    }


def fits(total: DataFrame, spec: DataFrame) -> DataFrame:
    """One fitted row per model from its summed cross products (a group is (k + 1)^2 rows)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        row = fit_row(square(pdf["i"], pdf["j"], pdf["v"]))
        row |= {c: pdf[c].iloc[0] for c in ("model_name", "outcome", "terms")}
        return pd.DataFrame([row])

    return no_nan(total.join(F.broadcast(spec), "model_name").groupBy("model_name").applyInPandas(one, FIT_SCHEMA))


def no_nan(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def cluster_scores(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Score vector of every (model, cluster): its vectors times their residuals, summed."""
    coef = fitted.select("model_name", "beta")
    return (
        rows.join(coef, "model_name")
        .select("model_name", "cluster", (F.col("y") - dot(F.col("x"), F.col("beta"))).alias("u"),
                F.posexplode("x").alias("i", "xi"))
        .groupBy("model_name", "cluster", "i")
        .agg(F.sum(F.col("xi") * F.col("u")).alias("s"))
        .groupBy("model_name", "cluster")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("score"))
    )


def score_products(scores: DataFrame) -> DataFrame:
    """Summed outer products of scores and their number, per model."""
    i = scores.select("model_name", "score", F.posexplode("score").alias("i", "si"))
    pairs = i.select("model_name", "i", "si", F.posexplode("score").alias("j", "sj"))
    sums = pairs.groupBy("model_name", "i", "j").agg(
        F.sum(F.col("si") * F.col("sj")).alias("m"), F.count(F.lit(1)).alias("g")
    )
    return sums.groupBy("model_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "m"))), lambda e: e["m"]).alias("meat"),
        F.max("g").alias("n_scores"),
    )


COVARIANCE_SCHEMA = FIT_SCHEMA + ", n_clusters long, df double, covariance array<double>"


def _sandwich(pdf: pd.DataFrame, clustered: bool) -> pd.DataFrame:
    out = []
    for row in pdf.to_dict("records"):
        k, n, g = row["n_params"], row["n_obs"], row.pop("n_scores")
        bread = np.asarray(row["inverse"]).reshape(k, k)
        v = bread @ np.asarray(row.pop("meat")).reshape(k, k) @ bread
        if clustered:
            ok = g > 1 and n > k
            v = v * (g / (g - 1) * (n - 1) / (n - k)) if ok else np.full((k, k), np.nan)
        row |= {
            "covariance": v.ravel().tolist(),
            "n_clusters": g,
            "df": float(max(g - 1, 1) if clustered else max(n - k, 1)),
        }
        out.append(row)
    return pd.DataFrame(out)


def with_covariance(fitted: DataFrame, products: DataFrame, clustered: bool = True) -> DataFrame:
    names = [c.strip().split()[0] for c in COVARIANCE_SCHEMA.split(", ")]
    joined = fitted.join(products, "model_name")
    return no_nan(joined.mapInPandas(
        lambda parts: (_sandwich(p, clustered)[names] for p in parts if len(p)), COVARIANCE_SCHEMA
    ))


def cluster_ols(panel: DataFrame, models: list[Model]) -> DataFrame:
    """Fits of a battery with cluster-robust covariance; t tests use clusters - 1 degrees of freedom."""
    return cluster_fit(design(panel, models), battery(panel, models))


def cluster_fit(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """Two passes over the rows: cross products per model, then scores per cluster."""
    fitted = fits(gram(rows, ["model_name"]), spec)
    return with_covariance(fitted, score_products(cluster_scores(rows, fitted)))


def leverage(x: Column, inverse: Column) -> Column:
    """x' A x with A, the inverse of X'X, row by row."""
    return dot(x, packed.times(inverse, x, F.size(x)))


def hc3_ols(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """Fits with leverage-adjusted covariance; t tests use n - k degrees of freedom."""
    fitted = fits(gram(rows, ["model_name"]), spec)
    known = rows.join(fitted.select("model_name", "beta", "inverse"), "model_name").withColumn(
        "u", (F.col("y") - dot(F.col("x"), F.col("beta"))) / F.greatest(1 - leverage(F.col("x"), F.col("inverse")), F.lit(1e-8))
    )
    scored = known.select("model_name", F.transform("x", lambda v: v * F.col("u")).alias("score"))
    return with_covariance(fitted, score_products(scored), clustered=False)


def predicted(x: Column, beta: Column) -> Column:
    return dot(x, beta)


COEF_SCHEMA = (
    "model_name string, outcome string, term string, beta double, se double, t_stat double, "
    "p_value double, ci95_lo double, ci95_hi double, n_obs long, n_clusters long, r2 double, adj_r2 double"
)


def t_columns(est, se, df) -> dict:
    est, se, df = (np.asarray(v, float) for v in (est, se, df))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(se > 0, est / se, np.nan)
    crit = tails.t_critical(df)
    return {
        "t_stat": t,
        "p_value": tails.t_two_sided(t, df),
        "ci95_lo": est - crit * se,
        "ci95_hi": est + crit * se,
    }


def coefficients(fitted: DataFrame) -> DataFrame:
    """Coefficient rows of fitted models with covariance."""

    def rows(parts):
        for pdf in parts:
            out = []
            for r in pdf.to_dict("records"):
                k = r["n_params"]
                beta = np.asarray(r["beta"])
                se = np.sqrt(np.maximum(np.diag(np.asarray(r["covariance"], float).reshape(k, k)), 0))
                base = {c: r[c] for c in ("model_name", "outcome", "n_obs", "n_clusters", "r2", "adj_r2")}
                cols = t_columns(beta, se, np.full(k, r["df"]))
                out += [
                    base | {"term": t, "beta": b, "se": s} | {c: v[i] for c, v in cols.items()}
                    for i, (t, b, s) in enumerate(zip(r["terms"], beta, se))
                ]
            names = [c.split()[0] for c in COEF_SCHEMA.split(", ")]
            if out:
                yield pd.DataFrame(out)[names]

    return no_nan(fitted.mapInPandas(rows, COEF_SCHEMA))


def model_summary(fitted: DataFrame) -> DataFrame:
    return fitted.select(
        "model_name", "outcome", F.array_join("terms", " + ").alias("rhs"), "n_obs", "n_clusters",
        "n_params", "rank_design", "r2", "adj_r2", "mean_depvar", "sd_depvar",
    )


@dataclass(frozen=True)
class Effect:
    """A linear combination of coefficients, present when all its terms are in the model."""

    name: str
    weights: tuple[tuple[str, float], ...]
    value: float | None = None
    note: str = ""
    models: tuple[str, ...] = ()


EFFECT_SCHEMA = (
    "model_name string, outcome string, effect_name string, state_value double, estimate double, "
    "se double, t_stat double, p_value double, ci95_lo double, ci95_hi double, note string"
)


def linear_effects(fitted: DataFrame, effects: list[Effect]) -> DataFrame:
    """Estimates L'b with sqrt(L'VL) for every effect a model has the terms for."""
    names = [c.split()[0] for c in EFFECT_SCHEMA.split(", ")]

    def rows(parts):
        for pdf in parts:
            out = []
            for r in pdf.to_dict("records"):
                terms = list(r["terms"])
                k = len(terms)
                beta = np.asarray(r["beta"])
                cov = np.asarray(r["covariance"], float).reshape(k, k)
                for e in effects:
                    if e.models and r["model_name"] not in e.models:
                        continue
                    if not all(t in terms for t, _ in e.weights):
                        continue
                    load = np.zeros(k)
                    for t, w in e.weights:
                        load[terms.index(t)] = w
                    est, se = load @ beta, np.sqrt(max(load @ cov @ load, 0))
                    out.append(
                        {"model_name": r["model_name"], "outcome": r["outcome"], "effect_name": e.name,
                         "state_value": e.value, "estimate": est, "se": se, "note": e.note}
                        | {c: float(v) for c, v in t_columns(est, se, r["df"]).items()}
                    )
            if out:
                yield pd.DataFrame(out)[names]

    return no_nan(fitted.mapInPandas(rows, EFFECT_SCHEMA))


def state_effects(shock: str = "shock_target_10bp", prefix: str = "target") -> list[Effect]:
    """Baseline slope, slopes by regime and by pre-state level, and the interaction itself."""
    out = [Effect("slope_baseline", ((shock, 1.0),), None, "baseline")]
    hike = f"{prefix}_x_hike"
    for h in (0.0, 1.0):
        out.append(Effect(f"slope_H{h:.0f}", ((shock, 1.0), (hike, h)), h, f"regime_hike={h:.0f}"))
    out.append(Effect("delta_regime", ((hike, 1.0),), 1.0, "interaction"))
    for label, term in (("preRV", "preRV"), ("memory", "memory"), ("preRSVneg", "preRSVneg")):
        inter = f"{prefix}_x_{term}"
        for z in (-1, 0, 1):
            out.append(Effect(f"slope_{label}_z_{z}", ((shock, 1.0), (inter, float(z))), float(z), label))
        out.append(Effect(f"delta_{label}_per1sd", ((inter, 1.0),), 1.0, "interaction"))
    return out
