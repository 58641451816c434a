"""Fractional-response models: Newton steps for a whole battery, one job per step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import tails
from pulsegrid.functions.frames import dot
from pulsegrid.operators import regression as R
from pulsegrid.session import durable

TOLERANCE = 1e-10
MAX_STEPS = 300
MAX_HALVINGS = 30


def logistic(eta: Column) -> Column:
    z = F.greatest(F.least(eta, F.lit(35.0)), F.lit(-35.0))
    return 1.0 / (1.0 + F.exp(-z))


def _at(rows: DataFrame, betas: dict[str, np.ndarray]) -> DataFrame:
    """Rows of the given models with their mean under the given coefficients."""
    table = rows.sparkSession.createDataFrame(
        [(m, [float(v) for v in b]) for m, b in betas.items()], "model_name string, beta array<double>"
    )
    return rows.join(F.broadcast(table), "model_name").withColumn("eta", dot(F.col("x"), F.col("beta"))).withColumn(
        "mu", logistic(F.col("eta"))
    )


def _evaluate(rows: DataFrame, betas: dict[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray]]:
    """Log likelihood and weighted cross products (information and score) per model."""
    w = F.greatest(F.col("mu") * (1 - F.col("mu")), F.lit(1e-12))
    m = F.least(F.greatest(F.col("mu"), F.lit(1e-12)), F.lit(1 - 1e-12))
    here = _at(rows, betas).select(
        "model_name", w.alias("w"), F.concat("x", F.array((F.col("y") - F.col("mu")) / w)).alias("z"),
        (F.col("y") * F.log(m) + (1 - F.col("y")) * F.log(1 - m)).alias("ll"),
    )
    # Products and likelihood leave in one explode, so a step is one scan and one exchange.
    entry = lambda i, j, v: F.struct(i.alias("i"), j.alias("j"), v.alias("v"))
    products = F.flatten(F.transform("z", lambda a, i: F.transform("z", lambda b, j: entry(i, j, F.col("w") * a * b))))
    likelihood = F.array(entry(F.lit(-1), F.lit(-1), F.col("ll")))
    got = (
        here.select("model_name", F.explode(F.concat(products, likelihood)).alias("e"))
        .groupBy("model_name", "e.i", "e.j")
        .agg(F.sum("e.v").alias("v"))
        .toPandas()
    )
    out = {}
    for name, g in got.groupby("model_name"):
        body = g[g["i"] >= 0]
        out[name] = (float(g.loc[g["i"] < 0, "v"].iloc[0]), R.square(body["i"], body["j"], body["v"]))
    return out


def newton(rows: DataFrame, sizes: dict[str, int]) -> dict[str, dict]:
    """Coefficients, log likelihood, information and convergence of every model.

    Only numbers of size k x k per model come back from a step; converged models leave the scan.
    """
    beta = {m: np.zeros(k) for m, k in sizes.items()}
    state = _evaluate(rows, beta)
    done: dict[str, dict] = {}
    step = {m: np.linalg.solve(g[:-1, :-1] + 1e-10 * np.eye(sizes[m]), g[:-1, -1]) for m, (_, g) in state.items()}
    halvings = dict.fromkeys(sizes, 0)
    count = dict.fromkeys(sizes, 1)
    while step:
        active = rows.where(F.col("model_name").isin(list(step)))
        tried = {m: beta[m] + s for m, s in step.items()}
        for m, (ll, g) in _evaluate(active, tried).items():
            small = np.abs(step[m]).max() < TOLERANCE * (1 + np.abs(beta[m]).max())
            # A loss within the rounding of a distributed sum is no loss: the step is at its optimum.
            lost = ll < state[m][0] - 1e-12 * (1 + abs(state[m][0]))
            if lost and not small and halvings[m] < MAX_HALVINGS:
                step[m] = step[m] / 2
                halvings[m] += 1
                continue
            beta[m], state[m], halvings[m] = tried[m], (ll, g), 0
            if small or count[m] >= MAX_STEPS:
                done[m] = {"beta": beta[m], "loglik": ll, "gram": g, "converged": bool(small), "steps": count[m]}
                del step[m]
            else:
                count[m] += 1
                step[m] = np.linalg.solve(g[:-1, :-1] + 1e-10 * np.eye(sizes[m]), g[:-1, -1])
    return done


def _fitted_frame(rows: DataFrame, found: dict[str, dict], terms: dict[str, list[str]], outcome: dict[str, str]) -> DataFrame:
    facts = rows.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.stddev_samp("y").alias("s")
    ).toPandas().set_index("model_name")
    out = []
    for name, f in found.items():
        n, mean = int(facts.loc[name, "n"]), float(facts.loc[name, "m"])
        ll0 = n * (mean * np.log(mean) + (1 - mean) * np.log(1 - mean))
        k = len(f["beta"])
        out.append(
            (name, outcome[name], terms[name], f["beta"].tolist(), np.linalg.pinv(f["gram"][:-1, :-1]).ravel().tolist(),
             n, k, k, -2 * f["loglik"] + 2 * k, float(ll0), float(1 - f["loglik"] / ll0), f["loglik"], mean, float(facts.loc[name, "s"]))
        )
    return rows.sparkSession.createDataFrame(out, R.FIT_SCHEMA)


def _robust(rows: DataFrame, found: dict[str, dict], fitted: DataFrame) -> DataFrame:
    at = _at(rows, {m: f["beta"] for m, f in found.items()})
    scores = (
        at.select("model_name", "cluster", (F.col("y") - F.col("mu")).alias("u"), F.posexplode("x").alias("i", "xi"))
        .groupBy("model_name", "cluster", "i")
        .agg(F.sum(F.col("xi") * F.col("u")).alias("s"))
        .groupBy("model_name", "cluster")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("score"))
    )
    return R.with_covariance(fitted, R.score_products(scores))


def fractional_logit(panel: DataFrame, models: list[R.Model]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coefficients with average partial effects, model summary, diagnostics)."""
    rows = durable(R.design(panel, models))
    if outside := rows.where("y < 0 or y > 1").select("model_name").head():
        raise ValueError(f"outcome of {outside.model_name} has values outside [0, 1]")
    spec = {r["model_name"]: (r["outcome"], list(r["terms"])) for r in R.battery(panel, models).collect()}
    present = {r["model_name"] for r in rows.select("model_name").distinct().collect()}
    spec = {m: v for m, v in spec.items() if m in present}
    terms, outcome = {m: t for m, (_, t) in spec.items()}, {m: o for m, (o, _) in spec.items()}
    found = newton(rows, {m: len(t) for m, t in terms.items()})
    fitted = durable(_robust(rows, found, _fitted_frame(rows, found, terms, outcome)))

    at = _at(rows, {m: f["beta"] for m, f in found.items()})
    wider = durable(at.select(
        "model_name", "cluster",
        F.concat("x", F.array(F.col("eta") * F.col("eta"), F.pow("eta", 3))).alias("x"), "y",
    ))
    reset_terms = {m: [*t, "eta2", "eta3"] for m, t in terms.items()}
    reset = newton(wider, {m: len(t) for m, t in reset_terms.items()})
    reset_fit = _robust(wider, reset, _fitted_frame(wider, reset, reset_terms, outcome))
    settled = [m for m, f in reset.items() if f["converged"]]
    reset_p = wald_test(reset_fit.where(F.col("model_name").isin(settled)), [["eta2"], ["eta3"]]).select("model_name", F.col("p_value").alias("reset_p"))
    asym = asymmetry_test(fitted).select("model_name", F.col("p_value").alias("wald_asym_p"))

    effects = partial_effects(at, fitted)
    # The fit's adj_r2 slot carries the log likelihood, which belongs to the summary.
    coefs = R.coefficients(fitted).drop("adj_r2").withColumnsRenamed({"se": "se_cluster", "t_stat": "z_stat", "r2": "pseudo_r2"}).join(
        effects, ["model_name", "term"], "left"
    )
    steps = rows.sparkSession.createDataFrame(
        [(m, f["converged"], f["steps"]) for m, f in found.items()], "model_name string, converged boolean, n_iter int"
    )
    means = at.groupBy("model_name").agg(F.avg("mu").alias("mean_fitted"))
    summary = (
        fitted.select(
            "model_name", "outcome", F.array_join("terms", " + ").alias("rhs"), "n_obs", "n_clusters", "n_params",
            F.col("adj_r2").alias("loglik"), F.col("tss").alias("loglik_null"), F.col("r2").alias("pseudo_r2"),
            F.col("sse").alias("qaic_like"), "mean_depvar", "sd_depvar",
        )
        .join(steps, "model_name")
        .join(means, "model_name")
    )
    diagnostics = (
        summary.select("model_name", "qaic_like", "pseudo_r2", "n_obs", "n_clusters")
        .join(reset_p, "model_name", "left")
        .join(asym, "model_name", "left")
    )
    return coefs, summary, diagnostics


def wald_test(fitted: DataFrame, combos: list[list[str]], signs: tuple[float, ...] = (1.0,)) -> DataFrame:
    """F test that every listed combination of terms is zero, with clusters - 1 degrees of freedom."""

    def each(parts):
        for pdf in parts:
            out = []
            for r in pdf.to_dict("records"):
                terms, k = list(r["terms"]), r["n_params"]
                load = np.zeros((len(combos), k))
                for i, names in enumerate(combos):
                    for t, s in zip(names, signs):
                        load[i, terms.index(t)] = s
                v, b = load @ r["covariance"].reshape(k, k) @ load.T, load @ r["beta"]
                stat = float(b @ np.linalg.pinv(v) @ b) / len(combos)
                out.append((r["model_name"], stat, float(tails.f_upper(stat, len(combos), r["df"]))))
            yield pd.DataFrame(out, columns=["model_name", "f_stat", "p_value"])

    return R.no_nan(fitted.mapInPandas(each, "model_name string, f_stat double, p_value double"))


# Pairs of positive and negative parts.
ASYMMETRY_PAIRS = (("shock_pos_10bp", "shock_neg_mag_10bp"), ("pos_pca_10bp", "neg_mag_pca_10bp"))


def asymmetry_test(fitted: DataFrame) -> DataFrame:
    """Test that the positive and negative parts have equal coefficients."""
    parts = [
        wald_test(
            fitted.where(F.array_contains("terms", a) & F.array_contains("terms", b)), [[a, b]], (1.0, -1.0)
        )
        for a, b in ASYMMETRY_PAIRS
    ]
    return parts[0].unionByName(parts[1])


def partial_effects(at: DataFrame, fitted: DataFrame) -> DataFrame:
    """Average partial effects with delta-method errors: discrete for 0/1 terms, else marginal."""
    lam = F.col("mu") * (1 - F.col("mu"))
    rows = at.select("model_name", "x", "beta", "eta", lam.alias("l1"), (lam * (1 - 2 * F.col("mu"))).alias("l2"),
                     F.posexplode("x").alias("t", "xt")).where("t > 0")
    bt = F.get("beta", F.col("t"))
    m1, m0 = logistic(F.col("eta") + bt * (1 - F.col("xt"))), logistic(F.col("eta") - bt * F.col("xt"))
    rows = rows.withColumns({"bt": bt, "m1": m1, "m0": m0}).withColumns(
        {"d1": F.col("m1") * (1 - F.col("m1")), "d0": F.col("m0") * (1 - F.col("m0"))}
    )
    every = rows.select("*", F.posexplode("x").alias("l", "xl"))
    sums = every.groupBy("model_name", "t", "l").agg(
        F.bool_and(F.col("xt").isin(0.0, 1.0)).alias("binary"),
        F.avg(F.col("m1") - F.col("m0")).alias("jump"),
        F.avg(F.col("d1") * (1 - F.col("xt")) + F.col("d0") * F.col("xt")).alias("own"),
        F.avg((F.col("d1") - F.col("d0")) * F.col("xl")).alias("cross"),
        F.avg("l1").alias("slope"),
        F.avg(F.col("l2") * F.col("bt") * F.col("xl")).alias("curve"),
        F.max("bt").alias("bt"),
    )

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        terms, k = list(pdf["terms"].iloc[0]), int(pdf["n_params"].iloc[0])
        cov = np.asarray(pdf["covariance"].iloc[0], float).reshape(k, k)
        out = []
        for t, g in pdf.groupby("t"):
            g = g.sort_values("l")
            first, same = g.iloc[0], (g["l"] == t).to_numpy()
            if first["binary"]:
                ape, grad = first["jump"], np.where(same, g["own"], g["cross"])
            else:
                ape, grad = first["slope"] * first["bt"], g["curve"].to_numpy() + same * first["slope"]
            kind = "discrete" if first["binary"] else "marginal"
            out.append((pdf["model_name"].iloc[0], terms[int(t)], ape, float(np.sqrt(max(grad @ cov @ grad, 0))), kind))
        return pd.DataFrame(out, columns=["model_name", "term", "ape", "ape_se", "ape_type"])

    return sums.join(fitted.select("model_name", "terms", "n_params", "covariance"), "model_name").groupBy(
        "model_name"
    ).applyInPandas(finish, "model_name string, term string, ape double, ape_se double, ape_type string")
