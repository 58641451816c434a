"""Sparse-group lasso on fold cross products, with event folds and the one-standard-error choice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.operators import regression as R
from pulsegrid.operators.regression import no_nan, square
from pulsegrid.session import durable

# Outcomes, feature blocks and path settings.
OUTCOMES = ("PR_abs_jump", "asinh_PR_rv", "asinh_PR_rsv_neg")
BLOCKS = {
    "shock": ("shock_target_10bp",),
    "regime": ("regime_hike", "target_x_hike"),
    "uncert_rv": ("state_pre_rv_z", "target_x_preRV"),
    "uncert_dn": ("state_pre_rsvneg_z", "target_x_preRSVneg"),
    "memory_m1": ("M1_e_z", "target_x_M1"),
    "memory_ma3": ("ma3_target_10bp_z", "target_x_memory"),
    "curve": ("T_e", "target_x_T", "P_e", "target_x_P"),
    "asset": ("root_gg",),
}
ALPHA = 0.60
FOLDS = 10
LAMBDA_RATIO = 0.05
LAMBDAS = 40
MAX_STEPS = 3000
TOLERANCE = 1e-7


def _scaled(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix that turns (1, x, y) into (standardised x, centred y), with means and sds, from the full sample."""
    n, p = g[0, 0], len(g) - 2
    mean = g[0, 1:] / n
    var = (np.diag(g)[1:-1] - n * mean[:-1] ** 2) / (n - 1)
    sd = np.where(var > 1e-24, np.sqrt(np.maximum(var, 0)), 1.0)
    t = np.zeros((p + 2, p + 1))
    t[0, :-1], t[0, -1] = -mean[:-1] / sd, -mean[-1]
    t[1:-1, :-1], t[-1, -1] = np.diag(1 / sd), 1.0
    return t, mean, sd


def _path_step(xx, xy, n, groups, lam, beta, lip) -> np.ndarray:
    """Accelerated proximal gradient on cross products."""
    step = 1 / max(lip, 1e-10)
    z, momentum = beta, 1.0
    for _ in range(MAX_STEPS):
        old = beta
        v = z - step * (xx @ z - xy) / n
        s = np.sign(v) * np.maximum(np.abs(v) - step * lam * ALPHA, 0)
        norm = np.sqrt(np.bincount(groups, s * s))
        shrink = np.where(norm > 0, np.maximum(1 - step * lam * (1 - ALPHA) / np.where(norm > 0, norm, 1), 0), 0)
        beta = s * shrink[groups]
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        z, momentum = beta + (momentum - 1) / following * (beta - old), following
        if np.linalg.norm(beta - old) <= TOLERANCE * max(1, np.linalg.norm(old)):
            break
    return beta


def lambda_grid(xy: np.ndarray, n: float) -> np.ndarray:
    top = max(np.abs(xy).max() / n, 1e-6)
    return np.exp(np.linspace(np.log(top), np.log(top * LAMBDA_RATIO), LAMBDAS))


def features_of(panel: DataFrame) -> tuple[tuple[str, ...], list[int], list[str]]:
    """Present features with the number of their block."""
    names, groups, labels = [], [], []
    for block, cols in BLOCKS.items():
        have = [c for c in cols if c in panel.columns]
        if have:
            names += have
            groups += [len(labels)] * len(have)
            labels.append(block)
    return tuple(names), groups, labels


def fold_products(panel: DataFrame, outcomes=OUTCOMES, seed: int = 20260711) -> DataFrame:
    """Cross products per (outcome, fold); a fold takes every tenth event in hashed order."""
    names, _, _ = features_of(panel)
    rows = R.design(panel, [R.Model(y, y, names) for y in outcomes])
    order = Window.partitionBy("model_name").orderBy(F.xxhash64(F.lit(seed), "cluster"), "cluster")
    folds = rows.select("model_name", "cluster").distinct().withColumn(
        "fold", F.pmod(F.row_number().over(order) - 1, F.lit(FOLDS)).cast("int")
    )
    return R.gram(rows.join(folds, ["model_name", "cluster"]), ["model_name", "fold"])


def cv_errors(products: DataFrame, groups: list[int]) -> DataFrame:
    """(outcome, fold, idx, lambda, mse): the path fitted without each fold and scored on it."""
    spread = products.withColumn("test", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {f: square(g["i"], g["j"], g["v"]) for f, g in pdf.groupby("fold")}
        test, total, block = int(pdf["test"].iloc[0]), sum(parts.values()), np.asarray(groups)
        t, _, _ = _scaled(total)
        whole = t.T @ total @ t
        grid = lambda_grid(whole[:-1, -1], total[0, 0])
        if test not in parts:
            return pd.DataFrame([], columns=["model_name", "fold", "idx", "lambda", "mse"])
        train, held = t.T @ (total - parts[test]) @ t, t.T @ parts[test] @ t
        n = total[0, 0] - parts[test][0, 0]
        lip = np.linalg.eigvalsh(train[:-1, :-1]).max() / n
        beta, out = np.zeros(len(block)), []
        for i, lam in enumerate(grid):
            beta = _path_step(train[:-1, :-1], train[:-1, -1], n, block, lam, beta, lip)
            c = np.append(-beta, 1.0)
            out.append((pdf["model_name"].iloc[0], test, i, lam, c @ held @ c / parts[test][0, 0]))
        return pd.DataFrame(out, columns=["model_name", "fold", "idx", "lambda", "mse"])

    return spread.groupBy("model_name", "test").applyInPandas(
        each, "model_name string, fold int, idx int, lambda double, mse double"
    )


def cv_path(errors: DataFrame) -> DataFrame:
    """Mean error and its standard error per penalty; the choice is the smallest penalty within one
    standard error of the best."""
    path = errors.groupBy(F.col("model_name").alias("depvar"), "idx", "lambda").agg(
        F.avg("mse").alias("cv_mse"), (F.stddev_samp("mse") / F.sqrt(F.count("mse"))).alias("cv_se")
    )
    best = path.groupBy("depvar").agg(
        F.min("cv_mse").alias("best_mse"), F.min_by("cv_se", F.struct("cv_mse", "idx")).alias("best_se")
    )
    near = path.join(best, "depvar").where(F.col("cv_mse") <= F.col("best_mse") + F.col("best_se"))
    chosen = near.groupBy("depvar").agg(F.max("idx").alias("idx_chosen"), F.max_by("lambda", "idx").alias("lambda_chosen"))
    return path.join(best.drop("best_se"), "depvar").join(chosen, "depvar")


def selected(products: DataFrame, path: DataFrame, names: tuple[str, ...], groups: list[int], labels: list[str]) -> DataFrame:
    """Coefficients at the chosen penalty on the raw scale, with block and activity."""
    total = products.groupBy("model_name", "i", "j").agg(F.sum("v").alias("v"))
    chosen = path.select(F.col("depvar").alias("model_name"), "lambda_chosen").distinct()

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        g, block = square(pdf["i"], pdf["j"], pdf["v"]), np.asarray(groups)
        t, mean, sd = _scaled(g)
        s, n = t.T @ g @ t, g[0, 0]
        beta = _path_step(s[:-1, :-1], s[:-1, -1], n, block, pdf["lambda_chosen"].iloc[0], np.zeros(len(block)),
                          np.linalg.eigvalsh(s[:-1, :-1]).max() / n)
        raw = beta / sd
        out = [(pdf["model_name"].iloc[0], f, r, bool(abs(b) > 1e-8), labels[k]) for f, r, b, k in zip(names, raw, beta, block)]
        out.append((pdf["model_name"].iloc[0], "Intercept", mean[-1] - mean[:-1] @ raw, True, "intercept"))
        return pd.DataFrame(out, columns=["depvar", "feature", "beta_shrunken_raw", "is_active", "block_name"])

    return no_nan(total.join(chosen, "model_name").groupBy("model_name").applyInPandas(
        each, "depvar string, feature string, beta_shrunken_raw double, is_active boolean, block_name string"
    ))


def shrinkage(panel: DataFrame, outcomes=OUTCOMES, seed: int = 20260711) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, selected features, refit of the active features with cluster-robust errors)."""
    names, groups, labels = features_of(panel)
    products = durable(fold_products(panel, outcomes, seed))
    path = durable(cv_path(cv_errors(products, groups)))
    chosen = durable(selected(products, path, names, groups, labels))
    active: dict[str, list[str]] = {y: [] for y in outcomes}
    for r in chosen.where("is_active and block_name <> 'intercept'").collect():
        active[r["depvar"]].append(r["feature"])
    known = " AND ".join(f"{c} IS NOT NULL" for c in names)
    models = [R.Model(f"SGL_{y}", y, tuple(c for c in names if c in active[y]), known) for y in outcomes]
    return path, chosen, R.coefficients(R.cluster_ols(panel, models))
