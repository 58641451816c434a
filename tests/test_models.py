"""Estimators against plain NumPy refits, brute force and identities."""

import hashlib
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import counterfactual as cf
from pulsegrid.operators import fractional, functional, matching, memory, regression as R, resampling, shrinkage, spectrum
from pulsegrid.session import durable

rng = np.random.default_rng(7)


@pytest.fixture(scope="module")
def panel(spark):
    n = 80
    days = [date(2018, 1, 1) + timedelta(days=13 * i) for i in range(n)]
    rows = []
    shock, state, mem = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    for i, d in enumerate(days):
        for root in ("fx", "gg"):
            x, q = float(shock[i]), float(state[i])
            y = 0.3 * x + 0.2 * q + 0.5 * (root == "gg") + float(rng.normal())
            rows.append((d, root, x, q, x * q, float(mem[i]), x * float(mem[i]), float(root == "gg"), float(i >= 40), x * (i >= 40), y,
                         float(1 / (1 + np.exp(-y)))))
    names = ("event_date", "root_code", "shock_target_10bp", "state_pre_rv_z", "target_x_preRV", "ma3_target_10bp_z", "target_x_memory",
             "root_gg", "regime_hike", "target_x_hike", "y", "share")
    return durable(spark.createDataFrame(rows, list(names)))


def numpy_cluster(pdf, y, terms):
    x = np.column_stack([np.ones(len(pdf)), *[pdf[t] for t in terms]])
    yv = pdf[y].to_numpy()
    b = np.linalg.lstsq(x, yv, rcond=None)[0]
    u, inv = yv - x @ b, np.linalg.inv(x.T @ x)
    meat = sum(np.outer(s, s) for s in (x[g].T @ u[g] for g in (np.flatnonzero(pdf["event_date"] == d) for d in pdf["event_date"].unique())))
    g, (n, k) = pdf["event_date"].nunique(), x.shape
    return b, g / (g - 1) * (n - 1) / (n - k) * inv @ meat @ inv, x, u, inv


TERMS = ("shock_target_10bp", "state_pre_rv_z", "target_x_preRV", "root_gg")


def test_cluster_ols(panel):
    fit = R.cluster_ols(panel, [R.Model("m", "y", TERMS), R.Model("fx", "y", TERMS[:1], "root_code = 'fx'")])
    row = {r["model_name"]: r for r in fit.collect()}["m"]
    pdf = panel.toPandas()
    b, v, *_ = numpy_cluster(pdf, "y", TERMS)
    assert np.allclose(row["beta"], b) and np.allclose(np.reshape(row["covariance"], v.shape), v)
    eff = {r["effect_name"]: r for r in R.linear_effects(fit, R.state_effects()).where("model_name = 'm'").collect()}
    load = np.array([0, 1, 0, -1, 0.0])
    assert np.isclose(eff["slope_preRV_z_-1"]["estimate"], load @ b) and np.isclose(eff["slope_preRV_z_-1"]["se"], np.sqrt(load @ v @ load))


def test_hc3(panel):
    m = R.Model("m", "y", TERMS)
    row = R.hc3_ols(R.design(panel, [m]), R.battery(panel, [m])).first()
    _, _, x, u, inv = numpy_cluster(panel.toPandas(), "y", TERMS)
    s = x * (u / (1 - np.einsum("ij,jk,ik->i", x, inv, x)))[:, None]
    assert np.allclose(np.reshape(row["covariance"], inv.shape), inv @ s.T @ s @ inv)


def test_purified_shock_equals_refit(panel):
    events = panel.where("root_code = 'fx'")
    got = functional.purify_shocks(events).toPandas().sort_values("event_date")
    pdf = events.toPandas().sort_values("event_date")
    x = np.column_stack([np.ones(len(pdf)), pdf["regime_hike"], pdf["state_pre_rv_z"]])
    y = pdf["shock_target_10bp"].to_numpy()
    out = [y[i] - x[i] @ np.linalg.lstsq(np.delete(x, i, 0), np.delete(y, i), rcond=None)[0] for i in range(len(y))]
    assert np.allclose(got["shock_resid_loo"], out)


def test_threshold_brute_force(panel):
    row = functional.threshold_search(panel, [("t", "y", "state_pre_rv_z")]).first()
    pdf = panel.toPandas()
    q = np.sort(pdf.groupby("event_date")["state_pre_rv_z"].mean())
    best = None
    for p in np.round(np.arange(0.20, 0.801, 0.05), 2):
        pos = min(max(len(q) * p + 0.5, 1), len(q))
        lo, hi = int(np.floor(pos)) - 1, int(np.ceil(pos)) - 1
        c = q[lo] + (pos - np.floor(pos)) * (q[hi] - q[lo])
        d = (pdf["state_pre_rv_z"] > c).astype(float)
        if min(d.sum(), len(d) - d.sum()) < max(10, np.ceil(0.15 * len(d))):
            continue
        _, _, _, u, _ = numpy_cluster(pdf.assign(d=d, xd=d * pdf["shock_target_10bp"]), "y", ("shock_target_10bp", "state_pre_rv_z", "d", "xd", "root_gg"))
        if best is None or u @ u < best[0] - 1e-12:
            best = (u @ u, c)
    assert np.isclose(row["threshold_c"], best[1]) and np.isclose(row["sse"], best[0])


def test_spline_slopes(panel):
    fit, slopes = functional.spline_fits(panel, [("s", "y", "state_pre_rv_z")])
    pdf = panel.toPandas()
    q = np.sort(np.unique(pdf["state_pre_rv_z"]))
    def at(p):
        pos = len(q) * p + 0.5
        return q[int(np.floor(pos)) - 1] + (pos - np.floor(pos)) * (q[int(np.ceil(pos)) - 1] - q[int(np.floor(pos)) - 1])
    basis = lambda v: [np.maximum(v - at(p), 0) ** 3 for p in (0.25, 0.5, 0.75)]
    z, x = pdf["state_pre_rv_z"].to_numpy(), pdf["shock_target_10bp"].to_numpy()
    design = np.column_stack([np.ones(len(pdf)), z, x, x * z, pdf["root_gg"], *[x * b for b in basis(z)]])
    b = np.linalg.lstsq(design, pdf["y"], rcond=None)[0]
    assert np.allclose(fit.first()["beta"], b, atol=1e-6)
    got = slopes.where("state_value = 1.5").first()
    assert np.isclose(got["estimate"], b[2] + 1.5 * b[3] + sum(w * v for w, v in zip(b[5:], basis(1.5))))


def test_fractional_logit(panel):
    coefs, summary, diag = fractional.fractional_logit(panel, [R.Model("f", "share", TERMS[:2] + ("root_gg",))])
    got = coefs.toPandas().set_index("term")
    pdf = panel.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf["shock_target_10bp"], pdf["state_pre_rv_z"], pdf["root_gg"]])
    y, b = pdf["share"].to_numpy(), np.zeros(4)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]), x.T @ (y - mu))
    mu = 1 / (1 + np.exp(-x @ b))
    assert np.allclose(got.loc[["Intercept", "shock_target_10bp", "state_pre_rv_z", "root_gg"], "beta"], b, atol=1e-8)
    assert np.isclose(got.loc["shock_target_10bp", "ape"], (mu * (1 - mu)).mean() * b[1])
    on, off = (1 / (1 + np.exp(-(x @ b - b[3] * x[:, 3] + b[3] * v))) for v in (1, 0))
    assert np.isclose(got.loc["root_gg", "ape"], (on - off).mean()) and got.loc["root_gg", "ape_type"] == "discrete"
    assert summary.first()["converged"] and 0 <= diag.first()["reset_p"] <= 1


def test_nearest_controls_brute_force(spark):
    r = np.random.default_rng(3)
    def side(n, key):
        return [(i, float(r.integers(0, 2)), int(r.integers(2, 5)), int(r.integers(2000, 2006)), r.normal(size=3).tolist()) for i in range(n)], \
            f"{key} int, clock_late double, weekday_number int, year_number int, coords array<double>"
    ev, co = side(25, "event_key"), side(300, "control_key")
    got = matching.nearest_controls(spark.createDataFrame(*ev), spark.createDataFrame(*co), 10).toPandas()
    for key, clock, day, year, z in ev[0]:
        sets = [[c for c in co[0] if c[1] == clock and (not w or c[2] == day) and (not y or abs(c[3] - year) <= 2)]
                for w, y in ((1, 1), (0, 1), (1, 0), (0, 0))]
        pool = next((s for s in sets if len(s) >= 10), sets[-1])
        want = sorted((float(((np.array(c[4]) - z) ** 2).sum()), c[0]) for c in pool)[:10]
        mine = got[got["event_key"] == key].sort_values("match_rank")
        assert mine["control_key"].tolist() == [c for _, c in want]
        assert np.allclose(mine["distance"], [d for d, _ in want])


def test_wild_p_ignores_partitioning(panel):
    m = R.Model("m", "y", TERMS)
    a = resampling.wild_cluster_p(R.design(panel, [m]), {"m": [1, 3]}, 49, 5).orderBy("column").collect()
    b = resampling.wild_cluster_p(R.design(panel.repartition(7), [m]), {"m": [1, 3]}, 49, 5).orderBy("column").collect()
    assert [r["p_wild_cluster"] for r in a] == [r["p_wild_cluster"] for r in b] and all(0 < r["p_wild_cluster"] <= 1 for r in a)


def test_wild_draws_match_refits_on_rows(panel):
    """Every draw by its definition: signs on the restricted residuals, a refit on the rows, clustered errors."""
    models = [R.Model("m", "y", TERMS), R.Model("short", "y", TERMS[:1])]
    tests, draws, seed = {"m": [1, 3], "short": [1]}, 19, 5
    rows = R.design(panel, models)
    scores = resampling.wild_scores(resampling.cluster_products(rows), tests)
    got = {(r.model_name, r.column, r.draw): r.t for r in resampling.wild_draws(scores, draws, seed).collect()}
    assert len(got) == 3 * (draws + 1)
    plain = rows.toPandas()
    for name, g in plain.groupby("model_name"):
        x, y, cluster = np.vstack(g["x"]), g["y"].to_numpy(), g["cluster"].to_numpy()
        n, k = x.shape
        units = np.unique(cluster)
        for j in tests[name]:
            x0 = np.delete(x, j, axis=1)
            fitted = x0 @ np.linalg.lstsq(x0, y, rcond=None)[0]
            for d in range(draws + 1):
                signs = {c: 1.0 if d == 0 or hashlib.md5(f"{seed}|{d}|{c}".encode()).hexdigest() < "8" else -1.0 for c in units}
                ys = fitted + (y - fitted) * np.array([signs[c] for c in cluster])
                inverse = np.linalg.inv(x.T @ x)
                beta = inverse @ x.T @ ys
                own = [inverse[j] @ x[cluster == c].T @ (ys - x @ beta)[cluster == c] for c in units]
                se = np.sqrt(len(units) / (len(units) - 1) * (n - 1) / (n - k) * np.square(own).sum())
                assert np.isclose(got[name, j, d], beta[j] / se, rtol=1e-7, atol=1e-9)


def test_wild_p_of_a_model_without_rows(panel):
    m = R.Model("m", "y", TERMS)
    assert resampling.wild_cluster_p(R.design(panel.where("1 = 0"), [m]), {"m": [1]}, 9, 5).collect() == []


def test_unit_weights_add_up(panel):
    units = panel.withColumn("all", F.lit(1))
    w = resampling.unit_weights(units, ["all"], "event_date", 20, 1).groupBy("draw").agg(F.sum("w").alias("n")).toPandas()
    assert len(w) == 20 and (w["n"] == 80).all()


def test_spectrum_against_eigh(spark):
    r = np.random.default_rng(1)
    rows = [(i, *map(float, r.normal(size=3))) for i in range(50)]
    out = spectrum.spectrum_of_means(spark.createDataFrame(rows, "k int, abnormal_11 double, abnormal_12 double, abnormal_22 double"), ["k"]).toPandas()
    for _, o in out.iterrows():
        a = np.array([[o["A_fx_fx"], o["A_fx_gg"]], [o["A_fx_gg"], o["A_gg_gg"]]])
        values, vectors = np.linalg.eigh(a)
        assert np.allclose([o["lambda_minus"], o["lambda_plus"]], values)
        assert np.allclose(a @ [o["vplus_fx"], o["vplus_gg"]], o["lambda_plus"] * np.array([o["vplus_fx"], o["vplus_gg"]]))
        assert o["vplus_gg"] >= 0 and o["vminus_fx"] >= 0
        assert np.isclose(o["lambda_plus"] + o["lambda_minus"], np.trace(a))


def test_cross_fit_equals_refit(panel):
    got = memory.cross_fit(panel, [R.Model("y|M", "y", TERMS)]).toPandas().sort_values(["event_date", "root_code"])
    pdf = panel.toPandas().sort_values(["event_date", "root_code"])
    x = np.column_stack([np.ones(len(pdf)), *[pdf[t] for t in TERMS]])
    y, d = pdf["y"].to_numpy(), pdf["event_date"].to_numpy()
    want = np.concatenate([y[d == v] - x[d == v] @ np.linalg.lstsq(x[d != v], y[d != v], rcond=None)[0] for v in pd.unique(d)])
    assert np.allclose(got["residual_cf"], want)


def test_expanding_forecast_equals_refit(panel):
    got = memory.expanding_forecasts(panel, "y", {"M": TERMS}).toPandas().sort_values(["event_date", "root_code"])
    last = got.iloc[-1]
    pdf = panel.toPandas()
    first_two = sorted(pdf["event_date"].unique())[:2]
    train = pdf[(pdf["event_date"] < last["event_date"]) & ~pdf["event_date"].isin(first_two)]
    x = np.column_stack([np.ones(len(train)), *[train[t] for t in TERMS]])
    b = np.linalg.lstsq(x, train["y"], rcond=None)[0]
    row = pdf[(pdf["event_date"] == last["event_date"]) & (pdf["root_code"] == last["root_code"])].iloc[0]
    assert np.isclose(last["pred_state"], b @ [1, *[row[t] for t in TERMS]]) and len(got) == 2 * (78 - 45)


def test_local_whittle_minimum(panel):
    power = durable(memory.periodogram(panel, ["root_code"], "y"))
    got = memory.local_whittle(power, ["root_code"], (0.65,)).where("root_code = 'fx'").first()
    p = power.where("root_code = 'fx'").toPandas().sort_values("j")
    m = got["m_frequencies"]
    lam, pw = p["frequency"].to_numpy()[:m], p["power"].to_numpy()[:m]
    x = panel.where("root_code = 'fx'").toPandas().sort_values("event_date")["y"].to_numpy()
    assert np.allclose(pw, (np.abs(np.fft.fft(x - x.mean())) ** 2 / (2 * np.pi * len(x)))[1:m + 1])
    grid = np.linspace(-0.45, 0.75, 200001)
    obj = np.log(np.exp(2 * np.outer(grid, np.log(lam))) @ pw / m) - 2 * grid * np.log(lam).mean()
    assert abs(grid[obj.argmin()] - got["d_hat"]) < 1e-5


def test_shrinkage_conditions(panel):
    path, chosen, refit = shrinkage.shrinkage(panel.withColumnRenamed("y", "asinh_PR_rv"), ("asinh_PR_rv",))
    first = path.where("idx = 0").first()
    pdf = panel.toPandas()
    names, _, _ = shrinkage.features_of(panel)
    x = np.column_stack([pdf[n] for n in names])
    x, y = (x - x.mean(0)) / x.std(0, ddof=1), (pdf["y"] - pdf["y"].mean()).to_numpy()
    assert np.isclose(first["lambda"], np.abs(x.T @ y / len(y)).max())
    assert path.count() == 40 and chosen.count() == len(names) + 1 and refit.count() >= 1


def test_stacked_and_left_out_years(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(300):
        d = date(2012, 1, 2) + timedelta(days=9 * i)
        rows.append((d, "fx", i % 9 == 4, True, *map(float, r.normal(size=8)), float(i > 150), d.isoweekday() % 5 + 2, d.month, d.year, 0.0, float(i > 200)))
    names = ("trade_date", "root_code", "is_event", "window_eligible", "log_BV_pre", "log_RV_pre", "jump_share_pre", "log_BV_post", "log_RV_post",
             "jump_share_post", "slow5_log_rv", "shock_target_10bp", "clock_late", "weekday_number", "month_number", "year_number", "root_gg", "regime_hike")
    w = durable(spark.createDataFrame(rows, list(names)))
    normal = durable(cf.normal_rows(w))
    got = {x["model_name"]: x for x in cf.leave_year_out(normal).collect()}["NORMAL_log_BV_post_fx"]
    pdf = normal.where("train and outcome = 'log_BV_post'").toPandas()
    x, y, yr = np.vstack(pdf["x"]), pdf["y"].to_numpy(), pdf["year_number"].to_numpy()
    err = np.concatenate([y[yr == v] - x[yr == v] @ np.linalg.lstsq(x[yr != v], y[yr != v], rcond=None)[0] for v in np.unique(yr)])
    assert np.isclose(got["rmse_leave_year_out"], np.sqrt((err ** 2).mean()), rtol=1e-6)


def test_registered_decision_is_made(spark):
    from pulsegrid.plans import catalog, catalog_memory, catalog_sessions

    assert {catalog_sessions.DRAWS, catalog_sessions.RESOLUTION_DRAWS, catalog_memory.DRAWS} == {999}
    rows = catalog.QUERIES["decision_table"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 7 and all(r.evaluated for r in rows) and not any(r.status == "SMOKE_ONLY" for r in rows)
