"""Weighted draws against refits on the rows with NumPy."""

import hashlib
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import draws, packed
from pulsegrid.operators import resampling, resolution

SPECS = (("POOLED", "log_BV_post", "q_target", "pooled"), ("FX", "jump_share_post", "q_factor", "fx"), ("GG", "log_BV_post", "q_target", "gg"))


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(190):
        day, event = date(2015, 1, 1) + timedelta(days=9 * i), i % 4 == 0
        for root in ("fx", "gg"):
            pre = None if i % 37 == 5 else float(rng.normal())
            for y in ("log_BV_post", "jump_share_post"):
                x = [1.0, float(rng.normal()), float(rng.normal()), float(i % 5 == 0)]
                rows.append((day, root, event, pre, float(rng.normal()) if event else None, float(rng.normal()) if event else None, float(i > 90),
                             float(root == "gg"), y, x, None if i % 23 == 3 else float(x[1] - 0.5 * x[2] + rng.normal())))
    return spark.createDataFrame(rows, "trade_date date, root_code string, is_event boolean, log_BV_pre double, q_target double, q_factor double, "
                                       "regime_hike double, root_gg double, outcome string, x array<double>, y double")


def plain_estimates(rows, weight):
    """{(spec, term): beta} of one draw, both stages by least squares on the rows."""
    rows = rows.assign(w=rows["trade_date"].map(weight).fillna(0.0))
    rows = rows[rows["w"] > 0]
    left, states = [], {}
    for root, g in rows.groupby("root_code"):
        c = g[~g["is_event"] & g["log_BV_pre"].notna()].drop_duplicates("trade_date")
        mean = np.average(c["log_BV_pre"], weights=c["w"])
        states[root] = mean, np.sqrt((c["w"] * (c["log_BV_pre"] - mean) ** 2).sum() / (c["w"].sum() - 1))
    for (y, root), g in rows[rows["y"].notna()].groupby(["outcome", "root_code"]):
        c, e = g[~g["is_event"]], g[g["is_event"]].copy()
        if c["w"].sum() < 100:
            continue
        r = np.sqrt(c["w"].to_numpy())
        beta = np.linalg.lstsq(np.vstack(c["x"]) * r[:, None], c["y"].to_numpy() * r, rcond=None)[0]
        e["value"] = e["y"] - np.vstack(e["x"]) @ beta
        e["state"] = (e["log_BV_pre"] - states[root][0]) / states[root][1]
        left.append(e)
    left, out = pd.concat(left), {}
    for name, y, q, root in SPECS:
        g = left[(left["outcome"] == y) & ((left["root_code"] == root) | (root == "pooled"))].dropna(subset=[q, "state", "value", "regime_hike"])
        cols = [np.ones(len(g)), g[q], g["state"], g[q] * g["state"], g["regime_hike"], *([g["root_gg"]] if root == "pooled" else [])]
        x, r = np.column_stack(cols).astype(float), np.sqrt(g["w"].to_numpy())
        beta = np.linalg.lstsq(x * r[:, None], g["value"].to_numpy() * r, rcond=None)[0]
        out[name, q], out[name, f"{q}_x_pre"] = beta[1], beta[3]
    return out


def test_two_stage_draws_match_refits(study):
    weights = resampling.date_weights(study, 5, 3)
    got = resampling.two_stage_estimates(study, weights, SPECS).toPandas()
    rows, drawn = study.toPandas(), weights.toPandas()
    assert set(got["draw"]) == set(range(6))
    for d, own in got.groupby("draw"):
        w = drawn[drawn["draw"] == d].set_index("trade_date")["w"].astype(float)
        want = plain_estimates(rows, w)
        mine = {(s, t): b for s, t, b in zip(own["spec"], own["term"], own["beta"])}
        assert mine.keys() == want.keys() and all(np.isclose(mine[k], want[k], rtol=1e-6, atol=1e-8) for k in want)


def test_bootstrap_does_not_depend_on_partitions(study):
    a, b = (resampling.two_stage_bootstrap(s, SPECS, 19, 3).orderBy("spec", "term").toPandas() for s in (study, study.repartition(5)))
    assert len(a) == 6 and np.allclose(a["bootstrap_se"], b["bootstrap_se"]) and (a["p_bootstrap_two_sided"] == b["p_bootstrap_two_sided"]).all()


def test_weighted_sums_of_dates(spark):
    rng = np.random.default_rng(2)
    days = [date(2019, 11, 1) + timedelta(days=20 * i) for i in range(12)]
    rows = [(d, k, rng.normal(size=3).tolist()) for d in days for k in ("a", "b") if (d.month, k) != (3, "b")]
    weights = [(b, d, int(w)) for b in range(150) for d, w in zip(days, rng.integers(0, 3, len(days))) if w]
    got = packed.drawn(spark.createDataFrame(weights, "draw int, day date, w long"), spark.createDataFrame(rows, "day date, k string, g array<double>"), "day", ["k"], "g")
    mine = {(r.draw, r.k): (r.g, r.total) for r in got.collect()}
    for b in range(150):
        w = {d: x for c, d, x in weights if c == b}
        for k in ("a", "b"):
            own = [(w.get(d, 0), np.array(g)) for d, kk, g in rows if kk == k]
            assert np.allclose(mine[b, k][0], sum(x * g for x, g in own)) and mine[b, k][1] == sum(x for x, _ in own)


def test_packed_algebra(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(int(i % 2), v.tolist()) for i, v in enumerate(z)], "k int, z array<double>")
    sums = packed.summed(df.select("k", packed.products(F.col("z")).alias("g")), ["k"], "g")
    m = packed.side(F.col("g"))
    for r in sums.select("k", packed.whole(F.col("g"), m).alias("full"), m.alias("m"), "g").collect():
        want = z[r.k::2].T @ z[r.k::2]
        assert r.m == 4 and np.allclose(np.array(r.full).reshape(4, 4), want) and np.allclose(packed.unpacked(np.array(r.g))[0], want)
    (beta, rank), = [(r.beta, r.rank) for r in packed.solved(sums.where("k = 0"), ["k"], "g").collect()]
    assert rank == 3 and np.allclose(beta, np.linalg.lstsq(z[::2, :3], z[::2, 3], rcond=None)[0])


def test_signs_and_picks_are_those_of_md5(spark):
    rows = spark.range(1, 200).select(F.col("id"), draws.rademacher(7, F.col("id"), F.lit("2020-01-02")).alias("s"), draws.pick(7, F.lit(10), F.col("id")).alias("p")).collect()
    for r in rows:
        assert r.s == (1.0 if hashlib.md5(f"7|{r.id}|2020-01-02".encode()).hexdigest() < "8" else -1.0)
        assert r.p == int(hashlib.md5(f"7|{r.id}".encode()).hexdigest()[:12], 16) % 10


def test_leave_year_out_ridge_matches_refits(spark):
    """Predictions of every row from a ridge fit to the controls of other years, one refit per year."""
    rng = np.random.default_rng(8)
    rows = [("full", d, i, i % 5 == 0, 2000 + (i * 7 // 90 if i < 85 else 9), int(rng.integers(0, 3)) if d else 1, [1.0, *rng.normal(size=3).tolist(), 0.0], *rng.normal(size=3).tolist())
            for d in range(3) for i in range(90)]
    names = "scenario string, draw int, source_id int, is_event boolean, year_number int, w long, design array<double>, d_11 double, d_12 double, d_22 double"
    got = resolution.cross_fit(spark.createDataFrame(rows, names)).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("draw"):
        z, y, w = np.vstack(g["design"]), g[list(resolution.OUTCOMES)].to_numpy(), np.where(g["is_event"], 0.0, g["w"])
        for year in g["year_number"].unique():
            train, own = w * (g["year_number"] != year), (g["year_number"] == year).to_numpy()
            train = train if train.sum() >= z.shape[1] + 10 else w
            h = z.T @ (z * np.asarray(train)[:, None])
            penalty = np.eye(5) * resolution.RIDGE_SCALE * max(np.trace(h) / 5, 1.0)
            penalty[0, 0] = 0
            beta = np.linalg.solve(h + penalty, z.T @ (y * np.asarray(train)[:, None]))
            assert np.allclose(g.loc[own, [f"lin_{c}" for c in resolution.OUTCOMES]], z[own] @ beta, atol=1e-8)
            assert np.allclose(g.loc[own, [f"base_{c}" for c in resolution.OUTCOMES]], np.average(y, axis=0, weights=train))


def test_signed_sums_meet_in_blocks(spark, monkeypatch):
    """Sums over blocks of clusters and draws are those of one product; nothing is copied per draw."""
    monkeypatch.setattr(resampling, "_DRAWS_AT_ONCE", 4)
    monkeypatch.setattr(resampling, "_CLUSTERS_AT_ONCE", 5)
    rows = [(m, c, None if i == 0 else f"d{i}", [float(i * c + 1), float(i % 3), 0.5 * i][: 2 + (m == "b")]) for m in "ab" for c in (1, 2) for i in range(17)]
    scores = spark.createDataFrame(rows, "model_name string, column int, cluster string, s array<double>")
    got = {(r.model_name, r.column, r.draw): r.s for r in resampling.signed_sums(scores, 10, 3).collect()}
    sign = {(r.cluster, r.draw): r.w for r in scores.select("cluster").distinct().crossJoin(spark.range(1, 11).select(F.col("id").cast("int").alias("draw"))).select(
        "cluster", "draw", draws.rademacher(3, F.col("draw"), F.col("cluster")).alias("w")).collect()}
    assert set(got) == {(m, c, d) for m in "ab" for c in (1, 2) for d in range(11)}
    for (m, c, d), s in got.items():
        want = sum(np.array(r[3]) * (1.0 if d == 0 else sign[r[2], d]) for r in rows if r[:2] == (m, c))
        assert np.allclose(s, want)
