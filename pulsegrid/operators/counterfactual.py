"""Normal continuation on control days, abnormal outcomes, event models and their checks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions import tails
from pulsegrid.functions.frames import dot
from pulsegrid.functions.quantiles import grouped_quantiles
from pulsegrid.operators import regression as R
from pulsegrid.operators.functional import fit_and_leverage
from pulsegrid.operators.regression import no_nan, solve, square

# Outcomes with their pre-release counterpart and the abnormal column.
NORMAL = {
    "log_BV_post": ("log_BV_pre", "abnormal_log_BV"),
    "log_RV_post": ("log_RV_pre", "abnormal_log_RV"),
    "jump_share_post": ("jump_share_pre", "abnormal_jump_share"),
}
WEEKDAYS = (2, 3, 4, 6)
MONTHS = tuple(range(2, 13))
EQUIVALENCE_MARGIN = math.log(1.25)
MIN_CONTROLS = 100
MIN_TRAIN = 50


def normal_terms(pre: str) -> list[str]:
    return [
        "Intercept", f"{pre}_centered", f"{pre}_centered_sq", "slow5_log_rv_centered", "clock_late",
        "time_trend_years", *[f"weekday_{d}" for d in WEEKDAYS], *[f"month_{m}" for m in MONTHS],
    ]


def normal_vector(pre: Column, slow: Column, trend: Column) -> Column:
    """The 21 design columns from centred inputs."""
    return F.array(
        F.lit(1.0), pre, pre * pre, slow, F.col("clock_late"), trend,
        *[(F.col("weekday_number") == d).cast("double") for d in WEEKDAYS],
        *[(F.col("month_number") == m).cast("double") for m in MONTHS],
    )


def normal_rows(windows: DataFrame) -> DataFrame:
    """(model_name, outcome, x, y, train, ...) per eligible root-day and outcome.

    Centres come from the control rows of the same root and outcome.
    """
    each = F.explode(
        F.array(*[F.struct(F.lit(y).alias("outcome"), F.col(y).alias("y"), F.col(p).alias("pre"))
                  for y, (p, _) in NORMAL.items()])
    )
    days = F.datediff("trade_date", F.lit("1970-01-01")).cast("double")
    rows = (
        windows.where("window_eligible").select("*", each.alias("o")).select("*", "o.*").drop("o")
        .where(F.col("pre").isNotNull() & F.col("slow5_log_rv").isNotNull())
        .withColumns({"train": ~F.col("is_event") & F.col("y").isNotNull(), "_day": days,
                      "model_name": F.concat_ws("_", F.lit("NORMAL"), "outcome", "root_code")})
    )
    t = F.col("train")
    centre = rows.groupBy("model_name").agg(
        *[F.avg(F.when(t, F.col(c))).alias(f"_c_{c}") for c in ("pre", "slow5_log_rv", "_day")],
        F.count_if(t).alias("n_train"),
    )
    c = lambda name: F.col(name) - F.col(f"_c_{name}")
    return rows.join(centre, "model_name").where(F.col("n_train") >= MIN_CONTROLS).withColumn(
        "x", normal_vector(c("pre"), c("slow5_log_rv"), c("_day") / 365.25)
    ).select("model_name", "outcome", "root_code", "trade_date", "year_number", "is_event", "train", "x", "y")


def normal_spec(windows: DataFrame, roots: tuple[str, ...] = ("fx", "gg")) -> DataFrame:
    return windows.sparkSession.createDataFrame(
        [(f"NORMAL_{y}_{r}", y, normal_terms(p)) for y, (p, _) in NORMAL.items() for r in roots],
        "model_name string, outcome string, terms array<string>",
    )


def normal_fits(rows: DataFrame, spec: DataFrame) -> DataFrame:
    return R.hc3_ols(rows.where("train").select("model_name", "x", "y"), spec)


def abnormal_outcomes(windows: DataFrame, rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Predictions for every eligible root-day and observed minus predicted."""
    expected = rows.join(fitted.select("model_name", "beta"), "model_name").withColumn(
        "cf", dot(F.col("x"), F.col("beta"))
    )
    at = lambda y, c: F.max(F.when(F.col("outcome") == y, c))
    wide = expected.groupBy("trade_date", "root_code").agg(
        *[at(y, F.col("cf")).alias(f"cf_{y}") for y in NORMAL],
        *[at(y, F.col("y") - F.col("cf")).alias(a) for y, (_, a) in NORMAL.items()],
    )
    return windows.join(wide, ["trade_date", "root_code"], "left")


def leave_year_out(rows: DataFrame) -> DataFrame:
    """Out-of-year fit per model: each year's cross products are taken from the total before solving."""
    train = rows.where("train")
    per_year = R.gram(train.select("model_name", "year_number", "x", "y"), ["model_name", "year_number"])

    def solve_years(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {y: square(g["i"], g["j"], g["v"]) for y, g in pdf.groupby("year_number")}
        total = sum(parts.values())
        out = [
            (pdf["model_name"].iloc[0], int(y), solve(total - g)[0].tolist())
            for y, g in parts.items()
            if (total - g)[0, 0] >= MIN_TRAIN
        ]
        return pd.DataFrame(out, columns=["model_name", "year_number", "b"])

    betas = per_year.groupBy("model_name").applyInPandas(
        solve_years, "model_name string, year_number int, b array<double>"
    )
    err = F.col("y") - dot(F.col("x"), F.col("b"))
    y = F.col("y")
    return train.join(betas, ["model_name", "year_number"]).groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n_leave_year_out"),
        F.sqrt(F.avg(err * err)).alias("rmse_leave_year_out"),
        (1 - F.sum(err * err) / (F.var_samp(y) * (F.count(y) - 1))).alias("r2_leave_year_out"),
    )


def leave_year_out_mean(windows: DataFrame, value: str) -> DataFrame:
    """Mean of the controls of all other years, per root and year."""
    control = windows.where(~F.col("is_event") & F.col("window_eligible") & F.col(value).isNotNull())
    per = control.groupBy("root_code", "year_number").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    all_years = Window.partitionBy("root_code")
    s, n = F.sum("s").over(all_years) - F.col("s"), F.sum("n").over(all_years) - F.col("n")
    return per.select("root_code", "year_number", F.col("n").alias("n_year"), (s / n).alias("mean_other_years"))


def normal_summary(fitted: DataFrame, left_out: DataFrame) -> DataFrame:
    return fitted.select(
        "model_name", "outcome", F.col("n_obs").alias("n_controls"), F.col("n_params").alias("n_parameters"), "rank_design",
        F.col("r2").alias("r2_in_sample"), F.col("adj_r2").alias("adj_r2_in_sample"),
        F.sqrt(F.col("sse") / F.col("n_obs")).alias("rmse_in_sample"),
    ).join(left_out, "model_name", "left")


def conditional_effects(models: list[R.Model]) -> list[R.Effect]:
    """Effect of one unit of shock energy at low, middle and high pre-release state."""
    out = []
    for m in models:
        q = m.terms[0]
        out += [
            R.Effect(f"state_{z:+d}", ((q, 1.0), (f"{q}_x_pre", float(z))), float(z), "per_unit_shock_energy", (m.name,))
            for z in (-1, 0, 1)
        ]
    return out


def with_relative_change(effects: DataFrame) -> DataFrame:
    return effects.withColumn(
        "implied_relative_change", F.when(F.col("outcome").contains("log"), F.exp("estimate") - 1)
    )


def equivalence(coefs: DataFrame, term_suffix: str = "_x_pre", margin: float = EQUIVALENCE_MARGIN) -> DataFrame:
    """Two one-sided tests that the interaction lies inside the margin, for log outcomes."""

    def each(parts):
        for p in parts:
            b, se, df = (p[c].to_numpy(float) for c in ("beta", "se", "df"))
            crit = tails.t_critical(df, 0.90)
            p_tost = np.maximum(1 - tails.t_cdf((b + margin) / se, df), tails.t_cdf((b - margin) / se, df))
            yield pd.DataFrame({
                "model_name": p["model_name"], "term": p["term"], "estimate": b, "se_cluster": se, "margin_log_points": margin,
                "margin_multiplier_ratio": math.exp(margin), "ci90_lo": b - crit * se, "ci90_hi": b + crit * se,
                "p_tost": p_tost, "equivalent_at_5pct": p_tost < 0.05})

    rows = coefs.where(F.col("term").endswith(term_suffix) & F.col("outcome").contains("log")).select(
        "model_name", "term", "beta", "se", F.greatest(F.col("n_clusters") - 1, F.lit(1)).cast("double").alias("df")
    )
    return no_nan(rows.mapInPandas(
        each,
        "model_name string, term string, estimate double, se_cluster double, margin_log_points double, "
        "margin_multiplier_ratio double, ci90_lo double, ci90_hi double, p_tost double, equivalent_at_5pct boolean",
    ))


# Validation specifications (id, outcome, energy, roots).
VALIDATION = (
    ("TARGET_BV_pooled", "log_BV_post", "q_target", "pooled"),
    ("TARGET_RV_pooled", "log_RV_post", "q_target", "pooled"),
    ("TARGET_JUMP_pooled", "jump_share_post", "q_target", "pooled"),
    ("FACTOR_BV_pooled", "log_BV_post", "q_factor", "pooled"),
    ("TARGET_BV_fx", "log_BV_post", "q_target", "fx"),
    ("TARGET_BV_gg", "log_BV_post", "q_target", "gg"),
)


def stacked_rows(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spec) of the one-stage models: a normal block per root next to the event terms."""
    normal = normal_rows(windows).where("y is not null").select(
        "trade_date", "root_code", "outcome", F.col("x").alias("base"), "y"
    )
    keep = ("trade_date", "root_code", "is_event", "root_gg", "pre_state_z", "regime_hike", "q_target", "q_factor")
    joined = normal.join(windows.select(*keep), ["trade_date", "root_code"]).where("pre_state_z is not null")
    zero, event = F.array_repeat(F.lit(0.0), 21), F.col("is_event").cast("double")
    parts, spec = [], []
    for name, y, q, root in VALIDATION:
        rows = joined.where(F.col("outcome") == y).where(~F.col("is_event") | F.col(q).isNotNull())
        energy = F.when(F.col("is_event"), F.col(q)).otherwise(0.0)
        state = F.col("pre_state_z")
        tail = [energy, event * state, energy * state, F.when(F.col("is_event"), F.col("regime_hike")).otherwise(0.0)]
        labels = [f"event_{q}", "event_state", f"event_{q}_x_pre", "event_regime_hike"]
        pre = NORMAL[y][0]
        if root == "pooled":
            own = lambda r: F.when(F.col("root_code") == r, F.col("base")).otherwise(zero)
            x = F.concat(own("fx"), own("gg"), F.array(event, event * F.col("root_gg"), *tail))
            terms = [f"{r}_normal_{t}" for r in ("fx", "gg") for t in normal_terms(pre)]
            terms += ["event_intercept", "event_root_gg", *labels]
        else:
            rows = rows.where(F.col("root_code") == root)
            x = F.concat("base", F.array(event, *tail))
            terms = [f"{root}_normal_{t}" for t in normal_terms(pre)] + ["event_intercept", *labels]
        parts.append(rows.select(F.lit(f"STACKED_{name}").alias("model_name"), F.col("trade_date").cast("string").alias("cluster"),
                                 x.alias("x"), "y", "is_event"))
        spec.append((f"STACKED_{name}", y, terms))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, windows.sparkSession.createDataFrame(spec, "model_name string, outcome string, terms array<string>")


def stacked_models(rows: DataFrame, spec: DataFrame, min_events: int = 30) -> tuple[DataFrame, DataFrame]:
    """(coefficients, sample counts); event terms are tested with event clusters - 1 degrees of freedom."""
    counts = rows.groupBy("model_name").agg(
        F.count_if(~F.col("is_event")).alias("n_control_obs"),
        F.count_if("is_event").alias("n_event_obs"),
        F.count_distinct(F.when(F.col("is_event"), F.col("cluster"))).alias("n_event_clusters"),
    )
    counts = counts.where(F.col("n_event_clusters") >= min_events)
    # A rank-deficient design has no coefficients of its own to report.
    fitted = R.cluster_fit(rows, spec).where(F.col("rank_design") == F.col("n_params")).join(counts, "model_name")
    coefs = R.coefficients(fitted)
    events = R.coefficients(fitted.withColumn("df", F.greatest(F.col("n_event_clusters") - 1, F.lit(1)).cast("double")))
    is_event_term = F.col("term").startswith("event_")
    return coefs.where(~is_event_term).unionByName(events.where(is_event_term)), R.model_summary(fitted).join(counts, "model_name")


def enough_clusters(fitted: DataFrame, least: int = 30) -> DataFrame:
    """Fits of event models with at least so many event dates and a design of full rank."""
    return fitted.where((F.col("n_clusters") >= least) & (F.col("rank_design") == F.col("n_params")))


def energy_ranks(windows: DataFrame, q: str = "q_target") -> DataFrame:
    """Event dates by falling shock energy; equal energies keep date order.

    The ranking sees one row per event date, so the calendar bounds it.
    """
    per = windows.where(F.col("is_event") & F.col(q).isNotNull()).groupBy("trade_date").agg(
        F.min_by(q, "root_code").alias("energy")
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("energy"), F.asc("trade_date"))
    return per.withColumn("energy_rank", F.row_number().over(order))


def support_by_event(windows: DataFrame) -> DataFrame:
    """Energy ranks, shares and running shares of every event date."""
    e = windows.where(F.col("is_event") & F.col("q_target").isNotNull())
    first = lambda c, cond=F.lit(True): F.min_by(
        F.when(cond & F.col(c).isNotNull(), F.col(c)), F.when(cond & F.col(c).isNotNull(), F.col("root_code"))
    )
    per = e.groupBy("trade_date").agg(
        first("shock_target_10bp").alias("shock_target_10bp"),
        first("q_target").alias("q_target"),
        first("q_factor").alias("q_factor"),
        first("regime_hike").alias("regime_hike"),
        F.avg("pre_state_z").alias("mean_pre_state_z"),
        *[first("pre_state_z", F.col("root_code") == r).alias(f"{r}_pre_state_z") for r in ("fx", "gg")],
        F.count(F.lit(1)).alias("n_roots"),
    )
    # One row per event date: the calendar bounds this window.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("q_target"), F.asc("trade_date"))
    whole, upto = Window.partitionBy(F.lit(0)), order.rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("q_target")
    return per.withColumns(
        {
            "energy_rank": F.row_number().over(order),
            "q_share": q / F.sum(q).over(whole),
            "q_cumulative_share": F.sum(q).over(upto) / F.sum(q).over(whole),
            "q_squared_share": q * q / F.sum(q * q).over(whole),
            "q_squared_cumulative_share": F.sum(q * q).over(upto) / F.sum(q * q).over(whole),
        }
    )


def support_summary(by_event: DataFrame) -> DataFrame:
    q, rank = F.col("q_target"), F.col("energy_rank")
    top = lambda c, k: F.sum(F.when(rank <= k, F.col(c)))
    one = by_event.agg(
        F.count(F.lit(1)).alias("n_event_dates"),
        F.avg((q == 0).cast("double")).alias("share_zero_q"),
        F.median(q).alias("q_median"),
        F.max(q).alias("q_max"),
        (F.max(q) / F.median(F.when(q > 0, q))).alias("q_max_to_positive_median"),
        *[top("q_share", k).alias(f"top{k}_share_q") for k in (1, 2, 3)],
        *[top("q_squared_share", k).alias(f"top{k}_share_q_squared") for k in (1, 2, 3)],
    )
    p95 = grouped_quantiles(by_event.withColumn("_all", F.lit(1)), ["_all"], "q_target", {"q_p95": 0.95}).select("q_p95")
    return one.withColumn("q_p95", p95.scalar())


def collinearity(windows: DataFrame) -> DataFrame:
    """Correlation and variance inflation of the energy and its interaction among event rows.

    Inflation factors are the diagonal of the inverse correlation matrix.
    """
    names = ("q_target", "pre_state_z", "q_target_x_pre", "regime_hike", "root_gg")
    rows = windows.where("is_event and window_eligible").dropna(subset=list(names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    moments = rows.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    columns = moments.columns

    def each(parts):
        for p in parts:
            m = np.eye(len(names))
            for (a, b), v in zip(pairs, p[columns].iloc[0]):
                i, j = names.index(a), names.index(b)
                m[i, j] = m[j, i] = v
            vary = ~np.isnan(np.where(np.eye(len(names)) == 1, np.nan, m)).all(axis=1)
            vif = np.full(len(names), np.nan)
            if vary.any():
                vif[vary] = np.diag(np.linalg.pinv(m[np.ix_(vary, vary)]))
            yield pd.DataFrame([(m[0, 2], vif[0], vif[2])], columns=["corr_q_q_x_state", "vif_q", "vif_q_x_state"])

    return no_nan(moments.mapInPandas(each, "corr_q_q_x_state double, vif_q double, vif_q_x_state double"))


def leverage_by_date(windows: DataFrame, model: R.Model) -> DataFrame:
    """Summed leverage of an event model's rows per date."""
    rows = R.design(windows, [model], ["trade_date"])
    fit = R.fits(R.gram(rows, ["model_name"]), R.battery(windows, [model])).select("model_name", "beta", "inverse")
    return rows.join(fit, "model_name").withColumn("f", fit_and_leverage()).groupBy(
        "trade_date"
    ).agg(F.sum("f.leverage").alias("leverage"))


def left_out_energies(windows: DataFrame, models: list[R.Model], top: int = 10) -> DataFrame:
    """Per model and k: the dates left out, the largest energy among them and the largest that stays."""
    parts = []
    for q in sorted({m.terms[0] for m in models}):
        first = energy_ranks(windows, q).where(F.col("energy_rank") <= top + 1)
        ranked = first.agg(F.sort_array(F.collect_list(F.struct("energy_rank", "trade_date", "energy"))).alias("ranked"))
        k = F.col("k_removed")
        dates = F.transform(F.slice("ranked", 1, k), lambda r: r["trade_date"].cast("string"))
        names = F.explode(F.array(*[F.lit(m.name) for m in models if m.terms[0] == q]))
        parts.append(ranked.withColumn("k_removed", F.explode(F.sequence(F.lit(0), F.lit(top)))).select(
            names.alias("base_name"), "k_removed", F.array_join(dates, ";").alias("removed_dates"),
            F.when(k > 0, F.get("ranked", F.lit(0))["energy"]).alias("largest_removed_energy"),
            F.get("ranked", k)["energy"].alias("largest_retained_energy")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leave_top_k(windows: DataFrame, models: list[R.Model], top: int = 10, min_events: int = 30) -> tuple[DataFrame, DataFrame]:
    """(rows, spec) of every event model without its k largest energies, k = 0 .. top.

    One copy of a row per k it stays in; the number of copies does not depend on the data.
    """
    parts = []
    for q in sorted({m.terms[0] for m in models}):
        mine = [m for m in models if m.terms[0] == q]
        ranks = energy_ranks(windows, q)
        most = ranks.agg(F.least(F.lit(top), F.greatest(F.count(F.lit(1)) - min_events, F.lit(0))).cast("int").alias("k"))
        rows = R.design(windows.join(ranks.select("trade_date", "energy_rank"), "trade_date"), mine, ["energy_rank"])
        parts.append(rows.withColumn("most", most.scalar()).withColumn(
            "k_removed", F.explode(F.sequence(F.lit(0), F.least(F.col("energy_rank") - 1, F.col("most"))))
        ).drop("most"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("model_name", F.concat_ws("#", "model_name", F.lpad(F.col("k_removed").cast("string"), 2, "0")))
    spec = windows.sparkSession.createDataFrame(
        [(f"{m.name}#{k:02d}", m.outcome, ["Intercept", *m.terms]) for m in models for k in range(top + 1)],
        "model_name string, outcome string, terms array<string>",
    )
    return out.select("model_name", "cluster", "x", "y"), spec
