"""Bias-adjusted resolution test: cross-fitted continuation, common support, matching, spectrum.

Every step carries the keys (scenario, draw) and a weight ``w``, the number of times a date occurs in the
draw. Draw 0 is the sample itself with unit weights, so estimate and bootstrap are one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.functions import packed, scalars as S
from pulsegrid.functions.frames import dot
from pulsegrid.functions.quantiles import grouped_quantiles
from pulsegrid.operators import matching
from pulsegrid.operators.resampling import unit_weights
from pulsegrid.operators.spectrum import (
    INTERVALS,
    interval_rows,
    long_metrics,
    placebo_spectrum,
    placebo_values,
    spectrum_of_means,
    with_coords,
)
from pulsegrid.session import durable

KEYS = ["scenario", "draw"]
FEATURES = ("feature_log_fx_pre", "feature_log_gg_pre", "feature_pre_corr", "slow_fx", "slow_gg")
FEATURE_NAMES = ("log_fx_pre", "log_gg_pre", "fisher_pre_corr", "slow_fx", "slow_gg")
OUTCOMES = ("d_11", "d_12", "d_22")
# Scenarios and the years they leave out.
SCENARIOS = {"full": (), "exclude_2020": (2020,), "exclude_2020_2021": (2020, 2021)}
RIDGE_SCALE = 1e-6
CALIPER_QUANTILE = 0.95
FINAL_DRAWS = 999
SUPPORT = (0.01, 0.99)
YEAR_REACH = 2
NEIGHBOURS = 10
MIN_EVENTS = 30


def scenario_samples(matrices: DataFrame, scenarios: dict[str, tuple[int, ...]] = SCENARIOS) -> DataFrame:
    """The date panel once per scenario, with a numbered source and unit weight (draw 0)."""
    needed = [*OUTCOMES, *FEATURES[:3], "year_number", "clock_late", "weekday_number"]
    rows = matrices.dropna(subset=needed).withColumn("source_id", F.datediff("trade_date", F.lit("1900-01-01")))
    table = F.array(*[F.struct(F.lit(n).alias("scenario"), F.array(*[F.lit(y) for y in ys]).cast("array<int>").alias("out"))
                      for n, ys in scenarios.items()])
    return (
        rows.withColumn("s", F.explode(table)).where(~F.array_contains("s.out", F.col("year_number").cast("int")))
        .select(F.col("s.scenario").alias("scenario"), F.lit(0).alias("draw"), "source_id", "trade_date", "is_event", "clock_late",
                "weekday_number", "year_number", *FEATURES, *OUTCOMES, F.lit(1).cast("long").alias("w"))
    )


def resampled(samples: DataFrame, draws: int, seed: int) -> DataFrame:
    """Events and controls of each scenario redrawn by date."""
    weights = unit_weights(samples, ["scenario", "is_event"], "trade_date", draws, seed).withColumnRenamed("w", "nw")
    return samples.drop("draw", "w").join(weights.withColumnRenamed("nw", "w"), ["scenario", "is_event", "trade_date"]).select(
        *samples.columns
    )


def _control_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Weighted mean and sd over controls, with unit scale when there is no spread."""
    w = F.when(~F.col("is_event"), F.col("w"))
    n = F.sum(w)
    aggs = []
    for c in columns:
        x = F.col(c)
        var = (F.sum(w * x * x) - F.pow(F.sum(w * x), 2) / n) / (n - 1)
        sd = F.sqrt(F.greatest(var, F.lit(0.0)))
        aggs += [(F.sum(w * x) / n).alias(f"m_{c}"), F.when(sd > 1e-12, sd).otherwise(F.lit(1.0)).alias(f"s_{c}")]
    return rows.groupBy(*KEYS).agg(*aggs)


def standardised(rows: DataFrame) -> DataFrame:
    """Feature vector z: missing features at the control median, scored by control mean and sd."""
    gaps = ["slow_fx", "slow_gg"]
    med = None
    for c in gaps:
        one = grouped_quantiles(rows.where("not is_event"), KEYS, c, {f"med_{c}": 0.5}, "w")
        med = one if med is None else med.join(one, KEYS, "full")
    filled = rows.join(med, KEYS, "left").withColumns(
        {c: F.coalesce(F.col(c), F.col(f"med_{c}"), F.lit(0.0)) for c in gaps}
    ).drop(*[f"med_{c}" for c in gaps])
    stats = _control_stats(filled, [*FEATURES, "year_number"])
    score = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")
    return filled.join(stats, KEYS).withColumns(
        {"z": F.array(*[score(c) for c in FEATURES]), "year_z": score("year_number")}
    ).select(*rows.columns, "z", "year_z")


_RIDGE = "lin array<double>, base array<double>"


def _ridge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ridge coefficients of the three outcomes, one after the other, and their means, of packed cross products."""
    q = len(OUTCOMES)
    for pdf in parts:
        if len(pdf):
            g = packed.unpacked(np.vstack(pdf["g"]))
            p = g.shape[1] - q
            size = np.maximum(np.einsum("nii->n", g[:, :p, :p]) / p, 1.0)
            penalty = np.eye(p)
            penalty[0, 0] = 0.0  # the intercept is free
            h, xy = g[:, :p, :p] + RIDGE_SCALE * size[:, None, None] * penalty, g[:, :p, p:]
            ok = np.linalg.cond(h, 1) < 1e12
            beta = np.empty(xy.shape)
            beta[ok] = np.linalg.solve(h[ok], xy[ok])
            for i in np.flatnonzero(~ok):
                beta[i] = np.linalg.pinv(h[i]) @ xy[i]
            with np.errstate(invalid="ignore"):
                base = xy[:, 0, :] / g[:, :1, 0]
            yield pdf.drop(columns="g").assign(lin=list(beta.transpose(0, 2, 1).reshape(len(pdf), -1)), base=list(base))


def cross_fit(rows: DataFrame) -> DataFrame:
    """Rows with ridge predictions lin_* and plain means base_* of the outcomes, from the controls of all other years.

    A control's cross products are added up per (scenario, draw, year), and a year's own are taken from the total before its
    solve, so rows are never gathered. A year whose rest is too small is fitted on all controls.
    """
    size = F.size("design")
    vector = F.concat("design", F.array(*OUTCOMES))
    control = rows.where("NOT is_event").select(*KEYS, "year_number", packed.products(vector, F.col("w").cast("double")).alias("g"))
    per_year = durable(packed.summed(control, [*KEYS, "year_number"], "g"))
    total = packed.summed(per_year, KEYS, "g").withColumnRenamed("g", "total")
    years = rows.groupBy(*KEYS, "year_number").agg(F.first(size).alias("p"))
    rest = F.zip_with("total", "g", lambda x, y: x - F.coalesce(y, F.lit(0.0)))
    others = years.join(per_year, [*KEYS, "year_number"], "left").join(total, KEYS)
    taken = F.when(F.col("g").isNull(), F.col("total")).when(F.get(rest, F.lit(0)) >= F.col("p") + 10, rest).otherwise(F.col("total"))
    names = [*KEYS, "year_number"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in years.select(*names).schema) + ", " + _RIDGE
    fitted = others.select(*names, taken.alias("g")).mapInPandas(_ridge, schema)
    both = rows.join(fitted, names, "left")
    found = {}
    for i, c in enumerate(OUTCOMES):
        found[f"lin_{c}"] = S.known(dot(F.col("design"), F.slice("lin", i * size + 1, size)))
        found[f"base_{c}"] = S.known(F.get("base", F.lit(i)))
    return both.withColumns(found).drop("lin", "base")


def continuation(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with predictions mu_* and residuals e_*, diagnostics per outcome).

    The linear part is shrunk to the plain mean by the weight that predicts controls best, kept inside [0, 1].
    """
    weekday = [(F.col("weekday_number") == d).cast("double") for d in (3, 4, 5, 6)]
    design = F.concat(F.array(F.lit(1.0)), "z", F.array(F.col("clock_late"), *weekday, F.col("year_z"), F.col("year_z") * F.col("year_z")))
    both = cross_fit(rows.withColumn("design", design)).drop("design")
    w = F.when(~F.col("is_event"), F.col("w"))
    delta = lambda c: F.col(f"lin_{c}") - F.col(f"base_{c}")
    aggs = []
    for c in OUTCOMES:
        ratio = F.sum(w * (F.col(c) - F.col(f"base_{c}")) * delta(c)) / F.sum(w * delta(c) * delta(c))
        aggs.append(F.when(F.sum(w * delta(c) * delta(c)) > 0, F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias(f"a_{c}"))
    both = both.join(both.groupBy(*KEYS).agg(*aggs), KEYS)
    both = both.withColumns({f"mu_{c}": F.col(f"base_{c}") + F.col(f"a_{c}") * delta(c) for c in OUTCOMES})
    both = both.withColumns({f"e_{c}": F.col(c) - F.col(f"mu_{c}") for c in OUTCOMES})

    def fit(c: str, err) -> F.Column:
        y = F.col(c)
        tss = F.sum(w * y * y) - F.pow(F.sum(w * y), 2) / F.sum(w)
        return F.when(tss > 0, 1 - F.sum(w * err * err) / tss)

    wide = both.groupBy(*KEYS).agg(
        F.sum(w).alias("n_control"),
        *[F.max(f"a_{c}").alias(f"a_{c}") for c in OUTCOMES],
        *[fit(c, F.col(f"e_{c}")).alias(f"r_{c}") for c in OUTCOMES],
        *[fit(c, F.col(c) - F.col(f"lin_{c}")).alias(f"l_{c}") for c in OUTCOMES],
    )
    diag = F.explode(F.array(*[
        F.struct(F.lit(c).alias("outcome"), F.col(f"l_{c}").alias("linear_leave_year_out_r2"), F.col(f"a_{c}").alias("shrinkage_weight"),
                 F.col(f"r_{c}").alias("leave_year_out_r2")) for c in OUTCOMES]))
    return both, wide.select(*KEYS, "n_control", diag.alias("d")).select(*KEYS, "d.*", "n_control")


def _candidate_pairs(left: DataFrame, controls: DataFrame) -> DataFrame:
    """Controls of the same clock and weekday within two years, with distances.

    Both sides are dates of one draw; a block of equal weekday and nearby years holds a bounded number
    of calendar days.
    """
    block = [*KEYS, "clock_late", "weekday_number", "year_number"]
    near = left.withColumn(
        "year_number", F.explode(F.sequence(F.col("year_number") - YEAR_REACH, F.col("year_number") + YEAR_REACH))
    )
    c = controls.select(*block, F.col("source_id").alias("control_id"), F.col("coords").alias("c"), F.col("w").alias("cw"))
    return near.join(c, block).withColumn("distance", matching.squared_distance(F.col("coords"), F.col("c")))


def _reached(pairs: DataFrame, unit: str) -> DataFrame:
    order = Window.partitionBy(*KEYS, unit).orderBy("distance", "control_id")
    return pairs.withColumn("upto", F.sum("cw").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def distance_caliper(rows: DataFrame) -> DataFrame:
    """95 % quantile of the tenth-neighbour distance among the controls, every one of them."""
    controls = rows.where("not is_event")
    refs = controls.select(*KEYS, "source_id", "clock_late", "weekday_number", "year_number", "coords")
    pairs = _candidate_pairs(refs, controls).where(F.col("control_id") != F.col("source_id"))
    tenth = _reached(pairs, "source_id").where(F.col("upto") >= NEIGHBOURS).groupBy(*KEYS, "source_id").agg(F.min("distance").alias("kth"))
    return grouped_quantiles(tenth, KEYS, "kth", {"caliper": CALIPER_QUANTILE})


def common_support(rows: DataFrame) -> DataFrame:
    """Per event: inside the 1-99 % box of its clock regime in every feature."""
    f = rows.select(*KEYS, "source_id", "is_event", "clock_late", "w", F.posexplode("z").alias("pos", "v"))
    box = grouped_quantiles(f.where("not is_event"), [*KEYS, "clock_late", "pos"], "v", {"lo": SUPPORT[0], "hi": SUPPORT[1]}, "w")
    return f.where("is_event").join(box, [*KEYS, "clock_late", "pos"], "left").groupBy(*KEYS, "source_id").agg(
        F.bool_and(F.coalesce((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")), F.lit(False))).alias("inside_quantile_box")
    )


def supported_matches(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(support rows per event with reason codes, matches of retained events with places taken)."""
    rows = durable(with_coords(rows).select(*KEYS, "source_id", "trade_date", "is_event", "clock_late", "weekday_number",
                                            "year_number", "w", "z", "coords"))
    caliper = durable(distance_caliper(rows))
    events = rows.where("is_event").select(*KEYS, "source_id", "trade_date", "clock_late", "weekday_number", "year_number", "coords", F.col("w").alias("ew"))
    in_box = durable(events.join(common_support(rows), [*KEYS, "source_id"]))
    pairs = _reached(
        _candidate_pairs(in_box.where("inside_quantile_box"), rows.where("not is_event")), "source_id"
    ).join(caliper, KEYS)
    pairs = durable(pairs.drop("coords", "c", "trade_date"))
    within = F.col("distance") <= F.col("caliper")
    counts = pairs.groupBy(*KEYS, "source_id").agg(
        F.sum("cw").alias("n_exact_candidates"),
        F.coalesce(F.sum(F.when(within, F.col("cw"))), F.lit(0)).alias("n_within"),
        F.min("distance").alias("d1"),
        F.min(F.when(F.col("upto") >= NEIGHBOURS, F.col("distance"))).alias("d10"),
    )
    n = F.coalesce(F.col("n_exact_candidates"), F.lit(0))
    enough = n >= NEIGHBOURS
    reason = (
        F.when(~F.col("inside_quantile_box"), "outside_quantile_box")
        .when(~enough, "fewer_than_ten_exact_candidates")
        .when(F.col("n_within") < NEIGHBOURS, "distance_caliper")
        .otherwise("retained")
    )
    support = durable(in_box.join(counts, [*KEYS, "source_id"], "left").join(caliper, KEYS, "left").select(
        *KEYS, "source_id", "trade_date", "ew", "inside_quantile_box", n.alias("n_exact_candidates"),
        F.when(enough, F.col("n_within")).otherwise(0).alias("n_within_caliper"), F.col("caliper").alias("distance_caliper"),
        F.when(enough, F.col("d1")).alias("nearest_distance"), F.when(enough, F.col("d10")).alias("tenth_distance"),
        reason.alias("reason"),
    ).withColumn("retained", F.col("reason") == "retained"))
    take = F.least(F.col("cw"), F.lit(NEIGHBOURS) - (F.col("upto") - F.col("cw")))
    matches = pairs.withColumn("take", take).where("take > 0").join(
        support.where("retained").select(*KEYS, "source_id"), [*KEYS, "source_id"], "left_semi"
    ).select(*KEYS, F.col("source_id").alias("event_id"), F.col("control_id").alias("source_id"), "take", "distance")
    return support, matches


def corrected_events(rows: DataFrame, support: DataFrame, matches: DataFrame) -> DataFrame:
    """Residual of each retained event less the mean residual of its ten matched places."""
    cols = [*OUTCOMES, *[f"e_{c}" for c in OUTCOMES]]
    side = rows.where("not is_event").select(*KEYS, "source_id", *cols)
    means = matches.join(side, [*KEYS, "source_id"]).groupBy(*KEYS, F.col("event_id").alias("source_id")).agg(
        F.sum("take").alias("n_matches"), *[(F.sum(F.col("take") * F.col(c)) / F.sum("take")).alias(f"c_{c}") for c in cols]
    )
    events = rows.where("is_event").select(*KEYS, "source_id", "trade_date", "w", *cols, *[f"mu_{c}" for c in OUTCOMES])
    out = events.join(means, [*KEYS, "source_id"])
    short = lambda c: c.replace("d_", "")
    return out.select(
        *KEYS, "source_id", "trade_date", "w", "n_matches",
        *[F.col(c).alias(f"event_d{short(c)}") for c in OUTCOMES],
        *[F.col(f"c_{c}").alias(f"control_d{short(c)}") for c in OUTCOMES],
        *[(F.col(c) - F.col(f"c_{c}")).alias(f"raw_{short(c)}") for c in OUTCOMES],
        *[F.col(f"mu_{c}").alias(f"predicted_event_{short(c)}") for c in OUTCOMES],
        *[(F.col(f"e_{c}") - F.col(f"c_e_{c}")).alias(f"corrected_{short(c)}") for c in OUTCOMES],
    ).withColumn("rotation_gg_minus_fx", F.col("corrected_22") - F.col("corrected_11"))


CORRECTED = ("corrected_11", "corrected_12", "corrected_22")


def estimate(samples: DataFrame) -> dict[str, DataFrame]:
    """All tables of the estimator for every (scenario, draw) in ``samples``.

    Tables that several later steps read are written once.
    """
    rows, diagnostics = continuation(durable(standardised(samples)))
    rows = durable(rows)
    support, matches = supported_matches(rows)
    matches = durable(matches)
    events = corrected_events(rows, support, matches)
    return {"rows": rows, "diagnostics": diagnostics, "support": support, "matches": matches, "events": events,
            "spectrum": spectrum_of_means(events, KEYS, CORRECTED, "w")}


def bootstrap(samples: DataFrame, observed: DataFrame, draws: int, seed: int, min_events: int = MIN_EVENTS) -> DataFrame:
    """Full re-estimation per draw; draws with too few retained events are coded, not dropped."""
    drawn = estimate(resampled(samples, draws, seed))["spectrum"]
    every = observed.select("scenario").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    out = every.join(drawn, KEYS, "left")
    usable = F.coalesce(F.col("n_events") >= min_events, F.lit(False))
    values = ["A_fx_fx", "A_fx_gg", "A_gg_gg", "lambda_plus", "lambda_minus", "vplus_fx", "vplus_gg", "vminus_fx", "vminus_gg", "rotation_gg_minus_fx"]
    return out.select(
        *KEYS, usable.alias("usable"), F.when(~usable, "fewer_than_minimum_retained_events").otherwise("").alias("failure_reason"),
        F.when(usable, F.col("n_events")).alias("n_events_retained"), *[F.when(usable, F.col(c)).alias(c) for c in values],
    )


def placebo(rows: DataFrame, matches: DataFrame, draws: int, seed: int) -> DataFrame:
    """One matched control per retained event plays the event, on residuals."""
    order = Window.partitionBy("scenario", "event_id").orderBy("distance", "source_id")
    ranked = matches.where("draw = 0").select(
        "scenario", "event_id", F.concat_ws(":", "scenario", "source_id").alias("control_key"), F.row_number().over(order).alias("match_rank")
    )
    controls = rows.where("draw = 0 and not is_event").select(
        F.concat_ws(":", "scenario", "source_id").alias("control_key"), *[f"e_{c}" for c in OUTCOMES]
    )
    values = [f"e_{c}" for c in OUTCOMES]
    pseudo = placebo_values(ranked, controls, ["scenario", "event_id"], values)
    return placebo_spectrum(pseudo, ["scenario", "event_id"], values, draws, seed, by=["scenario"])


SCENARIO_INTERVALS = {k: v for k, v in INTERVALS.items() if not k.startswith("v")}


def scenario_summary(point: dict[str, DataFrame], boot: DataFrame, placebos: DataFrame) -> DataFrame:
    """Long (scenario, metric, value) rows."""
    spec = point["spectrum"].drop("draw")
    inputs = point["support"].groupBy("scenario").agg(F.count(F.lit(1)).alias("n_in"), F.max("distance_caliper").alias("caliper"))
    one = spec.join(inputs, "scenario")
    names = ("A_fx_fx", "A_fx_gg", "A_gg_gg", "lambda_plus", "lambda_minus", "vplus_fx", "vplus_gg", "vminus_fx", "vminus_gg", "rotation_gg_minus_fx")
    out = long_metrics(
        one,
        {"n_events_input": F.col("n_in"), "n_events_retained": F.col("n_events"), "retention_share": F.col("n_events") / F.col("n_in"),
         "distance_caliper": F.col("caliper")} | {n: F.col(n) for n in names},
        ["scenario"],
    )
    fit = point["diagnostics"].select(
        "scenario", F.concat(F.lit("control_cv_r2_"), F.regexp_replace("outcome", "_", "")).alias("metric"), F.col("leave_year_out_r2").alias("value")
    )
    tests = placebos.join(spec.select("scenario", F.col("lambda_minus").alias("lm"), F.col("rotation_gg_minus_fx").alias("rot")), "scenario").groupBy(
        "scenario"
    ).agg(
        ((1 + F.count_if(F.col("lambda_minus") <= F.col("lm"))) / (F.count(F.lit(1)) + 1)).alias("p_placebo_lambda_minus"),
        ((1 + F.count_if(F.col("rotation_gg_minus_fx") >= F.col("rot"))) / (F.count(F.lit(1)) + 1)).alias("p_placebo_rotation_positive"),
    )
    share = boot.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("bootstrap_draws_requested"), F.count_if("usable").alias("bootstrap_draws_usable"),
        F.avg(F.col("usable").cast("double")).alias("bootstrap_usable_share"),
    )
    out = out.unionByName(fit).unionByName(interval_rows(boot.where("usable"), ["scenario"], SCENARIO_INTERVALS))
    for part in (tests, share):
        out = out.unionByName(long_metrics(part, {c: F.col(c) for c in part.columns if c != "scenario"}, ["scenario"]))
    return out


def decision_table(summary: DataFrame, mode: str = "final", min_retention: float = 0.80, min_usable: float = 0.95) -> DataFrame:
    """Six binding gates and the joint decision. Final mode needs the study's number of draws in every scenario."""
    if mode == "final":
        fewest = summary.where(F.col("metric") == "bootstrap_draws_requested").agg(F.min("value")).first()[0]
        if fewest is None or fewest < FINAL_DRAWS:
            raise ValueError(f"final mode needs {FINAL_DRAWS} draws per scenario, not {fewest}")
    gates = F.explode(F.array(*[
        F.struct(F.lit(s + label).alias("criterion"), F.lit(s).alias("scenario"), F.lit(metric).alias("metric"), F.lit(text).alias("threshold"))
        for label, metric, text in (
            ("_lambda_minus_upper_below_zero", "lambda_minus_ci95_hi", "< 0"),
            ("_retention_at_least_80pct", "retention_share", ">= 0.80"),
            ("_bootstrap_usable_at_least_95pct", "bootstrap_usable_share", ">= 0.95"),
        )
        for s in ("full", "exclude_2020")
    ]))
    wanted = summary.sparkSession.range(1).select(gates.alias("g")).select("g.*")
    limit = F.when(F.col("metric") == "retention_share", min_retention).otherwise(min_usable)
    passed = F.when(F.col("threshold") == "< 0", F.col("value") < 0).otherwise(F.col("value") >= limit)
    rows = wanted.join(summary, ["scenario", "metric"], "left").select(
        "criterion", "scenario", "value", "threshold", F.coalesce(passed, F.lit(False)).alias("passed"), F.lit(True).alias("binding"),
        F.lit(mode == "final").alias("evaluated"), F.lit("COMPONENT").alias("status"),
    )
    good = F.bool_and("passed")
    verdict = F.lit("SMOKE_ONLY") if mode == "smoke" else F.when(good, "PASS_RISK_RESOLUTION").otherwise("FAIL_RISK_RESOLUTION")
    final = F.lit(False) if mode == "smoke" else good
    overall = rows.agg(final.alias("passed"), verdict.alias("status")).select(
        F.lit("overall_final_decision").alias("criterion"), F.lit("joint").alias("scenario"), F.col("passed").cast("double").alias("value"),
        F.lit("all binding gates").alias("threshold"), "passed", F.lit(True).alias("binding"), F.lit(mode != "smoke").alias("evaluated"), "status",
    )
    return rows.unionByName(overall)
