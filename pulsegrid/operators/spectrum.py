"""Paired second moments around releases, matched abnormal matrices and their spectrum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.draws import draw_numbers, pick
from pulsegrid.functions.frames import attach_row
from pulsegrid.functions.quantiles import grouped_quantiles
from pulsegrid.operators.matching import nearest_controls
from pulsegrid.operators.resampling import unit_weights

TINY = 2.2250738585072014e-308
FEATURES = ("feature_log_fx_pre", "feature_log_gg_pre", "feature_pre_corr", "slow_fx", "slow_gg")


def paired_dates(
    windows: DataFrame, slots: DataFrame, pre: tuple[int, int] = (-10, -1), post: tuple[int, int] = (0, 9), at_least: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(dates, paired returns): days with one usable window per root, the same clock, and enough slots
    where both roots have an exact return, before and after."""
    rows = windows.where("window_eligible").select(
        "trade_date", "root_code", "file_name_clean", "pseudo_pr_datetime_utc", "is_event", "clock_late", "weekday_number",
        "year_number", "regime_hike", "q_target", "pre_state_z", "slow5_log_rv",
    )
    of = lambda r, c: F.max(F.when(F.col("root_code") == r, F.col(c)))
    facts = ("is_event", "clock_late", "weekday_number", "year_number", "regime_hike", "q_target")
    days = rows.groupBy("trade_date").agg(
        *[F.count_if(F.col("root_code") == r).alias(f"n_{r}") for r in ("fx", "gg")],
        F.count_distinct("pseudo_pr_datetime_utc").alias("n_clocks"),
        F.max("pseudo_pr_datetime_utc").alias("pseudo_pr_datetime_utc"),
        *[of("fx", c).alias(c) for c in facts],
        *[of(r, "pre_state_z").alias(f"pre_state_{r}") for r in ("fx", "gg")],
        *[of(r, "slow5_log_rv").alias(f"slow_{r}") for r in ("fx", "gg")],
        *[of(r, "file_name_clean").alias(f"file_{r}") for r in ("fx", "gg")],
    ).where("n_fx = 1 and n_gg = 1 and n_clocks = 1").drop("n_fx", "n_gg", "n_clocks")
    keys = ["trade_date", "root_code", "file_name_clean"]
    side = F.when(F.col("slot").between(*pre), "pre").when(F.col("slot").between(*post), "post")
    chosen = slots.withColumn("side", side).where(F.col("side").isNotNull() & F.col("r").isNotNull()).join(
        rows.select(*keys), keys, "left_semi"
    )
    pairs = chosen.groupBy("trade_date", "side", "slot").agg(of("fx", "r").alias("fx"), of("gg", "r").alias("gg")).dropna()
    counts = pairs.groupBy("trade_date").agg(
        F.count_if(F.col("side") == "pre").alias("n_pre_pairs"), F.count_if(F.col("side") == "post").alias("n_post_pairs")
    ).where((F.col("n_pre_pairs") >= at_least) & (F.col("n_post_pairs") >= at_least))
    days = days.join(counts, "trade_date")
    return days, pairs.join(days.select("trade_date", "is_event"), "trade_date")


def control_scales(pairs: DataFrame) -> DataFrame:
    """Root-mean-square return of each root on control dates."""
    c = pairs.where("not is_event")
    return c.agg(
        F.sqrt(F.avg(F.col("fx") * F.col("fx"))).alias("scale_fx"), F.sqrt(F.avg(F.col("gg") * F.col("gg"))).alias("scale_gg")
    )


def date_matrices(days: DataFrame, pairs: DataFrame) -> DataFrame:
    """Second-moment matrices of scaled returns before and after, their change and the match features."""
    s = F.col("_s")
    scaled = attach_row(pairs, control_scales(pairs)).withColumns(
        {"a": F.col("fx") / s["scale_fx"], "b": F.col("gg") / s["scale_gg"]}
    )
    products = {"11": F.col("a") * F.col("a"), "12": F.col("a") * F.col("b"), "22": F.col("b") * F.col("b")}
    moments = scaled.groupBy("trade_date").agg(
        *[F.avg(F.when(F.col("side") == side, v)).alias(f"q{side}_{n}") for side in ("pre", "post") for n, v in products.items()]
    )
    moments = moments.withColumns({f"d_{n}": F.col(f"qpost_{n}") - F.col(f"qpre_{n}") for n in products})
    return with_features(days.join(moments, "trade_date"))


def with_features(matrices: DataFrame) -> DataFrame:
    tiny = F.lit(TINY)
    rho = F.col("qpre_12") / F.sqrt(F.greatest(F.col("qpre_11") * F.col("qpre_22"), tiny))
    return matrices.withColumns(
        {
            "feature_log_fx_pre": F.log(F.greatest(F.col("qpre_11"), tiny)),
            "feature_log_gg_pre": F.log(F.greatest(F.col("qpre_22"), tiny)),
            "feature_pre_corr": F.atanh(F.least(F.greatest(rho, F.lit(-0.999)), F.lit(0.999))),
        }
    )


def match_features(matrices: DataFrame) -> DataFrame:
    """Features scored by the controls, missing ones at their mean, as a vector."""
    control = ~F.col("is_event")
    stats = matrices.agg(
        *[F.avg(F.when(control, F.col(f))).alias(f"m_{f}") for f in FEATURES],
        *[F.stddev_samp(F.when(control, F.col(f))).alias(f"s_{f}") for f in FEATURES],
    )
    s = F.col("_s")
    sd = lambda f: F.when(s[f"s_{f}"] > 0, s[f"s_{f}"]).otherwise(F.lit(1.0))
    z = [F.coalesce((F.col(f) - s[f"m_{f}"]) / sd(f), F.lit(0.0)) for f in FEATURES]
    return attach_row(matrices, stats).withColumn("z", F.array(*z)).drop("_s")


def with_coords(rows: DataFrame, weight: float = 0.20, years: float = 5.0) -> DataFrame:
    """Match coordinates: features and the year, scaled so that distance is squared Euclidean."""
    return rows.withColumn("coords", F.concat("z", F.array(F.col("year_number") * F.lit(weight ** 0.5 / years))))


def ladder_matches(matrices: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest control dates of every event date, by the ladder of blocks."""
    rows = with_coords(match_features(matrices)).select(
        F.col("trade_date").alias("key"), "is_event", "clock_late", "weekday_number", "year_number", "coords"
    )
    side = lambda event, name: rows.where(F.col("is_event") == event).withColumnRenamed("key", name).drop("is_event")
    return nearest_controls(side(True, "event_key"), side(False, "control_key"), k)


def abnormal_matrices(matrices: DataFrame, matches: DataFrame) -> DataFrame:
    """Event change minus the mean change of its matched controls."""
    d = ["d_11", "d_12", "d_22"]
    controls = matrices.select(F.col("trade_date").alias("control_key"), F.col("year_number").alias("c_year"),
                               *[F.col(c).alias(f"c{c}") for c in d])
    events = matrices.where("is_event").select(F.col("trade_date").alias("event_key"), "year_number", "q_target", "regime_hike", *d)
    means = (
        matches.join(controls, "control_key").join(events.select("event_key", "year_number"), "event_key")
        .groupBy("event_key")
        .agg(
            F.count(F.lit(1)).alias("n_matches"),
            F.max("match_rule").alias("match_rule"),
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("match_rank", "control_key"))), lambda e: e["control_key"].cast("string")), "|"
            ).alias("match_dates"),
            F.avg("distance").alias("mean_match_distance"),
            F.avg(F.abs(F.col("c_year") - F.col("year_number"))).alias("mean_match_year_gap"),
            *[F.avg(f"c{c}").alias(f"control_{c.replace('_', '')}") for c in d],
        )
    )
    a = lambda n: F.col(f"d_{n}") - F.col(f"control_d{n}")
    return events.join(means, "event_key").select(
        F.col("event_key").alias("trade_date"), "n_matches", "match_rule", "match_dates", "mean_match_distance",
        "mean_match_year_gap", "q_target", "regime_hike",
        *[F.col(f"d_{n}").alias(f"event_d{n}") for n in ("11", "12", "22")],
        *[f"control_d{n}" for n in ("11", "12", "22")],
        *[a(n).alias(f"abnormal_{n}") for n in ("11", "12", "22")],
        (a("22") - a("11")).alias("rotation_gg_minus_fx"),
    )


def spectral_columns(a: Column, b: Column, c: Column) -> dict[str, Column]:
    """Eigenvalues and oriented unit eigenvectors of [[a, b], [b, c]] in closed form.

    The vector of the larger value points up on gg, that of the smaller one up on fx.
    """
    mid, half = (a + c) / 2, (a - c) / 2
    radius = F.sqrt(half * half + b * b)
    # Angle of the leading axis from the fx direction.
    angle = F.atan2(b, half) / 2
    x, y = F.cos(angle), F.sin(angle)
    up = F.when(y < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    right = F.when(-y < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return {
        "lambda_plus": mid + radius,
        "lambda_minus": mid - radius,
        "vplus_fx": up * x,
        "vplus_gg": up * y,
        "vminus_fx": right * -y,
        "vminus_gg": right * x,
    }


def spectrum_of_means(rows: DataFrame, keys: list[str], values=("abnormal_11", "abnormal_12", "abnormal_22"), weight: str | None = None) -> DataFrame:
    """Mean matrix and its spectrum per group."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    names = ("A_fx_fx", "A_fx_gg", "A_gg_gg")
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    means = grouped.agg(
        F.sum(w).cast("long").alias("n_events"), *[(F.sum(w * F.col(v)) / F.sum(w)).alias(n) for v, n in zip(values, names)]
    )
    a, b, c = (F.col(n) for n in names)
    return means.withColumns(spectral_columns(a, b, c) | {"rotation_gg_minus_fx": c - a})


def observed_summary(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """Long (metric, value) rows of the observed mean matrix."""
    one = attach_row(spectrum_of_means(rows, []), scales)
    a, b, c = F.col("A_fx_fx"), F.col("A_fx_gg"), F.col("A_gg_gg")
    metrics = {
        "n_events": F.col("n_events").cast("double"),
        "control_scale_fx": F.col("_s.scale_fx"),
        "control_scale_gg": F.col("_s.scale_gg"),
        "A_fx_fx": a, "A_fx_gg": b, "A_gg_gg": c,
        "trace_A": a + c,
        "determinant_A": a * c - b * b,
        **{n: F.col(n) for n in ("lambda_plus", "lambda_minus", "vplus_fx", "vplus_gg", "vminus_fx", "vminus_gg")},
        "mean_rotation_gg_minus_fx": F.col("rotation_gg_minus_fx"),
    }
    return long_metrics(one, metrics)


def long_metrics(one: DataFrame, metrics: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in metrics.items()]))
    return one.select(*(keys or []), rows.alias("m")).select(*(keys or []), "m.*")


def leave_one_out(rows: DataFrame) -> DataFrame:
    """Spectrum without each event in turn, from totals less the event's own values."""
    v = ("abnormal_11", "abnormal_12", "abnormal_22")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in v])
    s = F.col("_s")
    out = [(s[c] - F.col(c)) / (s["n"] - 1) for c in v]
    return attach_row(rows, totals).select(
        F.col("trade_date").alias("excluded_trade_date"), F.col("q_target").alias("excluded_q_target"),
        *[o.alias(n) for o, n in zip(out, ("A_fx_fx", "A_fx_gg", "A_gg_gg"))],
    ).withColumns(
        {k: c for k, c in spectral_columns(F.col("A_fx_fx"), F.col("A_fx_gg"), F.col("A_gg_gg")).items() if k.startswith("lambda")}
        | {"rotation_gg_minus_fx": F.col("A_gg_gg") - F.col("A_fx_fx")}
    )


def bootstrap_spectrum(rows: DataFrame, draws: int = 999, seed: int = 1) -> DataFrame:
    """Spectrum of event resamples; vectors are turned to the side of the observed ones."""
    weights = unit_weights(rows.withColumn("all", F.lit(1)), ["all"], "trade_date", draws, seed).drop("all")
    drawn = spectrum_of_means(rows.join(weights, "trade_date"), ["draw"], weight="w")
    s = F.col("_s")
    plus = F.signum(F.col("vplus_fx") * s["vplus_fx"] + F.col("vplus_gg") * s["vplus_gg"])
    minus = F.signum(F.col("vminus_fx") * s["vminus_fx"] + F.col("vminus_gg") * s["vminus_gg"])
    turn = lambda sign, c: F.when(sign < 0, -F.col(c)).otherwise(F.col(c))
    return attach_row(drawn, spectrum_of_means(rows, [])).withColumns(
        {c: turn(plus, c) for c in ("vplus_fx", "vplus_gg")} | {c: turn(minus, c) for c in ("vminus_fx", "vminus_gg")}
    ).drop("_s", "n_events")


def placebo_values(matches: DataFrame, controls: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per event and match: the control's values less the mean of the other matched controls."""
    joined = matches.select(*keys, "match_rank", "control_key").join(controls, "control_key")
    whole = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(whole)
    rest = lambda c: F.when(n > 1, (F.sum(c).over(whole) - F.col(c)) / (n - 1)).otherwise(F.col(c))
    return joined.select(*keys, "match_rank", n.alias("n"), *[(F.col(c) - rest(c)).alias(c) for c in values])


def placebo_spectrum(pseudo: DataFrame, keys: list[str], values: list[str], draws: int = 999, seed: int = 1, by: list[str] | None = None) -> DataFrame:
    """Spectrum when one matched control per event plays the event."""
    by = by or []
    slots = pseudo.where("match_rank = 1").select(*keys, "n").withColumn("draw", draw_numbers(draws))
    rank = pick(seed, F.col("n"), F.col("draw"), *[F.col(k).cast("string") for k in keys]) + 1
    drawn = slots.withColumn("match_rank", rank).drop("n").join(pseudo.drop("n"), [*keys, "match_rank"])
    return spectrum_of_means(drawn, [*by, "draw"], tuple(values)).select(*by, "draw", "lambda_plus", "lambda_minus", "rotation_gg_minus_fx")


INTERVALS = {
    "lambda_plus": "lambda_plus", "lambda_minus": "lambda_minus", "A_fx_fx": "A_fx_fx", "A_fx_gg": "A_fx_gg", "A_gg_gg": "A_gg_gg",
    "rotation": "rotation_gg_minus_fx", "vplus_fx": "vplus_fx", "vplus_gg": "vplus_gg", "vminus_fx": "vminus_fx", "vminus_gg": "vminus_gg",
}


def interval_rows(draws: DataFrame, keys: list[str], columns: dict[str, str] = INTERVALS) -> DataFrame:
    """Long percentile bounds (keys, metric, value) of draw columns."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("v")) for n, c in columns.items()]))
    tall = draws.select(*keys, each.alias("e")).select(*keys, "e.*")
    bounds = grouped_quantiles(tall, [*keys, "name"], "v", {"lo": 0.025, "hi": 0.975})
    side = F.explode(F.array(F.struct(F.lit("lo").alias("s"), F.col("lo").alias("value")), F.struct(F.lit("hi").alias("s"), F.col("hi").alias("value"))))
    return bounds.select(*keys, "name", side.alias("b")).select(*keys, F.concat("name", F.lit("_ci95_"), "b.s").alias("metric"), "b.value")


def inference_rows(observed: DataFrame, boot: DataFrame, placebo: DataFrame, left_out: DataFrame) -> DataFrame:
    """Intervals, placebo p values, shares of indefinite draws and leave-one-out ranges."""
    s = F.col("_s")
    up, down = F.col("lambda_plus") >= s["lambda_plus"], F.col("lambda_minus") <= s["lambda_minus"]
    turned = F.col("rotation_gg_minus_fx") >= s["rotation_gg_minus_fx"]
    p = lambda c: (1 + F.count_if(c)) / (F.count(F.lit(1)) + 1)
    mixed = ((F.col("lambda_plus") > 0) & (F.col("lambda_minus") < 0)).cast("double")
    tests = attach_row(placebo, observed).agg(
        p(up).alias("p_placebo_lambda_plus"), p(down).alias("p_placebo_lambda_minus"), p(up & down).alias("p_placebo_joint_indefinite"),
        p(turned).alias("p_placebo_rotation_positive"), F.count(F.lit(1)).cast("double").alias("placebo_draws"),
    )
    boots = boot.agg(F.avg(mixed).alias("bootstrap_share_indefinite"), F.count(F.lit(1)).cast("double").alias("bootstrap_draws"))
    ranges = left_out.agg(
        F.avg(mixed).alias("loo_share_indefinite"),
        *[f(c).alias(f"loo_{n}_{k}") for n, c in (("lambda_plus", "lambda_plus"), ("lambda_minus", "lambda_minus"), ("rotation", "rotation_gg_minus_fx"))
          for k, f in (("min", F.min), ("max", F.max))],
    )
    out = interval_rows(boot, [])
    for part in (tests, boots, ranges):
        out = out.unionByName(long_metrics(part, {c: F.col(c) for c in part.columns}))
    return out
