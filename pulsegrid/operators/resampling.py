"""Bootstrap and placebo draws. A draw is a key; random choices are hashes of (seed, draw, unit)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions import packed
from pulsegrid.functions.draws import draw_numbers, pick, rademacher
from pulsegrid.functions.frames import date_sequence, dot
from pulsegrid.functions.quantiles import grouped_quantiles
from pulsegrid.operators.regression import no_nan, solve
from pulsegrid.session import durable


def cluster_products(rows: DataFrame) -> DataFrame:
    """(model_name, cluster, g): packed cross products of (x, y) per cluster; all that the wild draws need of the rows."""
    return packed.summed(rows.select("model_name", "cluster", packed.products(F.concat("x", F.array("y"))).alias("g")), ["model_name", "cluster"], "g")


_SOLVED = "model_name string, beta array<double>, inverse array<double>, n_obs double, clusters long"


def _solved(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One k x k solve per model."""
    for pdf in parts:
        out = []
        for r in pdf.itertuples():
            (g,) = packed.unpacked(np.asarray(r.g))
            beta, inverse, _ = solve(g)
            out.append((r.model_name, beta.tolist(), inverse.ravel().tolist(), float(g[0, 0]), r.clusters))
        yield pd.DataFrame(out, columns=["model_name", "beta", "inverse", "n_obs", "clusters"])


def wild_scores(clusters: DataFrame, tests: dict[str, list[int]]) -> DataFrame:
    """What each cluster adds to the draws of each tested column: (model_name, column, cluster, k, v, p, r, a, ...).

    With the null imposed, b0 = beta - A_j beta_j / A_jj are the coefficients without column j, where A is the inverse of X'X
    and A_j its column. v = X'u are the cluster's scores at b0, p = A_j'v, and r = (X'X) A_j over the cluster. A draw with signs s
    has delta = A sum(s v), its coefficient is delta_j, and its cluster scores for column j are s p - r'delta.
    """
    spark = clusters.sparkSession
    tested = F.broadcast(spark.createDataFrame([(m, j) for m, js in tests.items() for j in js], "model_name string, column int"))
    total = packed.summed(clusters, ["model_name"], "g").join(clusters.groupBy("model_name").agg(F.count(F.lit(1)).alias("clusters")), "model_name")
    solved = total.mapInPandas(_solved, _SOLVED).withColumn("k", F.size("beta")).join(tested, "model_name")
    a = F.slice("inverse", F.col("column") * F.col("k") + 1, F.col("k"))
    shrunk = F.get("beta", "column") / F.get("a", "column")
    models = solved.withColumn("a", a).withColumn("b0", F.zip_with("beta", F.col("a"), lambda b, x: b - x * shrunk))
    m = F.col("k") + 1
    own = clusters.join(models, "model_name").withColumn("full", packed.whole(F.col("g"), m))
    own = own.withColumns({"xx": packed.block(F.col("full"), m, F.col("k")), "xy": packed.column(F.col("full"), m, F.col("k"), F.col("k"))})
    scored = own.withColumn("v", F.zip_with("xy", packed.times(F.col("xx"), F.col("b0"), F.col("k")), lambda x, y: x - y))
    return scored.select("model_name", "column", "cluster", "k", "n_obs", "clusters", "inverse", "v", dot(F.col("a"), F.col("v")).alias("p"),
                         packed.times(F.col("xx"), F.col("a"), F.col("k")).alias("r"))


# Draws and clusters whose signs meet the scores at a time.
_DRAWS_AT_ONCE, _CLUSTERS_AT_ONCE = 64, 1024


def signed_sums(scores: DataFrame, draws: int, seed: int) -> DataFrame:
    """(model_name, column, draw, s): sums over clusters of their vectors ``s`` with the draw's signs; draw 0 has all signs 1.

    Signs are hashes of (seed, draw, cluster), made once for all models. Blocks of clusters meet blocks of draws, as one product of
    two small matrices for each tested column; the blocks' sums are added after that. No row is copied per draw.
    """
    keys = ["model_name", "column"]
    clusters = scores.select(F.col("cluster").alias("unit")).distinct()
    deals = clusters.count() // _CLUSTERS_AT_ONCE + 1
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(deals)).cast("int")
    block = F.explode(F.sequence(F.lit(0), F.lit(draws // _DRAWS_AT_ONCE)))
    own = scores.where("s IS NOT NULL").select(*keys, "cluster", "s", deal("cluster").alias("_of"), block.alias("_for"))
    within = F.explode(F.sequence(F.col("_block") * _DRAWS_AT_ONCE, F.least(F.col("_block") * _DRAWS_AT_ONCE + _DRAWS_AT_ONCE - 1, F.lit(draws))))
    sign = F.when(F.col("draw") == 0, 1.0).otherwise(rademacher(seed, F.col("draw"), F.col("unit"))).alias("sign")
    signs = clusters.select("unit", deal("unit").alias("_deal"), block.alias("_block")).select("unit", "_deal", "_block", within.alias("draw")).select("*", sign)

    def each(given: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        at, _ = pd.factorize(pd.concat([given["unit"], found["cluster"]]), use_na_sentinel=False)
        numbers, row = np.unique(given["draw"].to_numpy(), return_inverse=True)
        matrix = np.zeros((len(numbers), at.max(initial=-1) + 1))
        matrix[row, at[: len(given)]] = given["sign"].to_numpy()
        out = []
        for (model, column), g in found.assign(_at=at[len(given):]).groupby(keys):
            sums = matrix[:, g["_at"].to_numpy()] @ np.vstack(g["s"])
            out += [(model, column, int(d), v.tolist()) for d, v in zip(numbers, sums)]
        return pd.DataFrame(out, columns=[*keys, "draw", "s"])

    met = signs.groupBy("_deal", "_block").cogroup(own.groupBy("_of", "_for")).applyInPandas(
        each, "model_name string, column int, draw int, s array<double>")
    return packed.summed(met, [*keys, "draw"], "s")


def wild_draws(scores: DataFrame, draws: int, seed: int) -> DataFrame:
    """(model_name, column, draw, t) of every draw; draw 0 has all signs 1, which gives the data back."""
    keys = ["model_name", "column"]
    vectors = F.concat("v", F.transform("r", lambda x: x * F.col("p")))
    drawn = signed_sums(scores.select(*keys, "cluster", F.transform(vectors, lambda x: F.coalesce(x, F.lit(0.0))).alias("s")), draws, seed)
    whole = scores.groupBy(*keys).agg(F.first("k").alias("k"), F.first("inverse").alias("inverse"), F.first("n_obs").alias("n"),
                                      F.first("clusters").alias("g"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    outer = packed.summed(scores.select(*keys, packed.products(F.col("r")).alias("rr")), keys, "rr")
    fixed = F.broadcast(whole.join(outer, keys).withColumn("rr", packed.whole(F.col("rr"), F.col("k"))))  # one row per tested column
    both = drawn.join(fixed, keys)
    k = F.col("k")
    delta = both.select(*keys, "draw", "k", "n", "g", "pp", "rr", F.slice("s", k + 1, k).alias("pr"),
                        packed.times(F.col("inverse"), F.slice("s", F.lit(1), k), k).alias("delta"))
    squares = F.col("pp") - 2 * dot(F.col("delta"), F.col("pr")) + dot(F.col("delta"), packed.times(F.col("rr"), F.col("delta"), k))
    scale = F.col("g") / F.greatest(F.col("g") - 1, F.lit(1)) * (F.col("n") - 1) / F.greatest(F.col("n") - k, F.lit(1.0))
    return delta.withColumn("variance", scale * squares).select(
        *keys, "draw", F.when(F.col("variance") > 0, F.get("delta", "column") / F.sqrt("variance")).alias("t"))


def wild_cluster_p(rows: DataFrame, tests: dict[str, list[int]], draws: int = 999, seed: int = 1) -> DataFrame:
    """Null-imposed wild cluster bootstrap p per (model_name, column), with the t value of the data.

    Rows are read once, into cross products per cluster; see :func:`wild_scores` and :func:`wild_draws`.
    """
    own = rows.where(F.col("model_name").isin(list(tests)))
    t = durable(no_nan(wild_draws(durable(wild_scores(durable(cluster_products(own)), tests)), draws, seed)))
    observed = t.where("draw = 0").select("model_name", "column", F.col("t").alias("t_observed"))
    counted = t.where("draw > 0 AND t IS NOT NULL").join(F.broadcast(observed), ["model_name", "column"]).groupBy("model_name", "column").agg(
        F.sum((F.abs("t") >= F.abs("t_observed")).cast("long")).alias("exceed"), F.count("t").alias("n_usable"))
    return observed.join(counted, ["model_name", "column"], "left").select(
        "model_name", "column", "t_observed",
        F.when(F.col("t_observed").isNotNull(), (1 + F.coalesce("exceed", F.lit(0))) / (1 + F.coalesce("n_usable", F.lit(0)))).alias("p_wild_cluster"),
        F.coalesce("n_usable", F.lit(0)).alias("n_usable"))


def term_columns(spec: DataFrame, suffixes: tuple[str, ...] = ("q_target", "q_factor", "_x_pre")) -> dict[str, list[int]]:
    """Columns of the energy and its interaction in each model of a small specification table."""
    return {
        r["model_name"]: [i for i, t in enumerate(r["terms"]) if t.endswith(suffixes)] for r in spec.collect()
    }


def unit_weights(units: DataFrame, stratum: list[str], unit: str, draws: int, seed: int) -> DataFrame:
    """(draw, unit, w): how often each unit is drawn when its stratum is resampled with replacement.

    Every unit is also a slot; slot s of draw b picks unit hash(seed, b, s) mod n. Units are numbered in
    their own order, so draws do not depend on partitioning.
    """
    numbered = date_sequence(units.select(*stratum, unit).distinct(), unit, stratum)
    size = numbered.groupBy(*stratum).agg(F.count(F.lit(1)).alias("n"))
    slots = numbered.join(size, stratum).withColumn("draw", draw_numbers(draws))
    chosen = pick(seed, F.col("n"), F.col("draw"), F.col("seq"), *[F.col(c).cast("string") for c in stratum]) + 1
    counts = slots.select(*stratum, "draw", chosen.cast("long").alias("seq")).groupBy(*stratum, "draw", "seq").agg(
        F.count(F.lit(1)).alias("w")
    )
    return counts.join(numbered, [*stratum, "seq"]).select(*stratum, "draw", unit, "w")


def two_sided(d: Column, usable: Column) -> Column:
    low = (1 + F.sum((d <= 0).cast("long"))) / (1 + usable)
    high = (1 + F.sum((d >= 0).cast("long"))) / (1 + usable)
    return F.least(F.lit(1.0), 2 * F.least(low, high))


TWO_STAGE_OUTCOMES = ("log_BV_post", "log_RV_post", "jump_share_post")


_SPEC_SIDE = 7


def two_stage_rows(windows: DataFrame, normal: DataFrame) -> DataFrame:
    """Eligible root-days, one row per outcome, with the normal design vector where the outcome has one."""
    keep = ("trade_date", "root_code", "is_event", "log_BV_pre", "q_target", "q_factor", "regime_hike", "root_gg")
    outcomes = windows.where("window_eligible").select(*keep, F.explode(F.array(*map(F.lit, TWO_STAGE_OUTCOMES))).alias("outcome"))
    return outcomes.join(normal.select("trade_date", "root_code", "outcome", "x", "y"), ["trade_date", "root_code", "outcome"], "left")


def date_weights(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, trade_date, w): event and control dates are resampled apart; draw 0 has every date once."""
    drawn = unit_weights(rows, ["is_event"], "trade_date", draws, seed).select("draw", "trade_date", "w")
    point = rows.select(F.lit(0).alias("draw"), "trade_date", F.lit(1).cast("long").alias("w")).distinct()
    return point.unionByName(drawn)


def control_states(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(draw, root_code, mean, sd) of the state before the release on the drawn control dates, centred before squaring."""
    own = rows.where("NOT is_event AND log_BV_pre IS NOT NULL").select("trade_date", "root_code", "log_BV_pre").distinct()
    centre = own.groupBy("root_code").agg(F.avg("log_BV_pre").alias("centre"))
    d, w = F.col("log_BV_pre") - F.col("centre"), F.col("w")
    sums = weights.join(own.join(centre, "root_code"), "trade_date").groupBy("draw", "root_code").agg(
        F.sum(w).alias("total"), F.sum(w * d).alias("s"), F.sum(w * d * d).alias("ss"), F.first("centre").alias("centre"))
    variance = (F.col("ss") - F.col("s") * F.col("s") / F.col("total")) / (F.col("total") - 1)
    known = sums.where("total > 1").select("draw", "root_code", (F.col("centre") + F.col("s") / F.col("total")).alias("mean"), F.sqrt(variance).alias("sd"))
    return known.where("sd > 0")


def spec_estimates(rows: DataFrame, specs, value: Column, state: Column, weight: Column) -> DataFrame:
    """(draw, spec, term, beta) of the energy and its interaction in every specification: weighted cross products per
    (draw, spec), one solve each; a draw with fewer rows or less rank than columns has no estimate."""
    one = F.lit(1.0)
    cells = []
    for name, y, q, root in specs:
        energy = F.col(q).cast("double")
        x = [one, energy, state, energy * state, F.col("regime_hike").cast("double"), *([F.col("root_gg").cast("double")] if root == "pooled" else [])]
        fits_in = (F.col("outcome") == y) & (F.lit(root == "pooled") | (F.col("root_code") == root))
        complete = value.isNotNull() & state.isNotNull() & F.col(q).isNotNull() & F.col("regime_hike").isNotNull()
        cells.append(F.when(fits_in & complete, F.struct(F.lit(name).alias("spec"), F.array(*x, value).alias("z"))))
    each = rows.select("draw", weight.alias("w"), F.explode(F.array(*cells)).alias("c")).where("c IS NOT NULL").select(
        "draw", "w", "c.spec", packed.products(F.col("c.z")).alias("g"))
    sums = packed.weighted(each, ["draw", "spec"], "g", F.col("w"), packed.triangle(_SPEC_SIDE))
    sums = sums.where(F.col("n_rows") >= packed.side(F.col("g")) - 1)
    fitted = packed.solved(sums, ["draw", "spec"], "g").where(F.col("rank") == F.size("beta"))
    energy = F.create_map(*[F.lit(v) for name, _, q, _ in specs for v in (name, q)])[F.col("spec")]
    return fitted.select("draw", "spec", F.explode(F.array(
        F.struct(energy.alias("term"), F.get("beta", F.lit(1)).alias("beta")),
        F.struct(F.concat(energy, F.lit("_x_pre")).alias("term"), F.get("beta", F.lit(3)).alias("beta")))).alias("e")).select("draw", "spec", "e.*")


def two_stage_estimates(rows: DataFrame, weights: DataFrame, specs, min_controls: int = 100) -> DataFrame:
    """Both stages refitted per draw on date weights: (draw, spec, term, beta).

    The cross products of a root-day are formed once; a draw only weighs and adds them, per (draw, outcome, root) in the first
    stage and per (draw, specification) in the second.
    """
    known = rows.where("x IS NOT NULL AND y IS NOT NULL")
    control = known.where("NOT is_event").select("trade_date", "root_code", "outcome", packed.products(F.concat("x", F.array("y"))).alias("g"))
    keys = ["draw", "outcome", "root_code"]
    sums = packed.drawn(weights, durable(control), "trade_date", keys[1:], "g").where(F.col("total") >= min_controls)
    first = packed.solved(sums, keys, "g")
    events = known.where("is_event").join(weights, "trade_date").join(first, keys).join(control_states(rows, weights), ["draw", "root_code"])
    return spec_estimates(events, specs, F.col("y") - dot(F.col("x"), F.col("beta")), (F.col("log_BV_pre") - F.col("mean")) / F.col("sd"), F.col("w").cast("double"))


def two_stage_bootstrap(rows: DataFrame, specs, draws: int = 999, seed: int = 1) -> DataFrame:
    """Intervals and p values of the two-stage date bootstrap; draw 0 is the estimate itself."""
    estimates = durable(two_stage_estimates(rows, durable(date_weights(rows, draws, seed)), specs))
    names = rows.sparkSession.createDataFrame([(n, t) for n, _, q, _ in specs for t in (q, f"{q}_x_pre")], "spec string, term string")
    observed = names.join(estimates.where("draw = 0").select("spec", "term", F.col("beta").alias("beta_original")), ["spec", "term"], "left")
    return observed.join(draw_summary(estimates.where("draw > 0"), ["spec", "term"], "beta", draws), ["spec", "term"], "left")


def draw_summary(draws_: DataFrame, keys: list[str], value: str, requested: int) -> DataFrame:
    d = F.col(value)
    usable = F.count(d)
    stats = draws_.groupBy(*keys).agg(
        F.stddev_samp(d).alias("bootstrap_se"),
        two_sided(d, usable).alias("p_bootstrap_two_sided"),
        F.avg((d > 0).cast("double")).alias("probability_positive"),
        usable.alias("n_usable"),
    )
    bounds = grouped_quantiles(draws_, keys, value, {"ci95_lo": 0.025, "ci95_hi": 0.975})
    return stats.join(bounds, keys, "left").withColumn("n_requested", F.lit(requested))


def matched_placebos(matches: DataFrame, event_rows: DataFrame, observed: DataFrame, specs, draws: int = 999, seed: int = 1) -> DataFrame:
    """Placebo regressions: one matched control plays the event, the others its controls."""
    key = ["trade_date", "root_code", "outcome"]
    whole = Window.partitionBy(*key)
    rest = (F.sum("control_value").over(whole) - F.col("control_value")) / (F.col("n_matches") - 1)
    pseudo = matches.select(*key, "match_rank", "n_matches", (F.col("control_value") - rest).alias("pseudo"), "control_state")
    slots = matches.where("match_rank = 1").select(*key, "n_matches").withColumn("draw", draw_numbers(draws))
    chosen = pick(seed, F.col("n_matches"), F.col("draw"), F.col("trade_date").cast("string"), F.col("root_code"), F.col("outcome")) + 1
    drawn = slots.withColumn("match_rank", chosen).drop("n_matches").join(pseudo, [*key, "match_rank"])
    facts = event_rows.where("window_eligible").select("trade_date", "root_code", "q_target", "q_factor", "regime_hike", "root_gg")
    rows = drawn.join(facts, ["trade_date", "root_code"])
    betas = durable(spec_estimates(rows, specs, F.col("pseudo"), F.col("control_state"), F.lit(1.0)))
    d = F.col("beta")
    with_obs = betas.join(observed, ["spec", "term"])
    stats = with_obs.groupBy("spec", "term").agg(
        F.max("observed_beta").alias("observed_beta"),
        F.avg(d).alias("placebo_mean"),
        F.stddev_samp(d).alias("placebo_sd"),
        ((1 + F.sum((F.abs(d) >= F.abs("observed_beta")).cast("long"))) / (1 + F.count(d))).alias("p_placebo_two_sided"),
        F.count(d).alias("n_usable"),
    )
    bounds = grouped_quantiles(betas, ["spec", "term"], "beta", {"placebo_ci95_lo": 0.025, "placebo_ci95_hi": 0.975})
    return stats.join(bounds, ["spec", "term"], "left")


def block_bootstrap_mean(series: DataFrame, keys: list[str], value: str, draws: int = 999, block: int = 5, seed: int = 1) -> DataFrame:
    """Circular block bootstrap of a mean: (keys, draw, mean).

    ``series`` holds ``seq`` 1 .. n per key. A block start is a hash of (draw, block number); the positions
    of a draw beyond n are cut off, as when blocks are laid end to end.
    """
    size = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    places = series.select(*keys, (F.col("seq") - 1).alias("place")).join(size, keys)
    drawn = places.withColumn("draw", draw_numbers(draws))
    start = pick(seed, F.col("n"), F.col("draw"), F.floor(F.col("place") / block), *[F.col(k).cast("string") for k in keys])
    at = F.pmod(start + F.col("place") % block, F.col("n")) + 1
    return (
        drawn.select(*keys, "draw", at.cast("long").alias("seq"))
        .join(series.select(*keys, "seq", value), [*keys, "seq"])
        .groupBy(*keys, "draw")
        .agg(F.avg(value).alias("mean"))
    )
