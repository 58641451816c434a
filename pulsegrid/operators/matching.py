"""Exact nearest controls inside blocks, with a ladder of looser blocks for sparse events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Tier:
    """Controls that agree on ``same`` and, when ``years`` is set, lie within that many years."""

    name: str
    same: tuple[str, ...]
    years: int | None = None


# The ladder of match rules.
LADDER = (
    Tier("clock_weekday_two_year", ("clock_late", "weekday_number"), 2),
    Tier("clock_two_year", ("clock_late",), 2),
    Tier("clock_weekday_all_years", ("clock_late", "weekday_number")),
    Tier("clock_all_years", ("clock_late",)),
)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _near_years(events: DataFrame, tier: Tier) -> tuple[DataFrame, list[str]]:
    if tier.years is None:
        return events, list(tier.same)
    span = F.explode(F.sequence(F.col("year_number") - tier.years, F.col("year_number") + tier.years))
    return events.withColumn("year_number", span), [*tier.same, "year_number"]


def choose_tier(events: DataFrame, controls: DataFrame, tiers: tuple[Tier, ...], k: int) -> DataFrame:
    """First tier with at least ``k`` controls, else the last one, from block counts alone."""
    blocks = sorted({c for t in tiers for c in t.same} | {"year_number"})
    counts = controls.groupBy(*blocks).agg(F.count(F.lit(1)).alias("n"))
    found = events
    for i, tier in enumerate(tiers[:-1]):
        spread, on = _near_years(events, tier)
        per = spread.join(counts.groupBy(*on).agg(F.sum("n").alias("n")), on).groupBy("event_key").agg(
            F.sum("n").alias(f"n{i}")
        )
        found = found.join(per, "event_key", "left")
    choice = F.lit(len(tiers) - 1)
    for i in reversed(range(len(tiers) - 1)):
        choice = F.when(F.coalesce(F.col(f"n{i}"), F.lit(0)) >= k, F.lit(i)).otherwise(choice)
    return found.withColumn("tier", choice).drop(*[f"n{i}" for i in range(len(tiers) - 1)])


def nearest_controls(
    events: DataFrame,
    controls: DataFrame,
    k: int,
    tiers: tuple[Tier, ...] = LADDER,
    cell: float = 0.75,
) -> DataFrame:
    """(event_key, match_rank, control_key, distance, match_rule): the k nearest controls per event.

    Both sides hold a key, block columns, ``year_number`` and a vector ``coords``; distance is the squared
    Euclidean one, ties go to the smaller key. Controls are summarised into small boxes; an event first
    meets boxes, which bound its k-th distance from above, then only the rows of boxes that can beat that
    bound. The result is exact and no block is paired in full.
    """
    boxed = controls.withColumn(
        "cell", F.transform(F.slice("coords", 1, 2), lambda v: F.floor(v / cell))
    )
    blocks = sorted({c for t in tiers for c in t.same} | {"year_number"})
    z = F.posexplode("coords").alias("pos", "z")
    sides = (
        boxed.select(*blocks, "cell", "control_key", z)
        .groupBy(*blocks, "cell", "pos")
        .agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.count(F.lit(1)).alias("n"))
        .groupBy(*blocks, "cell")
        .agg(
            F.max("n").alias("n"),
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "lo"))), lambda e: e["lo"]).alias("lo"),
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "hi"))), lambda e: e["hi"]).alias("hi"),
        )
    )
    ranked = choose_tier(events, controls, tiers, k)
    parts = []
    for i, tier in enumerate(tiers):
        mine, on = _near_years(ranked.where(F.col("tier") == i), tier)
        met = mine.select("event_key", "coords", *on).join(sides, on)
        parts.append(met.select("event_key", "coords", *blocks, "cell", "n", "lo", "hi",
                                F.lit(tier.name).alias("match_rule")))
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v * v)
    below = F.zip_with("lo", "coords", lambda a, x: F.greatest(a - x, F.lit(0.0)))
    above = F.zip_with("coords", "hi", lambda x, b: F.greatest(x - b, F.lit(0.0)))
    far = F.zip_with(
        F.zip_with("coords", "lo", lambda x, a: F.abs(x - a)),
        F.zip_with("coords", "hi", lambda x, b: F.abs(x - b)),
        lambda p, q: F.greatest(p, q),
    )
    met = met.withColumns({"least": total(below) + total(above), "most": total(far)})
    upto = Window.partitionBy("event_key").orderBy("most").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("held", F.sum("n").over(upto))
    bound = F.min(F.when(F.col("held") >= k, F.col("most"))).over(Window.partitionBy("event_key"))
    close = met.withColumn("bound", bound).where(
        F.col("bound").isNull() | (F.col("least") <= F.col("bound") * (1 + 1e-9) + 1e-12)
    )
    pairs = close.select("event_key", "coords", *blocks, "cell", "match_rule").join(
        boxed.select(*blocks, "cell", "control_key", F.col("coords").alias("c")), [*blocks, "cell"]
    )
    order = Window.partitionBy("event_key").orderBy("distance", "control_key")
    return (
        pairs.select("event_key", "control_key", "match_rule", squared_distance(F.col("coords"), F.col("c")).alias("distance"))
        .withColumn("match_rank", F.row_number().over(order))
        .where(F.col("match_rank") <= k)
    )


MATCH_OUTCOMES = {
    "log_BV_post": "log_BV_pre",
    "log_RV_post": "log_RV_pre",
    "jump_share_post": "jump_share_pre",
}
MATCHED_NAMES = {
    "log_BV_post": "matched_abnormal_log_BV",
    "log_RV_post": "matched_abnormal_log_RV",
    "jump_share_post": "matched_abnormal_jump_share",
}


def _root_day_rows(windows: DataFrame, scale_years: float) -> DataFrame:
    """Complete root-day rows per outcome with match coordinates."""
    control = ~F.col("is_event") & F.col("window_eligible")
    slow = windows.where(control).groupBy("root_code").agg(F.stddev_samp("slow5_log_rv").alias("_sd"))
    rows = windows.join(slow, "root_code", "left").withColumn(
        "_sd", F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    )
    each = F.explode(
        F.array(*[F.struct(F.lit(y).alias("outcome"), F.col(y).alias("value"), F.col(p).alias("pre"))
                  for y, p in MATCH_OUTCOMES.items()])
    )
    days = F.datediff("trade_date", F.lit("1970-01-01"))
    return (
        rows.select("*", each.alias("o")).select("*", "o.*").drop("o")
        .where(F.col("value").isNotNull() & F.col("pre").isNotNull() & F.col("slow5_log_rv").isNotNull()
               & F.col("pre_state_z").isNotNull())
        .withColumns(
            {
                "day": days,
                "coords": F.array("pre_state_z", F.col("slow5_log_rv") / F.col("_sd"),
                                  days / F.lit(365.25) / F.lit(scale_years)),
            }
        )
    )


def match_root_days(
    windows: DataFrame, k: int = 10, at_least: int = 2, max_years: float = 2.0, scale_years: float = 2.0
) -> DataFrame:
    """(trade_date, root_code, outcome, match_rank, control_date, ...) of the nearest control days.

    Blocks are outcome, root, clock and weekday. The year limit is exact in days, so an event takes
    its controls from the years around it and drops those beyond the limit; events left with too few
    fall back to all years.
    """
    rows = _root_day_rows(windows, scale_years)
    blocks = ["outcome", "root_code", "clock_late", "weekday_number"]
    events = rows.where("is_event").select(*blocks, "trade_date", "day", "year_number", "coords", "value", "pre_state_z")
    controls = rows.where("not is_event and window_eligible").select(
        *blocks, "year_number", F.col("trade_date").alias("control_date"), F.col("day").alias("c_day"),
        F.col("coords").alias("c"), F.col("value").alias("control_value"), F.col("pre_state_z").alias("control_state"),
    )
    reach = int(max_years) + 1
    near = events.withColumn(
        "year_number", F.explode(F.sequence(F.col("year_number") - reach, F.col("year_number") + reach))
    ).join(controls, [*blocks, "year_number"]).where(
        F.abs(F.col("day") - F.col("c_day")) / F.lit(365.25) <= max_years
    )
    key = ["outcome", "root_code", "trade_date"]
    full = near.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(*key)
    wide = events.join(full, key, "left_anti").drop("year_number").join(controls.drop("year_number"), blocks)
    pairs = near.drop("year_number").join(full, key, "left_semi").unionByName(wide)
    ranked = pairs.withColumn("distance", squared_distance(F.col("coords"), F.col("c"))).withColumns(
        {
            "match_rank": F.row_number().over(Window.partitionBy(*key).orderBy("distance", "control_date")),
            "state_gap": F.abs(F.get("coords", F.lit(0)) - F.get("c", F.lit(0))),
            "slow_gap": F.abs(F.get("coords", F.lit(1)) - F.get("c", F.lit(1))),
            "year_gap": F.abs(F.col("day") - F.col("c_day")) / F.lit(365.25),
        }
    ).where(F.col("match_rank") <= k)
    size = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return ranked.withColumn("n_matches", size).where(F.col("n_matches") >= at_least).select(
        *key, "match_rank", "control_date", "distance", "value", "pre_state_z", "control_value", "control_state",
        "state_gap", "slow_gap", "year_gap", "n_matches",
    )


def matched_rows(matches: DataFrame) -> DataFrame:
    """Observed outcome against the mean of its matched controls, per event row and outcome."""
    return matches.groupBy("trade_date", "root_code", "outcome").agg(
        F.first("value").alias("observed_post"),
        F.avg("control_value").alias("matched_control_mean"),
        (F.first("value") - F.avg("control_value")).alias("matched_abnormal"),
        F.count(F.lit(1)).alias("n_matches"),
        F.avg("state_gap").alias("mean_abs_state_gap"),
        F.avg("slow_gap").alias("mean_abs_slow_gap_z"),
        F.max("year_gap").alias("max_calendar_gap_years"),
    )


def matched_panel(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """Event rows with the three matched abnormal outcomes."""
    wide = rows.groupBy("trade_date", "root_code").agg(
        *[F.max(F.when(F.col("outcome") == y, F.col("matched_abnormal"))).alias(n) for y, n in MATCHED_NAMES.items()]
    )
    return windows.where("is_event").join(wide, ["trade_date", "root_code"], "left")


def balance(features: DataFrame, matches: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Means of each feature for events, all controls and matched controls, with standardised gaps.

    ``features`` holds keys, source_id, is_event, w and array z; ``matches`` keys, event_id, source_id, w.
    """
    label = F.array(*[F.lit(n) for n in names])
    f = features.select(*keys, "source_id", "is_event", "w", F.posexplode("z").alias("pos", "v"))
    control = ~F.col("is_event")
    w, v = F.col("w"), F.col("v")
    cw = F.sum(F.when(control, w))
    base = f.groupBy(*keys, "pos").agg(
        (F.sum(F.when(control, w * v)) / cw).alias("unmatched_control_mean"),
        F.sqrt((F.sum(F.when(control, w * v * v)) - F.pow(F.sum(F.when(control, w * v)), 2) / cw) / (cw - 1)).alias("sd"),
    )
    kept = matches.select(*keys, "event_id").distinct()
    event = f.where("is_event").withColumnRenamed("source_id", "event_id").join(kept, [*keys, "event_id"], "left_semi")
    event = event.groupBy(*keys, "pos").agg(F.avg("v").alias("event_mean"))
    near = matches.select(*keys, "event_id", "source_id", F.col("take").alias("tw")).join(
        f.where(control).drop("w", "is_event"), [*keys, "source_id"]
    )
    near = near.groupBy(*keys, "event_id", "pos").agg((F.sum(F.col("tw") * v) / F.sum("tw")).alias("m")).groupBy(
        *keys, "pos"
    ).agg(F.avg("m").alias("matched_control_mean"))
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return base.join(event, [*keys, "pos"]).join(near, [*keys, "pos"]).select(
        *keys, F.get(label, F.col("pos")).alias("feature"), "event_mean", "unmatched_control_mean", "matched_control_mean",
        ((F.col("event_mean") - F.col("unmatched_control_mean")) / sd).alias("smd_before"),
        ((F.col("event_mean") - F.col("matched_control_mean")) / sd).alias("smd_after"),
    )
