"""Forward as-of panel: the first bar at or after a release and the bars that follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.functions import scalars as S

PANEL_KEYS = ["event_date", "root_code", "file_name_clean"]


def asof_bars(panel: DataFrame, bars: DataFrame, min_bars: int = 5) -> tuple[DataFrame, DataFrame]:
    """(bar rows, one status row per panel row).

    ``panel`` holds ``pr_datetime_utc`` and the target count ``n_bars_target``. A bar's position in its
    file is the number of bars on earlier days plus its position in the day, so no task ever orders
    a whole file. Day counts tell which days can hold the bars sought; only those are read again.
    """
    priced = bars.where(S.known(F.col("Latest")).isNotNull() & F.col("Time").isNotNull()).select(
        "file_name_clean", "Time", "Latest", F.to_date("Time").alias("bar_day")
    )
    rows = panel.select(*PANEL_KEYS, "pr_datetime_utc", "n_bars_target").withColumn(
        "pr_day", F.to_date("pr_datetime_utc")
    )
    files = rows.select("file_name_clean").distinct()
    counted = (
        priced.join(files, "file_name_clean", "left_semi")
        .groupBy("file_name_clean", "bar_day")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    release_days = rows.where(F.col("pr_day").isNotNull()).select(
        "file_name_clean", F.col("pr_day").alias("bar_day"), F.lit(0).cast("long").alias("n")
    )
    upto = Window.partitionBy("file_name_clean").orderBy("bar_day")
    days = (
        counted.unionByName(release_days)
        .groupBy("file_name_clean", "bar_day")
        .agg(F.sum("n").alias("n"))
        .withColumn("before", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    )
    placed = rows.join(
        days.select(
            "file_name_clean",
            F.col("bar_day").alias("pr_day"),
            F.col("before").alias("pr_before"),
            F.col("n").alias("pr_day_n"),
        ),
        ["file_name_clean", "pr_day"],
        "left",
    )
    totals = counted.groupBy("file_name_clean").agg(F.sum("n").alias("file_bars"))
    placed = placed.join(totals, "file_name_clean", "left")
    reach = F.col("before") < F.col("pr_before") + F.col("pr_day_n") + F.col("n_bars_target")
    held = F.col("before") + F.col("n") >= F.col("pr_before")
    wanted = (
        placed.select("file_name_clean", "pr_before", "pr_day_n", "n_bars_target")
        .join(days.where("n > 0"), "file_name_clean")
        .where(held & reach)
        .select("file_name_clean", "bar_day", "before")
        .distinct()
    )
    in_day = Window.partitionBy("file_name_clean", "bar_day").orderBy("Time")
    indexed = (
        priced.join(wanted, ["file_name_clean", "bar_day"])
        .withColumn("pos", F.col("before") + F.row_number().over(in_day))
        .select("file_name_clean", "bar_day", "pos", "Time", "Latest")
    )
    early = (
        placed.join(
            indexed.select("file_name_clean", F.col("bar_day").alias("pr_day"), "Time"),
            ["file_name_clean", "pr_day"],
        )
        .groupBy(*PANEL_KEYS)
        .agg(F.count_if(F.col("Time") < F.col("pr_datetime_utc")).alias("same_day_before"))
    )
    first = placed.join(early, PANEL_KEYS, "left").withColumn(
        "first_pos", F.col("pr_before") + F.coalesce("same_day_before", F.lit(0)) + 1
    )
    bad_window = F.col("pr_datetime_utc").isNull() | ~S.holds(F.col("n_bars_target") > 0)
    status = (
        F.when(F.col("file_bars").isNull(), "file_not_found")
        .when(bad_window, "invalid_pr_window")
        .when(F.col("first_pos") > F.col("file_bars"), "no_bar_at_or_after_pr")
        .when(F.col("first_pos") == 1, "no_previous_bar")
        .when(
            F.col("file_bars") - F.col("first_pos") + 1 < F.col("n_bars_target"),
            "insufficient_bars_but_usable",
        )
        .otherwise("ok")
    )
    first = first.withColumn("status", status)
    usable = first.where(F.col("status").isin("ok", "insufficient_bars_but_usable"))
    sought = usable.select(
        *PANEL_KEYS,
        "pr_datetime_utc",
        "n_bars_target",
        "first_pos",
        F.explode(
            F.sequence(F.col("first_pos") - 1, F.col("first_pos") + F.col("n_bars_target").cast("long") - 1)
        ).alias("pos"),
    )
    order = Window.partitionBy(*PANEL_KEYS).orderBy("pos")
    found = (
        sought.join(indexed.drop("bar_day"), ["file_name_clean", "pos"])
        .withColumn("prev_price_bar", F.lag("Latest").over(order))
        .where(F.col("pos") >= F.col("first_pos"))
        .select(
            *PANEL_KEYS,
            "pr_datetime_utc",
            "n_bars_target",
            (F.col("pos") - F.col("first_pos") + 1).alias("bar_index_in_pr"),
            F.col("Time").alias("bar_time"),
            F.col("Latest").alias("price_bar"),
            "prev_price_bar",
            (F.log("Latest") - F.log("prev_price_bar")).alias("r_bar"),
        )
    )
    sums = found.groupBy(*PANEL_KEYS).agg(
        F.count(F.lit(1)).alias("n_bars_extracted"),
        F.coalesce(F.sum(F.col("r_bar") * F.col("r_bar")), F.lit(0.0)).alias("rv_from_bars"),
        F.coalesce(F.sum("r_bar"), F.lit(0.0)).alias("net_return_from_bars"),
        F.min("bar_time").alias("first_bar_time"),
        F.max("bar_time").alias("last_bar_time"),
    )
    report = first.select(*PANEL_KEYS, "status", "n_bars_target").join(sums, PANEL_KEYS, "left").withColumns(
        {
            "n_bars_extracted": F.coalesce("n_bars_extracted", F.lit(0)),
            "bns_eligible": S.holds(F.col("n_bars_extracted") >= min_bars),
        }
    )
    return found, report


def reconcile(report: DataFrame, panel: DataFrame) -> DataFrame:
    """Variation recomputed from bars against the panel."""
    stored = panel.select(*PANEL_KEYS, "PR_rv", "PR_net_log_return")
    return report.join(stored, PANEL_KEYS, "left").withColumns(
        {
            "absdiff_rv": F.abs(F.col("rv_from_bars") - F.col("PR_rv")),
            "absdiff_net_return": F.abs(F.col("net_return_from_bars") - F.col("PR_net_log_return")),
        }
    )
