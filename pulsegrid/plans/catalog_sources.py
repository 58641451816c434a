"""Registered queries of the sources and sinks: files are written from the driver tables, then read back as the study does."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators import asof, cleaning, variation, windows
from pulsegrid.plans import catalog, catalog_sessions
from pulsegrid.plans import inputs as I
from pulsegrid.plans.catalog import query
from pulsegrid.plans.stages import stage
from pulsegrid.session import durable, shared_folder
from pulsegrid.sources import bars as bar_source
from pulsegrid.sources import calendar, panels, sinks


def fresh_folder(t: I.Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def raw_name(contract):
    """A provider's file name for a contract of the hourly bars."""
    root = F.when(contract.isin("click", "view"), "fx").otherwise("gg")
    expiry = F.element_at(F.array(*map(F.lit, "hmuz")), (F.ascii(contract) % 4 + 1).cast("int"))
    return F.concat(root, expiry, F.lpad((F.length(contract) + 10).cast("string"), 2, "0"), F.lit("_intraday-60min_historical-data-02-01-2024.csv"))


@stage
def cleaning_run(t: I.Tables) -> tuple[DataFrame, DataFrame]:
    """(bars, file summary) of a cleaning run over raw files, as a later step accepts them."""
    raw = fresh_folder(t, "raw")
    lines = I.dirty_lines(t).withColumn("file_name", raw_name(F.col("file_name")))
    lines.repartition("file_name").sortWithinPartitions("file_name", "raw_line_no").select("line", "file_name").write.partitionBy("file_name").text(raw)
    scanned = durable(bar_source.scan_raw_lines(t.spark, raw))
    rows = durable(cleaning.classify_rows(bar_source.decode_lines(bar_source.data_lines(scanned)), I.HOURLY_CLEANING))
    summary = cleaning.cleaning_summary(rows, bar_source.line_bounds(scanned), I.HOURLY_CLEANING)
    done = fresh_folder(t, "cleaned")
    sinks.publish_cleaning(done, cleaning.clean_bars(rows), cleaning.cleaning_log(rows, I.HOURLY_CLEANING), summary)
    return sinks.accept_cleaning(t.spark, done)


@query()
def cleaned_files(t: I.Tables) -> DataFrame:
    """Contract facts and counts of every raw file, with what the accepted bars hold of it."""
    bars, summary = cleaning_run(t)
    held = bar_source.usable_bars(bars).groupBy("file_name_clean").agg(
        F.count(F.lit(1)).alias("n_bars"), F.round(F.sum("Latest"), 3).alias("sum_latest"), F.sum("Volume").alias("sum_volume"), F.min("Time").alias("first_bar"))
    facts = bar_source.file_metadata(F.col("file_name"))
    return summary.join(held, F.col("file_name") == F.col("file_name_clean"), "left").select(
        "file_name", *[c.alias(n) for n, c in facts.items()], "n_raw_rows", "n_clean_rows", "footer_present", "n_bars", "sum_latest", "sum_volume", "first_bar")


@query()
def clock_manifest(t: I.Tables) -> DataFrame:
    _, summary = cleaning_run(t)
    return sinks.clock_manifest(summary).drop("generated_at_utc")


def written_panel(t: I.Tables, rows: DataFrame, spec: panels.PanelSpec) -> DataFrame:
    folder = fresh_folder(t, spec.label)
    sinks.write_table(rows, folder, "csv", sort_by=[spec.known[0]])
    return panels.read_panel(t.spark, folder, spec)


@stage
def read_panels(t: I.Tables) -> dict[str, DataFrame]:
    """Every panel, written as text and read by its typed reader."""
    own = catalog_sessions.session_matrices(t)[0]
    rows_of_days = catalog_sessions.session_panel(t)
    slow = rows_of_days.groupBy("trade_date").agg(*[F.max(F.when(F.col("root_code") == r, F.col("slow5_log_rv"))).alias(f"slow_{r}") for r in ("fx", "gg")])
    clocks = I.session_clocks(t).select("trade_date", "pseudo_pr_datetime_utc")
    matrices = own.drop("pseudo_pr_datetime_utc", "slow_fx", "slow_gg").join(slow, "trade_date").join(clocks, "trade_date")
    sources = (
        (panels.DAY_QUALITY, catalog.hourly_days(t)),
        (panels.EVENT_CALENDAR, sinks.require_clocks(catalog.hourly_events(t))),
        (panels.EVENT_STATE, catalog.session_state(t)[0]),
        (panels.PREFERRED_CONTRACTS, catalog.hourly_preferred(t)),
        (panels.VALIDATION_WINDOWS, rows_of_days),
        (panels.DATE_MATRICES, matrices),
    )
    found = {}
    for spec, rows in sources:
        kept = [c for c in (*spec.required, *spec.optional) if c in rows.columns]
        found[spec.label] = written_panel(t, rows.select(*kept), spec)
    return found


#: A number of each panel that the query adds up.
_ADDED = {"contract_day_quality": "ret_var", "event_calendar": None, "event_state": "shock_target_10bp", "preferred_contracts": None,
          "counterfactual_windows": "log_BV_pre", "date_matrices": "d_11"}


@query()
def typed_panels(t: I.Tables) -> DataFrame:
    """Rows, days and one sum of every panel read."""
    parts = []
    for label, rows in read_panels(t).items():
        day = "trade_date" if "trade_date" in rows.columns else "event_date"
        total = F.sum(_ADDED[label]) if _ADDED[label] else F.lit(None).cast("double")
        parts.append(rows.agg(F.lit(label).alias("panel"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(day).alias("n_days"),
                              F.min(day).alias("first_day"), F.max(day).alias("last_day"), total.alias("total")))
    return reduce(DataFrame.unionByName, parts)


@query("trade_date", "root_code", "file_name_clean", "ret_var", "total_volume", "n_bars")
def study_range(t: I.Tables) -> DataFrame:
    """Contract days of the study: from 60 days before the first event to the last, weekdays only."""
    days = read_panels(t)["contract_day_quality"]
    folder = fresh_folder(t, "days")
    sinks.write_table(days, folder, partition_by=["trade_date"])
    events = read_panels(t)["event_calendar"]
    return panels.study_rows(t.spark.read.parquet(folder), events)


@query("trade_date", "is_event", "event_id", "pseudo_pr_datetime_local", "pseudo_pr_datetime_utc", "month_number", "year_number", "weekday_number")
def release_clocks(t: I.Tables) -> DataFrame:
    """Announced releases on event sessions, scheduled ones on all other shipping days, 25 years on, so that both clocks occur."""
    later = lambda c: F.to_date(F.add_months(c, 300))
    days = I.session_bars(t).select(later(F.to_date("Time")).alias("trade_date")).distinct()
    events = calendar.build_event_panel(I.session_clocks(t).where("is_event").select(
        later(F.col("trade_date")).alias("event_date"), F.lit("14:00").alias("pr_time"), F.lit("15:00").alias("pc_time")))
    clocks = variation.release_clocks(days, sinks.require_clocks(events))
    day = F.col("trade_date")
    return clocks.withColumns({"month_number": F.month(day), "year_number": F.year(day), "weekday_number": F.dayofweek(day)})


@query("event_date", "root_code", "file_name_clean", "status", "rv_from_bars", "net_return_from_bars", "PR_rv", "PR_net_log_return", "absdiff_rv",
       "absdiff_net_return")
def bar_reconciliation(t: I.Tables) -> DataFrame:
    """Variation recomputed from the bars of the as-of panel against the event windows' own."""
    wide = windows.wide_panel(catalog.hourly_summary(t))
    return asof.reconcile(asof.asof_bars(catalog.hourly_targets(t), I.hourly_bars(t))[1], wide)
