"""Hand-computed cases of the data-engineering operators."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid.config import CleaningRules
from pulsegrid.functions import scalars as S
from pulsegrid.functions import tails
from pulsegrid.functions.frames import date_sequence, from_previous, total_before
from pulsegrid.functions.quantiles import grouped_quantiles
from pulsegrid.functions.timeparse import parse_dates, parse_datetimes
from pulsegrid.operators import asof, audit, cleaning, quality, variation
from pulsegrid.sources import bars as B
from pulsegrid.sources import calendar, sinks, surprises

HEADER = '"Time","Open","High","Low","Latest","Change","%Change","Volume"'


def line(t, price, volume=10, high=None):
    return f'"{t}","{price}","{high or price}","{price}","{price}","0","0%","{volume}"'


def classify(spark, body, footer=True, rules=CleaningRules()):
    lines = [HEADER, *body] + (['"Downloaded from Barchart.com as of"'] if footer else []) + ["", "  "]
    df = spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(lines)], "file_name string, raw_line_no long, line string")
    rows = B.decode_lines(B.data_lines(df))
    return cleaning.classify_rows(rows, rules), B.line_bounds(df), rows


def test_clock_cases(spark):
    assert all(r["ok"] for r in calendar.clock_self_test(spark).collect())


def test_cleaning_reasons(spark):
    body = [
        line("2024-06-03 07:00", 100), line("bad", 100), line("2024-06-03 07:10", 0), line("2024-06-03 07:15", 100, -1),
        '"2024-06-03 07:20","100","90","100","100","0","0%","5"', '"2024-06-03 07:25","100"', line("2024-06-03 07:30", ""),
        line("2024-06-03 07:35", "1,000.5", 1), line("2024-06-03 07:35", 101),
    ]
    got = {r["raw_line_no"]: r["reason"] for r in classify(spark, body)[0].collect()}
    assert got[2] is None and got[3] == "bad_datetime" and got[4] == "nonpositive_price" and got[5] == "negative_volume"
    assert got[6] == "ohlc_inconsistency" and got[7] == "parse_failed"
    assert got[8] == "missing_core_fields;ohlc_inconsistency"
    assert got[9] == "duplicate_timestamp" and got[10] is None


@pytest.mark.parametrize("middle, gap, dropped", [(500, 60, True), (499, 60, False), (500, 61, False), (20, 60, True)])
def test_spike_edges(spark, middle, gap, dropped):
    after = f"2024-06-03 {8 + (gap // 60)}:{gap % 60:02d}"
    body = [line("2024-06-03 07:00", 100), line("2024-06-03 08:00", middle), line(after.replace(" 9", " 09"), 100)]
    got = {r["raw_line_no"]: r["reason"] for r in classify(spark, body)[0].collect()}
    assert (got[3] == "one_bar_price_spike") is dropped


def test_summary_and_log(spark):
    rows, bounds, _ = classify(spark, [line("2024-06-03 07:00", 100, 1), line("x", 1)], footer=False)
    s = cleaning.cleaning_summary(rows, bounds).first()
    assert (s["n_raw_rows"], s["n_invalid_core_dropped"], s["n_clean_rows"], s["n_lowvol_flagged"], s["footer_present"]) == (2, 1, 1, 1, False)
    assert s["first_time_clean"] == datetime(2024, 6, 3, 12, 0)
    log = {r["action"]: r["reason"] for r in cleaning.cleaning_log(rows).collect()}
    assert log == {"flagged_only": "low_volume", "dropped": "bad_datetime"}


def test_empty_file_keeps_a_row(spark):
    rows, bounds, _ = classify(spark, [])
    assert cleaning.cleaning_summary(rows, bounds).first()["n_raw_rows"] == 0


@pytest.mark.parametrize("times, order", [
    (["07:00"], "single"), (["07:00", "07:05"], "strict_ascending"), (["07:05", "07:00"], "strict_descending"),
    (["07:00", "07:00", "07:05"], "ascending_with_duplicates"), (["07:05", "07:00", "07:00"], "descending_with_duplicates"),
    (["07:00", "07:05", "07:01"], "unsorted"),
])
def test_sort_order(spark, times, order):
    _, bounds, rows = classify(spark, [line(f"2024-06-03 {t}", 100) for t in times])
    assert audit.audit_files(rows, bounds).first()["sort_order"] == order


def test_raw_scan_numbers_lines_over_splits(spark, tmp_path):
    lines = [f"line {i}" for i in range(1, 4001)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(lines[:7]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = B.scan_raw_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 4007 and all(r["line"] == f"line {r['raw_line_no']}" for r in got)


def test_file_names(spark):
    df = spark.createDataFrame([("GGH15_intraday-5min_historical-data-01-31-2024.csv",), ("other.csv",)], "n string")
    a, b = df.select(*[v.alias(k) for k, v in B.file_metadata(F.col("n")).items()]).collect()
    assert (a["root_code"], a["expiry_code"], a["contract_year"], a["bar_minutes"], a["download_date"]) == ("gg", "H", 2015.0, 5.0, date(2024, 1, 31))
    assert not b["name_ok"] and b["root_code"] is None


def test_calendar_defaults_and_aliases(spark):
    raw = spark.createDataFrame([("21/07/2022",), ("09/06/2022",), ("09/06/2022",)], "Meeting_Date string")
    got = {r["event_date"]: r for r in calendar.build_event_panel(raw).collect()}
    assert got[date(2022, 7, 21)]["pr_datetime_utc"] == datetime(2022, 7, 21, 12, 15)
    assert got[date(2022, 6, 9)]["pc_datetime_utc"] == datetime(2022, 6, 9, 12, 30) and len(got) == 2
    assert got[date(2022, 6, 9)]["event_id"] == "ECB_20220609"


def test_date_formats_per_column(spark):
    df = spark.createDataFrame([("03/04/2020", "2020-01-02T03:04"), ("25/04/2020", "2020-01-02T03:05")], "d string, t string")
    out = parse_datetimes(parse_dates(df, "d"), "t").collect()
    assert out[0]["d"] == date(2020, 4, 3) and out[1]["t"] == datetime(2020, 1, 2, 3, 5)
    serial = parse_dates(spark.createDataFrame([(43831.5,)], "d double"), "d").first()
    assert serial["d"] == date(2020, 1, 1)


def test_surprises(spark):
    raw = spark.createDataFrame(
        [("2020-01-01", "1.5", "2", "n"), ("2020-01-02", "x", "4", "n"), ("2020-01-03", "2", "", "n"), ("2020-01-04", "3", "6", "n")],
        "date string, `OIS 1M` string, OIS_2Y string, note string")
    out = {r["event_date"].day: r for r in surprises.build_surprises(raw).collect()}
    assert out[1]["shock_target"] == 1.5 and out[2]["shock_target"] is None and out[4]["shock_path_proxy_mean"] == 6.0
    assert out[1]["eampd_note"] == "n"


def test_manifest_gate(spark):
    good = sinks.clock_manifest(spark.createDataFrame([("f", 3)], "file_name string, n_clean_rows long"))
    sinks.require_clock_manifest(good)
    with pytest.raises(ValueError):
        sinks.require_clock_manifest(good.withColumn("raw_time_zone", F.lit("UTC")))
    with pytest.raises(ValueError):
        sinks.require_clock_manifest(good.drop("status"))


def test_run_manifest(spark, tmp_path):
    (tmp_path / "x.txt").write_text("abc")
    rows = {r["key"].split(":")[0]: r["value"] for r in sinks.run_manifest(spark, [str(tmp_path / "x.txt")], {"draws": "9"}).collect()}
    assert rows["sha256"].startswith("ba7816bf") and rows["bytes"] == "3" and rows["draws"] == "9"


def test_missing_clean_files(spark):
    summary = spark.createDataFrame([("a", 1), ("b", 1)], "file_name string, n_clean_rows long")
    present = spark.createDataFrame([("a",), ("z",)], "file_name_clean string")
    assert [r["file_name_clean"] for r in B.missing_clean_files(summary, present).collect()] == ["b"]
    assert [r["file_name_clean"] for r in B.expected_clean_bars(present, summary).collect()] == ["a"]


def test_missing_values_in_scalars(spark):
    df = spark.createDataFrame([(None, float("nan"))], "a double, b double")
    cols = S.surprise_columns(F.col("a"))
    r = df.select(cols["shock_pos_10bp"].alias("p"), S.known(F.col("b")).alias("k"), S.row_mean([F.col("a")]).alias("m"),
                  S.to_flag(F.lit(" TRUE ")).alias("f"), S.clock_to_interval(F.lit("bad")).alias("c")).first()
    assert (r["p"], r["k"], r["m"], r["f"], r["c"]) == (0.0, None, None, True, None)


def test_quantile_rule(spark):
    df = spark.createDataFrame([("g", float(v), 1) for v in (1, 2, 3, 4)] + [("h", 1.0, 3), ("h", 5.0, 1)], "k string, v double, w int")
    got = {r["k"]: r["q"] for r in grouped_quantiles(df, ["k"], "v", {"q": 0.25}).collect()}
    assert got["g"] == 1.5
    weighted = {r["k"]: r["q"] for r in grouped_quantiles(df, ["k"], "v", {"q": 0.75}, "w").collect()}
    assert weighted["h"] == 3.0


def test_tails():
    assert abs(float(tails.t_two_sided(2.228138852, 10)) - 0.05) < 1e-8
    assert abs(float(tails.t_critical(10.0)) - 2.228138852) < 1e-7
    assert abs(float(tails.f_upper(4.102821015, 2, 10)) - 0.05) < 1e-8


def test_sequences_over_years(spark):
    days = [date(2019, 12, 30), date(2019, 12, 31), date(2020, 1, 1), date(2021, 5, 5)]
    df = spark.createDataFrame([(d, float(i + 1)) for i, d in enumerate(days)], "d date, x double")
    rows = from_previous(date_sequence(df, "d"), [], 2, [F.avg("x").alias("m")])
    rows = total_before(rows.withColumn("k", F.lit(1)), ["k"], "d", "x", "t").orderBy("d").collect()
    assert [r["seq"] for r in rows] == [1, 2, 3, 4]
    assert [r["m"] for r in rows] == [None, 1.0, 1.5, 2.5] and [r["t"] for r in rows] == [None, 1.0, 3.0, 6.0]


def bars(spark, times, prices=None):
    return spark.createDataFrame(
        [("f", "fx", datetime.fromisoformat(t), float(p), 5.0) for t, p in zip(times, prices or range(1, 100))],
        "file_name_clean string, root_code string, Time timestamp_ntz, Latest double, Volume double")


def test_asof_crosses_days_and_codes_status(spark):
    b = bars(spark, ["2024-01-01 10:00", "2024-01-03 09:00", "2024-01-03 09:05", "2024-01-05 09:00"])
    at = lambda d, t, n: (date.fromisoformat(d), "fx", "f", datetime.fromisoformat(f"{d} {t}"), n)
    panel = spark.createDataFrame(
        [at("2024-01-02", "12:00", 3), at("2024-01-01", "09:00", 2), at("2024-01-05", "08:00", 4), at("2024-01-06", "08:00", 1),
         at("2024-01-03", "08:00", 0)],
        "event_date date, root_code string, file_name_clean string, pr_datetime_utc timestamp_ntz, n_bars_target int")
    rows, report = asof.asof_bars(panel, b)
    status = {r["event_date"].day: r["status"] for r in report.collect()}
    assert status == {2: "ok", 1: "no_previous_bar", 5: "insufficient_bars_but_usable", 6: "no_bar_at_or_after_pr", 3: "invalid_pr_window"}
    got = [(r["bar_index_in_pr"], r["price_bar"], r["prev_price_bar"]) for r in rows.where("day(event_date) = 2").orderBy("bar_index_in_pr").collect()]
    assert got == [(1, 2.0, 1.0), (2, 3.0, 2.0), (3, 4.0, 3.0)]


def test_grid_needs_exact_pairs(spark):
    times = [f"2023-06-01 {11 + m // 60:02d}:{m % 60:02d}" for m in range(0, 120, 5) if m != 45]
    clocks = spark.createDataFrame([(date(2023, 6, 1), datetime(2023, 6, 1, 12, 0))], "trade_date date, pseudo_pr_datetime_utc timestamp_ntz")
    m = variation.grid_variation(variation.grid_slots(bars(spark, times, [1 + 0.01 * i for i in range(len(times))]), clocks)).first()
    assert (m["n_pre_returns"], m["n_post_returns"], m["pre_volume"]) == (9, 10, 55.0)
    assert m["pre_coverage"] == pytest.approx(9 / 11) and m["post_coverage"] == 1.0


def test_scheduled_controls(spark):
    days = spark.createDataFrame([(date(2023, 6, 1),), (date(2021, 1, 4),)], "trade_date date")
    events = spark.createDataFrame([(date(2023, 6, 1), "ECB_x", datetime(2023, 6, 1, 14, 0), datetime(2023, 6, 1, 12, 0))],
                                   "event_date date, event_id string, pr_datetime_local timestamp_ntz, pr_datetime_utc timestamp_ntz")
    got = {r["trade_date"].year: r for r in variation.release_clocks(days, events).collect()}
    assert got[2023]["is_event"] and got[2021]["event_id"] == "CONTROL_20210104"
    assert got[2021]["pseudo_pr_datetime_utc"] == datetime(2021, 1, 4, 12, 45)


def test_bipower_of_one_return(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), "fx", datetime(2024, 1, 1), 0.1)], "event_date date, root_code string, bar_time timestamp_ntz, r_bar double")
    r = variation.bipower_components(df).first()
    assert r["BV_PR"] is None and r["JV_PR"] == 0.0 and r["jump_share_BNS"] == 0.0


def test_day_quality_of_single_bar(spark):
    r = quality.contract_day_quality(bars(spark, ["2024-01-01 10:00"])).first()
    assert r["n_gaps"] == 0 and r["ret_var"] is None and r["pct_expected_gaps"] is None and not math.isnan(r["span_minutes"])
