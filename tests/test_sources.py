"""Panel readers, the cleaning run's commit protocol and its refusals, study range, digests."""

import hashlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import bars as bar_source
from pulsegrid.sources import panels, sinks


def write_text(spark, folder, lines):
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode("overwrite").text(str(folder))
    return str(folder)


def test_reader_brings_columns_to_their_kinds(spark, tmp_path):
    path = write_text(spark, tmp_path / "q", [
        "file_name_clean,trade_date,root_code,ret_var,n_bars,other", "a,03/02/2020,fx,0.5,12,x", "b,13/02/2020, gg ,n/a,,y", ",14/02/2020,fx,1,1,z", "c,not a day,fx,1,1,z"])
    rows = {r.file_name_clean: r for r in panels.read_panel(spark, path, panels.DAY_QUALITY).collect()}
    assert set(rows) == {"a", "b"} and set(rows["a"].asDict()) == {"trade_date", "root_code", "file_name_clean", "ret_var", "n_bars"}
    assert rows["a"].trade_date == date(2020, 2, 3) and rows["a"].ret_var == 0.5 and rows["b"].ret_var is None and rows["b"].root_code == "gg"


def test_reader_keeps_the_first_row_of_a_date(spark, tmp_path):
    lines = ["event_date,event_id,pr_datetime_local,pr_datetime_utc"] + [
        f"2021-01-{1 + i % 5:02},E{i},2021-01-01 13:45,2021-01-01 12:45" for i in range(40)] + ["2021-02-01,bad,,2021-01-01 12:45"]
    got = panels.read_panel(spark, write_text(spark, tmp_path / "e", lines), panels.EVENT_CALENDAR).orderBy("event_date").collect()
    assert [r.event_id for r in got] == ["E0", "E1", "E2", "E3", "E4"] and got[0].pr_datetime_utc == datetime(2021, 1, 1, 12, 45)


def test_reader_names_what_is_missing(spark, tmp_path):
    path = write_text(spark, tmp_path / "w", ["trade_date,root_code", "2020-01-01,fx"])
    with pytest.raises(ValueError, match="counterfactual_windows: missing columns is_event"):
        panels.read_panel(spark, path, panels.VALIDATION_WINDOWS)


def test_reader_takes_flags_and_roots(spark, tmp_path):
    names = list(panels.VALIDATION_WINDOWS.required)
    row = lambda root, flag: ",".join({"trade_date": "2020-01-01", "root_code": root, "is_event": flag, "window_eligible": "1",
                                       "pseudo_pr_datetime_utc": "2020-01-01 12:45"}.get(n, "2.5") for n in names)
    path = write_text(spark, tmp_path / "w", [",".join(names), row("FX", "TRUE"), row("gg", "0"), row("zz", "1")])
    got = {r.root_code: r for r in panels.read_panel(spark, path, panels.VALIDATION_WINDOWS).collect()}
    assert set(got) == {"fx", "gg"} and got["fx"].is_event and not got["gg"].is_event and got["gg"].log_BV_pre == 2.5


def test_study_range_prunes_partitions(spark, tmp_path):
    days = spark.sql("SELECT explode(sequence(date'2020-01-01', date'2020-12-31')) AS trade_date").select("trade_date", F.explode(F.array(F.lit("fx"), F.lit("zz"))).alias("root_code"), F.lit(1).alias("v"))
    sinks.write_table(days, str(tmp_path / "d"), partition_by=["trade_date"])
    events = spark.createDataFrame([(date(2020, 6, 1),), (date(2020, 6, 30),), (None,)], "event_date date")
    found = panels.study_rows(spark.read.parquet(str(tmp_path / "d")), events)
    got = sorted(r.trade_date for r in found.collect())
    assert got[0] == date(2020, 4, 2) and got[-1] == date(2020, 6, 30) and all(d.weekday() < 5 for d in got) and len(got) == len(set(got))
    plan = found._jdf.queryExecution().toString()
    filters = plan[plan.rindex("PartitionFilters"):].split("\n")[0]
    assert "ubquery" in filters
    with pytest.raises(ValueError, match="no valid event dates"):
        panels.study_rows(days, events.where("event_date IS NULL"))


@pytest.fixture
def run(spark):
    bars = spark.createDataFrame([("a.csv", datetime(2020, 1, 2, 10), 1.0, 1.0, 1.0, 1.0, 5.0), ("b.csv", datetime(2020, 1, 3, 10), 1.0, 1.0, 1.0, 1.0, 5.0),
                                  ("extra.csv", datetime(2020, 1, 3, 10), 1.0, 1.0, 1.0, 1.0, 5.0)], bar_source.BAR_SCHEMA)
    log = spark.createDataFrame([("b.csv", 7, "dropped"), ("a.csv", 9, "dropped"), ("a.csv", 2, "dropped")], "file_name string, raw_line_no long, action string")
    summary = spark.createDataFrame([("b.csv", 1), ("a.csv", 1), ("empty.csv", 0)], "file_name string, n_clean_rows long")
    return bars, log, summary


def test_a_finished_run_is_accepted(spark, tmp_path, run):
    sinks.publish_cleaning(str(tmp_path), *run)
    bars, summary = sinks.accept_cleaning(spark, str(tmp_path))
    assert {r.file_name_clean for r in bars.collect()} == {"a.csv", "b.csv"} and summary.count() == 3
    log = [(r.file_name, int(r.raw_line_no)) for r in spark.read.option("header", "true").csv(str(tmp_path / "cleaning_row_flags")).collect()]
    assert log == sorted(log)


def test_steps_refuse_without_a_finished_run(spark, tmp_path, run, monkeypatch):
    folder = str(tmp_path)
    with pytest.raises(ValueError, match="missing"):
        sinks.accept_cleaning(spark, folder)
    sinks.publish_cleaning(folder, *run)
    with monkeypatch.context() as m:  # a second run breaks off: the first one's manifest no longer stands
        m.setattr(sinks, "write_table", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sinks.publish_cleaning(folder, *run)
    with pytest.raises(ValueError, match="does not match"):
        sinks.accept_cleaning(spark, folder)


def test_other_clocks_and_malformed_manifests_are_refused(spark, run):
    manifest = sinks.clock_manifest(run[2])
    sinks.require_clock_manifest(manifest)
    with pytest.raises(ValueError, match="does not match"):
        sinks.require_clock_manifest(manifest.withColumn("raw_time_zone", F.lit("Europe/Paris")))
    with pytest.raises(ValueError, match="malformed"):
        sinks.require_clock_manifest(manifest.drop("status"))
    with pytest.raises(ValueError, match="malformed"):
        sinks.require_clock_manifest(manifest.unionByName(manifest))


def test_missing_files_are_named(spark, tmp_path, run):
    bars, log, summary = run
    sinks.publish_cleaning(str(tmp_path), bars.where("file_name_clean <> 'b.csv'"), log, summary)
    with pytest.raises(ValueError, match="missing for b.csv"):
        sinks.accept_cleaning(spark, str(tmp_path))


def test_clock_mismatch_is_refused(spark):
    rows = [(date(2020, 7, 1), datetime(2020, 7, 1, 13, 45), datetime(2020, 7, 1, 11, 45)), (date(2020, 12, 1), datetime(2020, 12, 1, 13, 45), datetime(2020, 12, 1, 11, 45))]
    events = spark.createDataFrame(rows, "event_date date, pr_datetime_local timestamp_ntz, pr_datetime_utc timestamp_ntz")
    assert sinks.require_clocks(events.where("event_date < '2020-08-01'")).count() == 1
    with pytest.raises(ValueError, match="2020-12-01"):
        sinks.require_clocks(events)


def test_digests_read_files_piece_by_piece(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "DIGEST_CHUNK", 1000)
    (tmp_path / "empty.bin").write_bytes(b"")  # not listed by the reader
    data = {"one.bin": b"x" * 10_001, "three.csv": "é,1\n".encode() * 999}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    facts = {r.path.rsplit("/", 1)[1]: (r.length, r.digest) for r in sinks.file_facts(spark, [str(tmp_path)]).collect()}
    assert facts == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items()}
    rows = {r.key: r.value for r in sinks.run_manifest(spark, [str(tmp_path)], {"draws": "999"}).collect()}
    assert rows["draws"] == "999" and len(rows) == 5


def test_raw_lines_of_named_folders_keep_their_numbers(spark, tmp_path):
    rows = [("a.csv", i, f"line {i}") for i in range(1, 200)] + [("b.csv", 1, "only")]
    spark.createDataFrame(rows, "file_name string, n long, line string").repartition("file_name").sortWithinPartitions("n").select("line", "file_name").write.partitionBy("file_name").text(str(tmp_path / "raw"))
    got = {(r.file_name, r.raw_line_no, r.line) for r in bar_source.scan_raw_lines(spark, str(tmp_path / "raw")).collect()}
    assert got == set(rows)
