"""Every SQL twin gives the rows of its query."""

import compare
import pytest

import __spark_entry__ as entry_point

HOURLY = "/root/testdata/sf0.001"
SESSIONS = "/root/testdata/sf0.01"
SESSION_PLANS = {n for n, q in entry_point.queries().items()} - {
    "contract_day_quality", "file_quality", "root_report", "event_calendar", "contract_selection", "preferred_contract",
    "best_contracts", "event_coverage", "bar_cleaning_log", "bar_cleaning_summary", "cleaned_bars", "file_audit", "coverage_grid",
    "event_window_bars", "event_window_summary", "event_window_panel", "window_coverage", "best_windows", "placebo_panel",
    "alignment_audit", "alignment_summary", "asof_bar_panel", "asof_bar_status", "bipower_components", "bipower_feasibility",
    "worst_low_volume_days",
}


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_twin(spark, name):
    folder = SESSIONS if name in SESSION_PLANS else HOURLY
    left = compare.spark_rows(entry_point.queries()[name](spark, folder))
    right = compare.oracle_rows(compare.connect(folder), entry_point.oracle_sql()[name])
    assert compare.difference(left, right) is None


def test_every_twin_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_runs(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0 and "selection_score" in df.columns
