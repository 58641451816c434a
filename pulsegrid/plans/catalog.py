"""Registered queries: every operator of the study over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.config import WindowRules
from pulsegrid.functions import scalars as S
from pulsegrid.operators import (
    asof,
    audit,
    cleaning,
    fractional,
    functional,
    panel,
    quality,
    regression,
    state,
    variation,
    windows,
)
from pulsegrid.plans import batteries
from pulsegrid.plans import inputs as I
from pulsegrid.plans.present import present
from pulsegrid.plans.stages import stage
from pulsegrid.session import durable
from pulsegrid.sources import bars as bar_source
from pulsegrid.sources import calendar

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(*columns: str):
    """Register a plan over the tables under its function name."""

    def wrap(plan: Callable[[I.Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # Differences of zone-neutral times must not see the clock changes of a session zone.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return present(plan(I.Tables(spark, folder)), *columns)

        QUERIES[plan.__name__] = run
        return plan

    return wrap


# ---- hourly study -------------------------------------------------------------------------------


def hourly_days(t: I.Tables) -> DataFrame:
    return quality.contract_day_quality(I.hourly_bars(t), I.HOURLY_QUALITY)


def hourly_events(t: I.Tables) -> DataFrame:
    return calendar.build_event_panel(I.hourly_calendar(t))


def hourly_candidates(t: I.Tables) -> DataFrame:
    return quality.contract_candidates(hourly_days(t), hourly_events(t), I.HOURLY_SELECTION)


@stage
def hourly_preferred(t: I.Tables) -> DataFrame:
    return quality.preferred_contracts(hourly_candidates(t))


def hourly_windows(t: I.Tables) -> DataFrame:
    return windows.event_windows(hourly_preferred(t), I.HOURLY_WINDOWS)


def hourly_inside(t: I.Tables) -> DataFrame:
    return windows.window_bars(I.hourly_bars(t), hourly_windows(t))


def hourly_summary(t: I.Tables) -> DataFrame:
    wins = hourly_windows(t)
    return windows.window_summary(wins, windows.window_bars(I.hourly_bars(t), wins), I.HOURLY_WINDOWS)


@query()
def contract_day_quality(t: I.Tables) -> DataFrame:
    return hourly_days(t)


@query()
def file_quality(t: I.Tables) -> DataFrame:
    return quality.file_quality(hourly_days(t))


@query()
def root_report(t: I.Tables) -> DataFrame:
    return quality.root_report(hourly_days(t))


@query("event_date", "event_id", "pr_datetime_local", "pc_datetime_local", "pr_datetime_utc",
       "pc_datetime_utc", "pr_utc_offset_minutes", "pc_utc_offset_minutes")
def event_calendar(t: I.Tables) -> DataFrame:
    return hourly_events(t)


@query("event_date", "root_code", "file_name_clean", "prelim_eligible", "selection_score",
       "rank_within_root_day", "log_total_volume", "one_minus_lowvol")
def contract_selection(t: I.Tables) -> DataFrame:
    return hourly_candidates(t)


@query("event_date", "root_code", "file_name_clean", "prelim_eligible", "selection_score")
def preferred_contract(t: I.Tables) -> DataFrame:
    return hourly_preferred(t)


@query("event_date", "root_code", "file_name_clean", "selection_score")
def best_contracts(t: I.Tables) -> DataFrame:
    return quality.top_rows(
        hourly_preferred(t), [F.desc("selection_score"), F.asc("event_date"), F.asc("root_code")]
    )


@query("event_date", "n_candidates_total", "n_candidates_fx", "n_candidates_gg", "has_preferred_fx",
       "has_preferred_gg", "pref_fx_eligible", "pref_gg_eligible")
def event_coverage(t: I.Tables) -> DataFrame:
    cand = hourly_candidates(t)
    return quality.event_coverage(hourly_events(t), cand, quality.preferred_contracts(cand))


def classified_lines(t: I.Tables) -> tuple[DataFrame, DataFrame]:
    lines = I.dirty_lines(t)
    rows = bar_source.decode_lines(bar_source.data_lines(lines))
    return cleaning.classify_rows(rows, I.HOURLY_CLEANING), bar_source.line_bounds(lines)


@query()
def bar_cleaning_log(t: I.Tables) -> DataFrame:
    return cleaning.cleaning_log(classified_lines(t)[0], I.HOURLY_CLEANING)


@query()
def bar_cleaning_summary(t: I.Tables) -> DataFrame:
    rows, bounds = classified_lines(t)
    return cleaning.cleaning_summary(rows, bounds, I.HOURLY_CLEANING)


@query()
def cleaned_bars(t: I.Tables) -> DataFrame:
    return cleaning.clean_bars(classified_lines(t)[0])


@query("file_name", "header_ok", "footer_present", "n_rows", "first_ts", "last_ts", "sort_order",
       "n_duplicates", "n_bad_dt", "n_missing_core", "n_nonpositive_price", "n_negative_volume",
       "ohlc_ok", "status", "flags")
def file_audit(t: I.Tables) -> DataFrame:
    lines = I.dirty_lines(t)
    rows = bar_source.decode_lines(bar_source.data_lines(lines))
    return audit.audit_files(rows, bar_source.line_bounds(lines))


@query()
def coverage_grid(t: I.Tables) -> DataFrame:
    files = I.hourly_bars(t).select(
        F.col("file_name_clean").alias("file_name"), "root_code", "expiry_code", "contract_year"
    ).distinct()
    return audit.coverage_grid(t.spark, files, expiries=("C", "E", "P", "V"), years=(2023, 2024))


@query("event_date", "root_code", "file_name_clean", "window_name", "Time", "Latest", "Volume",
       "rel_event_minutes")
def event_window_bars(t: I.Tables) -> DataFrame:
    return hourly_inside(t)


@query("event_date", "root_code", "file_name_clean", "window_name", "n_obs_bars", "n_expected_bars",
       "pct_expected_bars", "exact_event_bar_present", "first_bar_time", "last_bar_time",
       "max_gap_minutes", "median_gap_minutes", "n_long_gaps", "share_low_volume", "rv", "rsv_pos",
       "rsv_neg", "abs_return_sum", "net_log_return", "window_eligible")
def event_window_summary(t: I.Tables) -> DataFrame:
    return hourly_summary(t)


@query("event_date", "root_code", "file_name_clean", "PR_rv", "PC_rv", "ANN_rv", "PR_n_obs_bars",
       "PC_n_obs_bars", "ANN_n_obs_bars", "PR_net_log_return", "ANN_abs_return_sum",
       "PR_window_eligible", "PC_window_eligible", "ANN_exact_event_bar_present", "pr_datetime_utc",
       "pc_datetime_utc")
def event_window_panel(t: I.Tables) -> DataFrame:
    return windows.wide_panel(hourly_summary(t))


@query()
def window_coverage(t: I.Tables) -> DataFrame:
    return windows.window_coverage(hourly_summary(t))


@query("event_date", "root_code", "file_name_clean", "window_name", "pct_expected_bars",
       "share_low_volume")
def best_windows(t: I.Tables) -> DataFrame:
    return quality.top_rows(
        hourly_summary(t),
        [F.desc("pct_expected_bars"), F.asc("share_low_volume"), F.asc("event_date"),
         F.asc("root_code"), F.asc("window_name")],
    )


@query("event_date", "root_code", "file_name_clean", "pre_PR_n_bars", "pre_PR_signed_jump",
       "pre_PR_abs_jump", "pre_PR_rv", "pre_PR_rsv_neg", "pre_asinh_PR_rv", "pre_asinh_PR_rsvneg")
def placebo_panel(t: I.Tables) -> DataFrame:
    return windows.placebo_panel(hourly_inside(t), -180, -60)


def hourly_audit(t: I.Tables) -> DataFrame:
    return windows.alignment_audit(hourly_preferred(t), I.hourly_bars(t), I.HOURLY)


@query("event_date", "root_code", "file_name_clean", "alignment", "offset_from_corrected_minutes",
       "evaluation_time_utc", "exact_current_bar", "exact_lag_bar", "exact_return_pair", "log_return",
       "abs_log_return", "volume")
def alignment_audit(t: I.Tables) -> DataFrame:
    return hourly_audit(t)


@query()
def alignment_summary(t: I.Tables) -> DataFrame:
    return windows.alignment_summary(hourly_audit(t))


def hourly_targets(t: I.Tables) -> DataFrame:
    """Preferred contracts of every event with the bar count to extract."""
    return hourly_preferred(t).select(
        "event_date", "root_code", "file_name_clean", "pr_datetime_utc",
        (F.col("n_bars") % 7 + 3).cast("int").alias("n_bars_target"),
    )


@query("event_date", "root_code", "file_name_clean", "bar_index_in_pr", "bar_time", "price_bar",
       "prev_price_bar", "r_bar")
def asof_bar_panel(t: I.Tables) -> DataFrame:
    return asof.asof_bars(hourly_targets(t), I.hourly_bars(t))[0]


@query("event_date", "root_code", "file_name_clean", "status", "n_bars_target", "n_bars_extracted",
       "rv_from_bars", "net_return_from_bars", "first_bar_time", "last_bar_time", "bns_eligible")
def asof_bar_status(t: I.Tables) -> DataFrame:
    return asof.asof_bars(hourly_targets(t), I.hourly_bars(t))[1]


@query()
def bipower_components(t: I.Tables) -> DataFrame:
    return variation.bipower_components(asof.asof_bars(hourly_targets(t), I.hourly_bars(t))[0])


@query()
def bipower_feasibility(t: I.Tables) -> DataFrame:
    rows = variation.bipower_components(asof.asof_bars(hourly_targets(t), I.hourly_bars(t))[0])
    return variation.bipower_feasibility(rows)


# ---- session study ------------------------------------------------------------------------------


def session_days(t: I.Tables) -> DataFrame:
    return quality.contract_day_quality(I.session_bars(t), I.SESSION_QUALITY)


def session_measures(t: I.Tables) -> DataFrame:
    return variation.grid_variation(
        variation.grid_slots(I.session_bars(t), I.session_clocks(t), I.SESSION_GRID), I.SESSION_GRID
    )


def session_candidates(t: I.Tables) -> DataFrame:
    return variation.root_day_candidates(
        session_days(t), I.session_clocks(t), session_measures(t), I.SESSION_GRID
    )


@stage
def session_windows(t: I.Tables) -> DataFrame:
    """Chosen contract per session and root with the session's own calendar columns."""
    rows = variation.root_day_windows(session_candidates(t))
    return rows.withColumns(I.session_calendar_columns(F.col("session")))


@query("trade_date", "root_code", "file_name_clean", "n_pre_returns", "n_post_returns", "pre_volume",
       "pre_coverage", "post_coverage", "RV_pre", "BV_pre", "JV_pre", "jump_share_pre", "RV_post",
       "BV_post", "JV_post", "jump_share_post")
def grid_returns_variation(t: I.Tables) -> DataFrame:
    return session_measures(t)


@query("trade_date", "root_code", "file_name_clean", "is_event", "event_id", "selection_status",
       "window_eligible", "log_BV_pre", "log_BV_post", "log_RV_pre", "log_RV_post", "log_day_rv",
       "weekday_number", "clock_late", "year_number")
def root_day_windows(t: I.Tables) -> DataFrame:
    return session_windows(t)


# ---- release panel over sessions ----------------------------------------------------------------

SESSION_WINDOWS = WindowRules(1440, 1.0, 5 * 1440, 3 * 1440, 1440, 4 * 1440, 5 * 1440, 2 * 1440, 0.60, 0.50, 4320.0)


@stage
def session_preferred(t: I.Tables) -> DataFrame:
    """Every session as a release of its chosen contract."""
    at = F.col("pseudo_pr_datetime_utc")
    later = S.shift_minutes(at, 1440)
    return session_windows(t).select(
        F.col("trade_date").alias("event_date"),
        "trade_date",
        F.concat(F.lit("ECB_"), F.date_format("trade_date", "yyyyMMdd")).alias("event_id"),
        "root_code",
        "file_name_clean",
        F.lit("Z").alias("expiry_code"),
        F.col("year_number").cast("double").alias("contract_year"),
        at.alias("pr_datetime_local"),
        later.alias("pc_datetime_local"),
        at.alias("pr_datetime_utc"),
        later.alias("pc_datetime_utc"),
        F.lit(True).alias("prelim_eligible"),
    )


def session_wide(t: I.Tables) -> tuple[DataFrame, DataFrame]:
    wins = windows.event_windows(session_preferred(t), SESSION_WINDOWS)
    inside = windows.window_bars(I.session_bars(t), wins)
    return windows.wide_panel(windows.window_summary(wins, inside, SESSION_WINDOWS)), inside


@stage
def session_baseline(t: I.Tables) -> DataFrame:
    return panel.baseline_panel(session_wide(t)[0], I.session_surprises(t).drop("session"))


@stage
def session_signal(t: I.Tables) -> DataFrame:
    base = session_baseline(t)
    placebo = windows.placebo_panel(session_wide(t)[1], -5 * 1440, -1440)
    return panel.signal_panel(base, placebo, panel.target_path_factors(base))


SESSION_REGIMES = (date(1997, 1, 1), date(2000, 1, 1))


@stage
def session_state(t: I.Tables) -> tuple[DataFrame, DataFrame]:
    """(event state, long panel)."""
    signal = session_signal(t)
    events = durable(state.event_state(signal, SESSION_REGIMES))
    return events, state.long_state_panel(signal.drop("regime_app"), events)


@query("event_date", "root_code", "PR_neg_share", "PR_pos_share", "log_PR_rv", "PR_semivariance_imbalance",
       "PR_semivariance_ratio", "PR_signed_jump", "shock_target", "PR_n_obs_bars")
def baseline_panel(t: I.Tables) -> DataFrame:
    return session_baseline(t)


@query()
def match_summary(t: I.Tables) -> DataFrame:
    return panel.match_summary(session_baseline(t), ["shock_target"])


@query()
def panel_report(t: I.Tables) -> DataFrame:
    return panel.panel_report(session_baseline(t))


@query("event_date", "root_code", "shock_target", "PR_signed_jump", "PR_rv")
def largest_surprises(t: I.Tables) -> DataFrame:
    rows = session_baseline(t)
    return quality.top_rows(rows, [F.desc_nulls_last(F.abs("shock_target")), F.asc("event_date"), F.asc("root_code")])


@query("event_date", "root_code", "pre_PR_rv", "pre_PR_rsv_neg", "PR_abs_jump", "asinh_PR_rv", "shock_target_10bp",
       "abs_target_10bp", "shock_pos_10bp", "shock_neg_mag_10bp", "shock_target_x_gg")
def signal_panel(t: I.Tables) -> DataFrame:
    return session_signal(t)


@query()
def target_path_factors(t: I.Tables) -> DataFrame:
    return panel.target_path_factors(session_baseline(t))


@query()
def target_path_factors_rows(t: I.Tables) -> DataFrame:
    return panel.target_path_factors(session_baseline(t), row_scaled=True)


@query("event_date", "shock_target_10bp", "state_pre_rv", "state_pre_rsvneg", "state_pre_absjump", "lag1_target_10bp",
       "lag2_target_10bp", "ma3_target_10bp", "ma3_abs_target_10bp", "cumabs_target_10bp", "lag1_pre_rv_state",
       "lag1_pre_rsvneg_state", "cum_target_within_regime_10bp", "shock_target_10bp_z", "state_pre_rv_z",
       "ma3_target_10bp_z", "regime_preapp", "regime_app", "regime_hike")
def event_state_vector(t: I.Tables) -> DataFrame:
    return session_state(t)[0]


@query("event_date", "root_code", "target_x_hike", "target_x_preRV", "target_x_memory", "target_x_preRSVneg")
def long_state_panel(t: I.Tables) -> DataFrame:
    return session_state(t)[1]


@query("event_date", "root_code", "directional_var", "dispersion_var", "directional_share", "asinh_directional_var",
       "asinh_dispersion_var")
def volatility_components(t: I.Tables) -> DataFrame:
    return panel.component_panel(session_baseline(t))


# ---- regression batteries -----------------------------------------------------------------------


@query("model_name", "term", "beta", "se", "t_stat", "n_obs", "n_clusters", "r2")
def cluster_ols_simple(t: I.Tables) -> DataFrame:
    simple = [m for m in batteries.SIGNAL if len(m.terms) == 1]
    return regression.coefficients(regression.cluster_ols(session_signal(t), simple))


@query()
def signal_models(t: I.Tables) -> DataFrame:
    return regression.coefficients(regression.cluster_ols(session_signal(t), batteries.SIGNAL))


@query()
def state_models(t: I.Tables) -> DataFrame:
    return regression.coefficients(regression.cluster_ols(session_state(t)[1], batteries.STATE))


@query()
def state_model_summary(t: I.Tables) -> DataFrame:
    return regression.model_summary(regression.cluster_ols(session_state(t)[1], batteries.STATE))


@query()
def marginal_effects(t: I.Tables) -> DataFrame:
    fitted = regression.cluster_ols(session_state(t)[1], batteries.STATE)
    return regression.linear_effects(fitted, regression.state_effects())


@stage
def purified(t: I.Tables) -> tuple[DataFrame, DataFrame]:
    events, rows = session_state(t)
    shocks = durable(functional.purify_shocks(events))
    return shocks, functional.purified_panel(rows, shocks)


@query()
def shock_purification(t: I.Tables) -> DataFrame:
    return purified(t)[0]


@query()
def purification_summary(t: I.Tables) -> DataFrame:
    return functional.purification_summary(purified(t)[0])


@query()
def purified_models(t: I.Tables) -> DataFrame:
    fitted = regression.cluster_ols(purified(t)[1], batteries.PURIFIED)
    return regression.coefficients(fitted)


@query()
def purified_effects(t: I.Tables) -> DataFrame:
    fitted = regression.cluster_ols(purified(t)[1], batteries.PURIFIED)
    return regression.linear_effects(fitted, regression.state_effects("shock_purified_10bp", "target_purified"))


@query()
def component_models(t: I.Tables) -> DataFrame:
    rows = durable(panel.component_panel(session_state(t)[1]))
    return regression.coefficients(regression.cluster_ols(rows, batteries.COMPONENTS))


@stage
def session_bipower(t: I.Tables) -> DataFrame:
    rows = session_state(t)[1]
    targets = rows.select("event_date", "root_code", "file_name_clean", "pr_datetime_utc",
                          F.lit(6).alias("n_bars_target"))
    bars = asof.asof_bars(targets, I.session_bars(t))[0]
    return rows.join(variation.bipower_components(bars), ["event_date", "root_code"], "left")


@query()
def bipower_models(t: I.Tables) -> DataFrame:
    return regression.coefficients(regression.cluster_ols(session_bipower(t), batteries.BIPOWER))


@query("base", "outcome", "threshold_c", "n_left", "n_right", "n_obs", "n_clusters", "r2", "adj_r2")
def threshold_search(t: I.Tables) -> DataFrame:
    return functional.threshold_search(session_state(t)[1], batteries.FUNCTIONAL)


@query()
def threshold_slopes(t: I.Tables) -> DataFrame:
    fitted = functional.threshold_search(session_state(t)[1], batteries.FUNCTIONAL)
    return regression.linear_effects(fitted, functional.THRESHOLD_EFFECTS)


@query()
def spline_slopes(t: I.Tables) -> DataFrame:
    return functional.spline_fits(session_state(t)[1], batteries.FUNCTIONAL)[1]


@stage
def fractional_fits(t: I.Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fractional.fractional_logit(session_state(t)[1], batteries.FRACTIONAL)


@query()
def fractional_logit(t: I.Tables) -> DataFrame:
    return fractional_fits(t)[0]


@query()
def fractional_summary(t: I.Tables) -> DataFrame:
    return fractional_fits(t)[1]


@query()
def fractional_diagnostics(t: I.Tables) -> DataFrame:
    return fractional_fits(t)[2]
