"""Registered queries of the counterfactual, validation, rotation and resolution studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators import counterfactual as cf
from pulsegrid.operators import matching, quality, regression, resampling, resolution, spectrum, state, variation
from pulsegrid.plans import batteries
from pulsegrid.plans import inputs as I
from pulsegrid.plans.catalog import query, session_candidates, session_signal, session_state, session_windows
from pulsegrid.plans.stages import stage
from pulsegrid.session import durable

DRAWS = 999
RESOLUTION_DRAWS = 999
SEED = 20260717
PRE_SLOTS, POST_SLOTS, MIN_PAIRS = (-4, -1), (0, 3), 3


def event_sessions(t: I.Tables) -> DataFrame:
    """State of the event sessions only; control sessions carry no surprise."""
    marks = I.session_clocks(t).where("is_event").select(F.col("trade_date").alias("event_date"))
    return session_state(t)[0].join(marks, "event_date", "left_semi")


@stage
def session_panel(t: I.Tables) -> DataFrame:
    rows = state.merge_event_state(state.slow_state(session_windows(t)), event_sessions(t))
    return state.shock_energy(state.pre_state_on_controls(rows))


@query("trade_date", "root_code", "file_name_clean", "pre_eligible", "pre_coverage", "pre_volume", "post_coverage",
       "selected")
def contract_candidates_by_day(t: I.Tables) -> DataFrame:
    return session_candidates(t)


@query("trade_date", "root_code", "slow5_log_rv")
def slow_state(t: I.Tables) -> DataFrame:
    return state.slow_state(session_windows(t))


@query("trade_date", "root_code", "pre_state_z", "pre_state_control_mean", "pre_state_control_sd")
def control_zscore(t: I.Tables) -> DataFrame:
    return state.pre_state_on_controls(session_windows(t))


@query("trade_date", "root_code", "is_event_with_state", "shock_target_10bp", "q_target", "q_target_x_pre")
def shock_energy(t: I.Tables) -> DataFrame:
    return session_panel(t)


@stage
def normal_stage(t: I.Tables) -> tuple[DataFrame, DataFrame]:
    """(normal rows, fits)."""
    rows = session_panel(t)
    normal = durable(cf.normal_rows(rows))
    return normal, cf.normal_fits(normal, cf.normal_spec(rows))


@stage
def abnormal_panel(t: I.Tables) -> DataFrame:
    return cf.abnormal_outcomes(session_panel(t), *normal_stage(t))


@query()
def normal_models(t: I.Tables) -> DataFrame:
    return regression.coefficients(normal_stage(t)[1])


@query()
def normal_summary(t: I.Tables) -> DataFrame:
    normal, fitted = normal_stage(t)
    return cf.normal_summary(fitted, cf.leave_year_out(normal))


@query()
def leave_year_out_mean(t: I.Tables) -> DataFrame:
    return cf.leave_year_out_mean(session_windows(t), "log_BV_post")


@query("trade_date", "root_code", "cf_log_BV_post", "abnormal_log_BV", "abnormal_log_RV", "abnormal_jump_share")
def abnormal_outcomes(t: I.Tables) -> DataFrame:
    return abnormal_panel(t)


def event_coefficients(rows: DataFrame, models, draws: int = DRAWS) -> DataFrame:
    """Coefficients with wild bootstrap p values on the energy and its interaction, of models with enough events."""
    fitted = durable(cf.enough_clusters(regression.cluster_ols(rows, models)))
    tests = resampling.term_columns(fitted.select("model_name", "terms"))
    wild = resampling.wild_cluster_p(regression.design(rows, models), tests, draws, SEED)
    place = fitted.select("model_name", F.posexplode("terms").alias("column", "term"))
    named = wild.join(place, ["model_name", "column"]).select("model_name", "term", "p_wild_cluster")
    return regression.coefficients(fitted).join(named, ["model_name", "term"], "left")


@query("model_name", "t_observed", "p_wild_cluster", "n_usable")
def wild_cluster_simple(t: I.Tables) -> DataFrame:
    """Wild draws of the one-regressor models, which have a closed form on the rows."""
    panel, simple = session_signal(t), [m for m in batteries.SIGNAL if len(m.terms) == 1]
    return resampling.wild_cluster_p(regression.design(panel, simple), {m.name: [1] for m in simple}, DRAWS, SEED)


@query()
def counterfactual_models(t: I.Tables) -> DataFrame:
    return event_coefficients(abnormal_panel(t), batteries.COUNTERFACTUAL)


@query()
def equivalence_tests(t: I.Tables) -> DataFrame:
    fitted = cf.enough_clusters(regression.cluster_ols(abnormal_panel(t), batteries.COUNTERFACTUAL))
    return cf.equivalence(regression.coefficients(fitted))


@query()
def conditional_effects(t: I.Tables) -> DataFrame:
    fitted = cf.enough_clusters(regression.cluster_ols(abnormal_panel(t), batteries.COUNTERFACTUAL))
    effects = regression.linear_effects(fitted, cf.conditional_effects(batteries.COUNTERFACTUAL))
    return cf.with_relative_change(effects)


@query()
def stacked_models(t: I.Tables) -> DataFrame:
    rows, spec = cf.stacked_rows(session_panel(t))
    return cf.stacked_models(durable(rows), spec)[0]


@query()
def stacked_wild(t: I.Tables) -> DataFrame:
    rows, spec = cf.stacked_rows(session_panel(t))
    tests = resampling.term_columns(spec)
    return resampling.wild_cluster_p(durable(rows), tests, DRAWS, SEED)


@query()
def two_stage_bootstrap(t: I.Tables) -> DataFrame:
    rows = session_panel(t)
    ready = durable(resampling.two_stage_rows(rows, cf.normal_rows(rows)))
    return resampling.two_stage_bootstrap(ready, cf.VALIDATION, DRAWS, SEED)


@stage
def root_matches(t: I.Tables) -> tuple[DataFrame, DataFrame]:
    rows = session_panel(t)
    return rows, matching.match_root_days(rows)


@query("trade_date", "root_code", "outcome", "observed_post", "matched_control_mean", "matched_abnormal", "n_matches",
       "mean_abs_state_gap", "mean_abs_slow_gap_z", "max_calendar_gap_years")
def matched_root_days(t: I.Tables) -> DataFrame:
    return matching.matched_rows(root_matches(t)[1])


def matched_battery() -> list[regression.Model]:
    return [
        regression.Model(
            f"MATCHED_{name}", matching.MATCHED_NAMES[y],
            (q, "pre_state_z", f"{q}_x_pre", "regime_hike", *(("root_gg",) if root == "pooled" else ())),
            "window_eligible" + ("" if root == "pooled" else f" AND root_code = '{root}'"), "trade_date",
        )
        for name, y, q, root in cf.VALIDATION
    ]


@query()
def matched_models(t: I.Tables) -> DataFrame:
    rows, matches = root_matches(t)
    return event_coefficients(durable(matching.matched_panel(rows, matching.matched_rows(matches))), matched_battery())


@query()
def matched_placebos(t: I.Tables) -> DataFrame:
    rows, matches = root_matches(t)
    panel = durable(matching.matched_panel(rows, matching.matched_rows(matches)))
    coefs = regression.coefficients(regression.cluster_ols(panel, matched_battery()))
    observed = coefs.where(F.col("term").rlike("^q_")).select(
        F.regexp_replace("model_name", "^MATCHED_", "").alias("spec"), "term", F.col("beta").alias("observed_beta")
    )
    return resampling.matched_placebos(matches, panel, observed, cf.VALIDATION, DRAWS, SEED)


@query()
def support_by_event(t: I.Tables) -> DataFrame:
    return cf.support_by_event(session_panel(t)).drop("q_factor")


@query()
def support_summary(t: I.Tables) -> DataFrame:
    return cf.support_summary(cf.support_by_event(session_panel(t)))


@query()
def energy_collinearity(t: I.Tables) -> DataFrame:
    return cf.collinearity(session_panel(t))


@query()
def event_leverage(t: I.Tables) -> DataFrame:
    return cf.leverage_by_date(abnormal_panel(t), batteries.COUNTERFACTUAL[0])


#: Numbers of left-out dates that get a wild bootstrap p value.
LEAVE_TOP_WILD = (0, 1, 2, 3, 5)


@query("model_name", "k_removed", "term", "beta", "se", "t_stat", "p_value", "n_obs", "n_clusters", "p_wild_cluster", "removed_dates",
       "largest_removed_energy", "largest_retained_energy")
def leave_top_k(t: I.Tables) -> DataFrame:
    rows, spec = cf.leave_top_k(abnormal_panel(t), batteries.COUNTERFACTUAL)
    rows = durable(rows)
    fitted = durable(cf.enough_clusters(regression.cluster_fit(rows, spec)))
    tests = {m: js for m, js in resampling.term_columns(spec).items() if int(m.split("#")[1]) in LEAVE_TOP_WILD}
    wild = resampling.wild_cluster_p(rows, tests, DRAWS, SEED)
    place = fitted.select("model_name", F.posexplode("terms").alias("column", "term"))
    named = wild.join(place, ["model_name", "column"]).select("model_name", "term", "p_wild_cluster")
    found = regression.coefficients(fitted).where(F.col("term").rlike("^q_")).join(named, ["model_name", "term"], "left").withColumns(
        {"base_name": F.split_part("model_name", F.lit("#"), F.lit(1)), "k_removed": F.split_part("model_name", F.lit("#"), F.lit(2)).cast("int")})
    return found.join(cf.left_out_energies(abnormal_panel(t), batteries.COUNTERFACTUAL), ["base_name", "k_removed"]).drop("model_name").withColumnRenamed(
        "base_name", "model_name")


# ---- rotation -----------------------------------------------------------------------------------


def session_slots(t: I.Tables) -> DataFrame:
    return variation.grid_slots(I.session_bars(t), I.session_clocks(t), I.SESSION_GRID)


@stage
def session_pairs(t: I.Tables) -> tuple[DataFrame, DataFrame]:
    days, pairs = spectrum.paired_dates(session_panel(t), session_slots(t), PRE_SLOTS, POST_SLOTS, MIN_PAIRS)
    return days, pairs


@stage
def session_matrices(t: I.Tables) -> tuple[DataFrame, DataFrame]:
    """(date matrices, paired returns)."""
    days, pairs = session_pairs(t)
    return spectrum.date_matrices(days, pairs), pairs


@query("trade_date", "is_event", "n_pre_pairs", "n_post_pairs", "qpre_11", "qpre_12", "qpre_22", "qpost_11", "qpost_12",
       "qpost_22", "d_11", "d_12", "d_22", "feature_log_fx_pre", "feature_log_gg_pre", "feature_pre_corr")
def second_moment_matrices(t: I.Tables) -> DataFrame:
    return session_matrices(t)[0]


@stage
def session_abnormal(t: I.Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    matrices, pairs = session_matrices(t)
    matches = durable(spectrum.ladder_matches(matrices))
    return matrices, pairs, matches, spectrum.abnormal_matrices(matrices, matches)


@query("event_key", "control_key", "match_rank", "distance", "match_rule")
def knn_matching_ladder(t: I.Tables) -> DataFrame:
    return session_abnormal(t)[2]


@query("trade_date", "n_matches", "match_rule", "match_dates", "mean_match_distance", "mean_match_year_gap", "event_d11",
       "control_d11", "abnormal_11", "abnormal_12", "abnormal_22", "rotation_gg_minus_fx")
def abnormal_matrices(t: I.Tables) -> DataFrame:
    return session_abnormal(t)[3]


@query()
def spectrum_summary(t: I.Tables) -> DataFrame:
    _, pairs, _, rows = session_abnormal(t)
    return spectrum.observed_summary(rows, spectrum.control_scales(pairs))


@query("excluded_trade_date", "A_fx_fx", "A_fx_gg", "A_gg_gg", "lambda_plus", "lambda_minus", "rotation_gg_minus_fx")
def leave_one_out_spectrum(t: I.Tables) -> DataFrame:
    return spectrum.leave_one_out(session_abnormal(t)[3])


@query()
def bootstrap_spectrum(t: I.Tables) -> DataFrame:
    return spectrum.bootstrap_spectrum(session_abnormal(t)[3], DRAWS, SEED)


def rotation_placebo(matrices: DataFrame, matches: DataFrame) -> DataFrame:
    values = ["d_11", "d_12", "d_22"]
    controls = matrices.where("not is_event").select(F.col("trade_date").alias("control_key"), *values)
    pseudo = spectrum.placebo_values(matches, controls, ["event_key"], values)
    return spectrum.placebo_spectrum(pseudo, ["event_key"], values, DRAWS, SEED)


@query()
def placebo_spectrum(t: I.Tables) -> DataFrame:
    matrices, _, matches, _ = session_abnormal(t)
    return rotation_placebo(matrices, matches)


@query()
def rotation_inference(t: I.Tables) -> DataFrame:
    matrices, _, matches, rows = session_abnormal(t)
    return spectrum.inference_rows(
        spectrum.spectrum_of_means(rows, []),
        durable(spectrum.bootstrap_spectrum(rows, DRAWS, SEED)),
        rotation_placebo(matrices, matches),
        spectrum.leave_one_out(rows),
    )


# ---- resolution ---------------------------------------------------------------------------------

# Sessions run from 1995 to 2001, so the scenarios leave out two of those years.
SESSION_SCENARIOS = {"full": (), "exclude_2020": (1999,), "exclude_2020_2021": (1999, 2000)}


@stage
def resolution_samples(t: I.Tables) -> DataFrame:
    return resolution.scenario_samples(session_matrices(t)[0], SESSION_SCENARIOS)


@stage
def resolution_point(t: I.Tables) -> tuple[DataFrame, dict[str, DataFrame]]:
    samples = resolution_samples(t)
    return samples, resolution.estimate(samples)


@query()
def continuation_diagnostics(t: I.Tables) -> DataFrame:
    return resolution_point(t)[1]["diagnostics"].drop("draw")


@query("scenario", "trade_date", "inside_quantile_box", "n_exact_candidates", "n_within_caliper", "distance_caliper",
       "nearest_distance", "tenth_distance", "retained", "reason")
def common_support_matching(t: I.Tables) -> DataFrame:
    return resolution_point(t)[1]["support"]


@query()
def corrected_events(t: I.Tables) -> DataFrame:
    return resolution_point(t)[1]["events"].drop("source_id", "draw", "w")


@query()
def matching_balance(t: I.Tables) -> DataFrame:
    point = resolution_point(t)[1]
    return matching.balance(point["rows"], point["matches"], resolution.KEYS, list(resolution.FEATURE_NAMES)).drop("draw")


@stage
def resolution_draws(t: I.Tables) -> DataFrame:
    samples, point = resolution_point(t)
    return resolution.bootstrap(samples, point["spectrum"], RESOLUTION_DRAWS, SEED)


@query()
def resolution_bootstrap(t: I.Tables) -> DataFrame:
    return resolution_draws(t)


@stage
def resolution_tables(t: I.Tables) -> DataFrame:
    _, point = resolution_point(t)
    boot = resolution_draws(t)
    fake = resolution.placebo(point["rows"], point["matches"], DRAWS, SEED)
    return resolution.scenario_summary(point, boot, fake)


@query()
def resolution_summary(t: I.Tables) -> DataFrame:
    return resolution_tables(t)


@query()
def decision_table(t: I.Tables) -> DataFrame:
    mode = "final" if RESOLUTION_DRAWS >= resolution.FINAL_DRAWS else "smoke"
    return resolution.decision_table(resolution_tables(t), mode)


@query("trade_date", "root_code", "file_name_clean", "n_bars", "share_low_volume")
def worst_low_volume_days(t: I.Tables) -> DataFrame:
    from pulsegrid.plans.catalog import hourly_days

    return quality.top_rows(
        hourly_days(t), [F.desc("share_low_volume"), F.asc("n_bars"), F.asc("trade_date"), F.asc("file_name_clean")]
    )
