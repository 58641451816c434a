"""Model lists of the study. Names, outcomes, regressors and samples."""

from __future__ import annotations

from pulsegrid.operators.regression import Model

FX, GG = "root_code = 'fx'", "root_code = 'gg'"
SHOCK = "shock_target_10bp"

FRACTIONAL = [
    Model("FR01_target_pooled", "PR_neg_share", (SHOCK, "root_gg")),
    Model("FR02_target_path_pooled", "PR_neg_share", ("target_pca_10bp", "path_pca_10bp", "root_gg")),
    Model("FR03_interaction_pooled", "PR_neg_share", (SHOCK, "root_gg", "shock_target_x_gg")),
    Model("FR04_asymmetry_pooled", "PR_neg_share", ("shock_pos_10bp", "shock_neg_mag_10bp", "root_gg")),
    Model("FR05_pca_asymmetry_pooled", "PR_neg_share", ("pos_pca_10bp", "neg_mag_pca_10bp", "root_gg")),
    Model("FR06_regime_hike", "PR_neg_share", (SHOCK, "regime_hike", "target_x_hike", "root_gg")),
    Model("FR07_target_fx", "PR_neg_share", (SHOCK,), FX),
    Model("FR08_target_gg", "PR_neg_share", (SHOCK,), GG),
    Model("FR09_asymmetry_fx", "PR_neg_share", ("shock_pos_10bp", "shock_neg_mag_10bp"), FX),
    Model("FR10_asymmetry_gg", "PR_neg_share", ("shock_pos_10bp", "shock_neg_mag_10bp"), GG),
    Model("FR11_pca_fx", "PR_neg_share", ("target_pca_10bp", "path_pca_10bp"), FX),
    Model("FR12_pca_gg", "PR_neg_share", ("target_pca_10bp", "path_pca_10bp"), GG),
]

SIGNAL = [
    Model("S01_jump_signed_pooled", "PR_signed_jump", (SHOCK, "root_gg", "shock_target_x_gg")),
    Model("S02_jump_signed_fx", "PR_signed_jump", (SHOCK,), FX),
    Model("S03_jump_signed_gg", "PR_signed_jump", (SHOCK,), GG),
    Model("S04_jump_abs_pooled", "PR_abs_jump", ("abs_target_10bp", "root_gg")),
    Model("S05_asinh_rv_pooled", "asinh_PR_rv", ("abs_target_10bp", "root_gg")),
    Model("S06_asinh_rv_fx", "asinh_PR_rv", ("abs_target_10bp",), FX),
    Model("S07_asinh_rv_gg", "asinh_PR_rv", ("abs_target_10bp",), GG),
    Model("S08_asinh_rsvneg_pooled", "asinh_PR_rsv_neg", ("abs_target_10bp", "root_gg")),
    Model("S09_asinh_rsvneg_asym_pooled", "asinh_PR_rsv_neg", ("shock_pos_10bp", "shock_neg_mag_10bp", "root_gg")),
    Model("S10_asinh_rv_target_path", "asinh_PR_rv", ("abs_target_pca_10bp", "abs_path_pca_10bp", "root_gg")),
    Model("S11_asinh_rsvneg_target_path", "asinh_PR_rsv_neg", ("abs_target_pca_10bp", "abs_path_pca_10bp", "root_gg")),
    Model("S12_placebo_pre_jump", "pre_PR_signed_jump", (SHOCK, "root_gg", "shock_target_x_gg")),
    Model("S13_placebo_pre_asinh_rv", "pre_asinh_PR_rv", ("abs_target_10bp", "root_gg")),
]


def state_terms(kind: str, shock: str = SHOCK, prefix: str = "target") -> tuple[str, ...]:
    state = {
        "hike": "regime_hike",
        "preRV": "state_pre_rv_z",
        "memory": "ma3_target_10bp_z",
        "preRSVneg": "state_pre_rsvneg_z",
    }[kind]
    return (shock, state, f"{prefix}_x_{kind}", "root_gg")


STATE_OUTCOMES = [
    ("01_absjump_regime", "PR_abs_jump", "hike"),
    ("02_absjump_preuncertainty", "PR_abs_jump", "preRV"),
    ("03_absjump_memory", "PR_abs_jump", "memory"),
    ("04_asinhRV_regime", "asinh_PR_rv", "hike"),
    ("05_asinhRV_preuncertainty", "asinh_PR_rv", "preRV"),
    ("07_asinhRSVneg_regime", "asinh_PR_rsv_neg", "hike"),
    ("06_asinhRSVneg_preuncertainty", "asinh_PR_rsv_neg", "preRSVneg"),
]
STATE = [Model(f"SD{n}", y, state_terms(k)) for n, y, k in STATE_OUTCOMES]
PURIFIED = [
    Model(f"PUR{n}", y, state_terms(k, "shock_purified_10bp", "target_purified")) for n, y, k in STATE_OUTCOMES
]

COMPONENTS = [
    Model(f"VC{n}", y, state_terms(k))
    for n, y, k in [
        ("01_dir_regime", "asinh_directional_var", "hike"),
        ("02_dir_preuncertainty", "asinh_directional_var", "preRV"),
        ("03_disp_regime", "asinh_dispersion_var", "hike"),
        ("04_disp_preuncertainty", "asinh_dispersion_var", "preRV"),
        ("05_disp_memory", "asinh_dispersion_var", "memory"),
        ("06_downside_preuncertainty", "asinh_PR_rsv_neg", "preRSVneg"),
    ]
]

BIPOWER = [
    Model(f"BNS{n}", y, state_terms(k))
    for n, y, k in [
        ("01_BV_regime", "asinh_BV_PR", "hike"),
        ("02_BV_preuncertainty", "asinh_BV_PR", "preRV"),
        ("03_BV_memory", "asinh_BV_PR", "memory"),
        ("04_JV_regime", "asinh_JV_PR", "hike"),
        ("05_JV_preuncertainty", "asinh_JV_PR", "preRV"),
        ("06_JV_memory", "asinh_JV_PR", "memory"),
    ]
]

FUNCTIONAL = [
    ("FS01_absjump_preRV", "PR_abs_jump", "state_pre_rv_z"),
    ("FS02_asinhRV_preRV", "asinh_PR_rv", "state_pre_rv_z"),
    ("FS03_asinhRSVneg_preRSV", "asinh_PR_rsv_neg", "state_pre_rsvneg_z"),
]

ABNORMAL = ("abnormal_log_BV", "abnormal_log_RV", "abnormal_jump_share")
EVENT_SAMPLE = "is_event_with_state AND window_eligible"


def _event_model(name: str, outcome: str, q: str, root: str) -> Model:
    terms = (q, "pre_state_z", f"{q}_x_pre", "regime_hike")
    if root == "pooled":
        return Model(name, outcome, terms + ("root_gg",), EVENT_SAMPLE, "trade_date")
    return Model(name, outcome, terms, f"{EVENT_SAMPLE} AND root_code = '{root}'", "trade_date")


COUNTERFACTUAL = [_event_model(f"CF_TARGET_{y}_pooled", y, "q_target", "pooled") for y in ABNORMAL] + [
    _event_model("CF_FACTOR_abnormal_log_BV_pooled", "abnormal_log_BV", "q_factor", "pooled"),
    _event_model("CF_TARGET_abnormal_log_BV_fx", "abnormal_log_BV", "q_target", "fx"),
    _event_model("CF_TARGET_abnormal_log_BV_gg", "abnormal_log_BV", "q_target", "gg"),
]
