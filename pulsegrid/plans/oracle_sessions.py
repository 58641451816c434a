"""SQL twins of the session studies."""

from __future__ import annotations

from pulsegrid.plans.oracle import cte, twin

twin("worst_low_volume_days", "trade_date:s root_code:s file_name_clean:s n_bars:i share_low_volume:f",
     "(SELECT * FROM hq ORDER BY share_low_volume DESC, n_bars, trade_date, file_name_clean LIMIT 10)")
cte("scsel", """
SELECT *, row_number() OVER (PARTITION BY session, root_code ORDER BY pre_eligible DESC, pre_coverage DESC,
  pre_volume DESC NULLS LAST, file_name_clean) = 1 AS selected FROM sc""")
twin("contract_candidates_by_day", "trade_date:s root_code:s file_name_clean:s pre_eligible:b pre_coverage:f pre_volume:f "
     "post_coverage:f selected:b", "scsel")

# ---- release panel ------------------------------------------------------------------------------

cte("spw", """
SELECT w.session, w.trade_date, w.root_code, w.file_name_clean, b.slot, b.px, b.vol,
  ln(b.px) - ln(lag(b.px) OVER f) AS r, (b.slot - lag(b.slot) OVER f) * 1440 AS gap
FROM sw w JOIN sb b ON b.session = w.session AND b.file_name_clean = w.file_name_clean AND b.slot <= 8
WINDOW f AS (PARTITION BY w.session, w.root_code ORDER BY b.slot)""")
cte("spm", """
SELECT session, trade_date, root_code, file_name_clean, count(*) AS n, bool_or(slot = 5) AS ex,
  max(gap) AS mg, avg((vol <= 1)::INT) AS lv, sum(r * r) AS rv,
  CASE WHEN count(*) > 1 THEN coalesce(sum(r * r) FILTER (r > 0), 0) END AS rp,
  CASE WHEN count(*) > 1 THEN coalesce(sum(r * r) FILTER (r < 0), 0) END AS rn,
  CASE WHEN count(*) > 1 THEN ln(last(px ORDER BY slot) / first(px ORDER BY slot)) END AS net
FROM spw GROUP BY ALL""")
cte("spe", """SELECT * FROM spm WHERE n / 9 >= 0.6 AND lv <= 0.5 AND (mg IS NULL OR mg <= 4320) AND ex""")
cte("sord", """
SELECT (date_diff('day', DATE '1995-01-01', o_orderdate::DATE) // 10)::INT AS session, o_totalprice AS p,
  substr(o_orderpriority, 1, 1) AS k FROM orders""")
cte("sall", """SELECT avg(p) AS m FROM sord""")
cte("ssur", """
SELECT session, DATE '1995-01-01' + session * 10 AS event_date, (avg(p) - (SELECT m FROM sall)) / 1000 AS shock_target
FROM sord GROUP BY session""")
cte("sbase", """
SELECT e.session, e.trade_date AS event_date, e.root_code, e.file_name_clean, e.n AS "PR_n_obs_bars", e.rv AS "PR_rv", e.rp, e.rn,
  e.net AS "PR_signed_jump", e.lv, CASE WHEN rv > 0 THEN rn / rv END AS "PR_neg_share",
  CASE WHEN rv > 0 THEN rp / rv END AS "PR_pos_share", CASE WHEN rv > 0 THEN ln(rv) END AS "log_PR_rv",
  rp - rn AS "PR_semivariance_imbalance", CASE WHEN rn > 0 THEN rp / rn END AS "PR_semivariance_ratio", s.shock_target
FROM spe e LEFT JOIN ssur s ON s.event_date = e.trade_date""")
twin("baseline_panel", "event_date:s root_code:s PR_neg_share:f PR_pos_share:f log_PR_rv:f PR_semivariance_imbalance:f "
     "PR_semivariance_ratio:f PR_signed_jump:f shock_target:f PR_n_obs_bars:i", "sbase")
cte("smatch", """
SELECT count(*) AS n_pr_rows, count(shock_target) AS n_rows_matched, count(*) - count(shock_target) AS n_rows_unmatched,
  count(shock_target) / count(*) AS match_rate FROM sbase""")
twin("match_summary", "n_pr_rows:i n_rows_matched:i n_rows_unmatched:i match_rate:f", "smatch")
cte("sreport", """
SELECT count(*) AS n_rows, count(DISTINCT event_date) AS n_events, count(DISTINCT root_code) AS n_roots,
  avg("PR_n_obs_bars" / 9) AS mean_coverage, avg(lv) AS mean_share_low_volume, avg(abs("PR_signed_jump")) AS mean_abs_net_return
FROM sbase""")
twin("panel_report", "n_rows:i n_events:i n_roots:i mean_coverage:f mean_share_low_volume:f mean_abs_net_return:f", "sreport")
twin("largest_surprises", "event_date:s root_code:s shock_target:f PR_signed_jump:f PR_rv:f",
     "(SELECT * FROM sbase ORDER BY abs(shock_target) DESC NULLS LAST, event_date, root_code LIMIT 10)")
cte("scomp0", """SELECT *, "PR_signed_jump" * "PR_signed_jump" / greatest("PR_n_obs_bars", 1) AS directional_var FROM sbase""")
cte("scomp1", """
SELECT *, CASE WHEN "PR_rv" - directional_var > -1e-12 AND "PR_rv" - directional_var < 0 THEN 0.0
  ELSE "PR_rv" - directional_var END AS dispersion_var FROM scomp0""")
cte("scomp", """
SELECT *, CASE WHEN "PR_rv" <> 0 THEN directional_var / "PR_rv" END AS directional_share,
  asinh(directional_var) AS asinh_directional_var, asinh(dispersion_var) AS asinh_dispersion_var FROM scomp1""")
twin("volatility_components", "event_date:s root_code:s directional_var:f dispersion_var:f directional_share:f "
     "asinh_directional_var:f asinh_dispersion_var:f", "scomp")
cte("spre0", """
SELECT session, root_code, slot, px, ln(px) - ln(lag(px) OVER (PARTITION BY session, root_code ORDER BY slot)) AS r
FROM spw WHERE slot <= 4""")
cte("spre", """
SELECT session, root_code, sum(r * r) AS pre_rv,
  CASE WHEN count(*) > 1 THEN coalesce(sum(r * r) FILTER (r < 0), 0) END AS pre_rn,
  CASE WHEN count(*) > 1 THEN abs(ln(last(px ORDER BY slot) / first(px ORDER BY slot))) END AS pre_aj,
  CASE WHEN count(*) > 1 THEN ln(last(px ORDER BY slot) / first(px ORDER BY slot)) END AS pre_j
FROM spre0 GROUP BY session, root_code""")
cte("ssig", """
SELECT b.*, p.pre_rv AS "pre_PR_rv", p.pre_rn AS "pre_PR_rsv_neg", p.pre_aj, p.pre_j, abs("PR_signed_jump") AS "PR_abs_jump",
  asinh("PR_rv") AS "asinh_PR_rv", asinh(rn) AS "asinh_PR_rsv_neg", shock_target / 10 AS shock_target_10bp,
  abs(shock_target / 10) AS abs_target_10bp, greatest(coalesce(shock_target / 10, 0), 0) AS shock_pos_10bp,
  greatest(coalesce(-shock_target / 10, 0), 0) AS shock_neg_mag_10bp,
  shock_target / 10 * (root_code = 'gg')::INT AS shock_target_x_gg
FROM sbase b LEFT JOIN spre p USING (session, root_code)""")
twin("signal_panel", "event_date:s root_code:s pre_PR_rv:f pre_PR_rsv_neg:f PR_abs_jump:f asinh_PR_rv:f shock_target_10bp:f "
     "abs_target_10bp:f shock_pos_10bp:f shock_neg_mag_10bp:f shock_target_x_gg:f", "ssig")
cte("sst0", """
SELECT event_date, max(shock_target_10bp) AS x, avg(asinh("pre_PR_rv")) AS u, avg(asinh("pre_PR_rsv_neg")) AS v,
  avg(pre_aj) AS w, CASE WHEN event_date < DATE '1997-01-01' THEN 1 WHEN event_date < DATE '2000-01-01' THEN 2 ELSE 3 END AS g
FROM ssig GROUP BY event_date""")
cte("sst1", """
SELECT *, lag(x) OVER d AS l1, lag(x, 2) OVER d AS l2, avg(x) OVER p AS m3, avg(abs(x)) OVER p AS a3,
  CASE WHEN row_number() OVER d > 1 THEN coalesce(sum(abs(x)) OVER p, 0) END AS c3, lag(u) OVER d AS lu, lag(v) OVER d AS lv,
  CASE WHEN row_number() OVER (PARTITION BY g ORDER BY event_date) > 1 THEN coalesce(sum(x) OVER (PARTITION BY g
    ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS cg
FROM sst0 WINDOW d AS (ORDER BY event_date), p AS (ORDER BY event_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
cte("sst", """
SELECT event_date, x AS shock_target_10bp, u AS state_pre_rv, v AS state_pre_rsvneg, w AS state_pre_absjump,
  l1 AS lag1_target_10bp, l2 AS lag2_target_10bp, m3 AS ma3_target_10bp, a3 AS ma3_abs_target_10bp, c3 AS cumabs_target_10bp,
  lu AS lag1_pre_rv_state, lv AS lag1_pre_rsvneg_state, cg AS cum_target_within_regime_10bp,
  (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS shock_target_10bp_z, (u - avg(u) OVER ()) / stddev_samp(u) OVER () AS state_pre_rv_z,
  (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS state_pre_rsvneg_z,
  (m3 - avg(m3) OVER ()) / stddev_samp(m3) OVER () AS ma3_target_10bp_z, (g = 1)::INT::DOUBLE AS regime_preapp,
  (g = 2)::INT::DOUBLE AS regime_app, (g = 3)::INT::DOUBLE AS regime_hike FROM sst1""")
twin("event_state_vector", "event_date:s shock_target_10bp:f state_pre_rv:f state_pre_rsvneg:f state_pre_absjump:f lag1_target_10bp:f "
     "lag2_target_10bp:f ma3_target_10bp:f ma3_abs_target_10bp:f cumabs_target_10bp:f lag1_pre_rv_state:f lag1_pre_rsvneg_state:f "
     "cum_target_within_regime_10bp:f shock_target_10bp_z:f state_pre_rv_z:f ma3_target_10bp_z:f regime_preapp:f regime_app:f "
     "regime_hike:f", "sst")
cte("slong", """
SELECT p.event_date, p.root_code, p.shock_target_10bp * s.regime_hike AS target_x_hike,
  p.shock_target_10bp * s.state_pre_rv_z AS "target_x_preRV", p.shock_target_10bp * s.ma3_target_10bp_z AS target_x_memory,
  p.shock_target_10bp * s.state_pre_rsvneg_z AS "target_x_preRSVneg" FROM ssig p JOIN sst s USING (event_date)""")
twin("long_state_panel", "event_date:s root_code:s target_x_hike:f target_x_preRV:f target_x_memory:f target_x_preRSVneg:f", "slong")

# One-regressor models in closed form; every cluster is one row there.
cte("sols0", """
SELECT m.model_name, m.term, event_date, x, y FROM ssig, LATERAL (VALUES
  ('S02_jump_signed_fx', 'shock_target_10bp', 'fx', shock_target_10bp, "PR_signed_jump"),
  ('S03_jump_signed_gg', 'shock_target_10bp', 'gg', shock_target_10bp, "PR_signed_jump"),
  ('S06_asinh_rv_fx', 'abs_target_10bp', 'fx', abs_target_10bp, "asinh_PR_rv"),
  ('S07_asinh_rv_gg', 'abs_target_10bp', 'gg', abs_target_10bp, "asinh_PR_rv")) m(model_name, term, root, x, y)
WHERE m.root = root_code AND x IS NOT NULL AND y IS NOT NULL""")
cte("sols1", """
SELECT model_name, term, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS syy,
  count(*) * sum(x * x) - sum(x) * sum(x) AS det FROM sols0 GROUP BY ALL""")
cte("sols2", """
SELECT *, (n * sxy - sx * sy) / det AS b1, (sxx * sy - sx * sxy) / det AS b0 FROM sols1""")
cte("sols3", """
SELECT f.*, f.n / (f.n - 1) * (f.n - 1) / (f.n - 2) AS c, s.s0, s.s1, s.sse FROM sols2 f JOIN (
  SELECT r.model_name, sum(pow((sxx - sx * x) / det * (y - b0 - b1 * x), 2)) AS s0,
    sum(pow((n * x - sx) / det * (y - b0 - b1 * x), 2)) AS s1, sum(pow(y - b0 - b1 * x, 2)) AS sse
  FROM sols0 r JOIN sols2 USING (model_name) GROUP BY r.model_name) s USING (model_name)""")
cte("sols", """
SELECT model_name, 'Intercept' AS term, b0 AS beta, sqrt(c * s0) AS se, b0 / sqrt(c * s0) AS t_stat, n AS n_obs, n AS n_clusters,
  1 - sse / (syy - sy * sy / n) AS r2 FROM sols3
UNION ALL SELECT model_name, term, b1, sqrt(c * s1), b1 / sqrt(c * s1), n, n, 1 - sse / (syy - sy * sy / n) FROM sols3""")
twin("cluster_ols_simple", "model_name:s term:s beta:f se:f t_stat:f n_obs:i n_clusters:i r2:f", "sols")
# Wild draws by their definition on the rows: with the null imposed, the fit is the mean.
cte("swild0", """
SELECT model_name, event_date, x - avg(x) OVER m AS dx, y - avg(y) OVER m AS u, count(*) OVER m AS n
FROM sols0 WINDOW m AS (PARTITION BY model_name)""")
cte("swild1", """
SELECT *, CASE WHEN d = 0 OR md5('20260717|' || d || '|' || event_date) < '8' THEN u ELSE -u END AS su FROM swild0, range(1000) r(d)""")
cte("swild2", """
SELECT *, sum(dx * su) OVER w / sum(dx * dx) OVER w AS b, avg(su) OVER w AS m, sum(dx * dx) OVER w AS xx
FROM swild1 WINDOW w AS (PARTITION BY model_name, d)""")
cte("swild3", """
SELECT model_name, d, any_value(b) / sqrt(any_value(n) / (any_value(n) - 1.0) * (any_value(n) - 1.0) / (any_value(n) - 2.0)
  * sum(pow(dx * (su - m - b * dx) / xx, 2))) AS t FROM swild2 GROUP BY model_name, d""")
cte("swild", """
SELECT a.model_name, o.t AS t_observed, (1 + count(*) FILTER (WHERE abs(a.t) >= abs(o.t))) / (1.0 + count(*)) AS p_wild_cluster, count(*) AS n_usable
FROM swild3 a JOIN swild3 o ON o.model_name = a.model_name AND o.d = 0 WHERE a.d > 0 GROUP BY a.model_name, o.t""")
twin("wild_cluster_simple", "model_name:s t_observed:f p_wild_cluster:f n_usable:i", "swild")
cte("sper0", """
SELECT root_code, "asinh_PR_rv" - avg("asinh_PR_rv") OVER (PARTITION BY root_code) AS x, count(*) OVER (PARTITION BY root_code) AS n,
  row_number() OVER (PARTITION BY root_code ORDER BY event_date) - 1 AS k FROM ssig WHERE "asinh_PR_rv" IS NOT NULL""")
cte("sper", """
SELECT root_code, j, n, 2 * pi() * j / n AS frequency,
  (pow(sum(x * cos(2 * pi() * j * k / n)), 2) + pow(sum(x * sin(2 * pi() * j * k / n)), 2)) / (2 * pi() * n) AS power
FROM sper0, unnest(range(1, least(greatest(floor(pow(n, 0.7)), 5), (n - 1) // 2)::BIGINT + 1)) AS u(j)
GROUP BY root_code, j, n""")
twin("periodogram", "root_code:s j:i n:i frequency:f power:f", "sper")

# ---- counterfactual -----------------------------------------------------------------------------

cte("sknown", """
SELECT root_code, trade_date, avg(log_day_rv) OVER (PARTITION BY root_code ORDER BY trade_date
  ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS slow5_log_rv FROM sw WHERE log_day_rv IS NOT NULL""")
cte("sslow", """
SELECT w.*, k.slow5_log_rv FROM sw w ASOF LEFT JOIN sknown k ON k.root_code = w.root_code AND w.trade_date > k.trade_date""")
twin("slow_state", "trade_date:s root_code:s slow5_log_rv:f", "sslow")
cte("sctl", """
SELECT root_code, avg("log_BV_pre") AS pre_state_control_mean, stddev_samp("log_BV_pre") AS pre_state_control_sd
FROM sw WHERE NOT is_event AND window_eligible GROUP BY root_code""")
cte("spz", """
SELECT s.*, c.* EXCLUDE (root_code), (s."log_BV_pre" - pre_state_control_mean) / pre_state_control_sd AS pre_state_z
FROM sslow s JOIN sctl c USING (root_code)""")
twin("control_zscore", "trade_date:s root_code:s pre_state_z:f pre_state_control_mean:f pre_state_control_sd:f", "spz")
cte("sp", """
SELECT p.*, p.is_event AND t.event_date IS NOT NULL AS is_event_with_state, t.shock_target_10bp,
  t.shock_target_10bp * t.shock_target_10bp AS q_target, t.shock_target_10bp * t.shock_target_10bp * p.pre_state_z AS q_target_x_pre
FROM spz p LEFT JOIN sst t ON t.event_date = p.trade_date AND p.is_event""")
twin("shock_energy", "trade_date:s root_code:s is_event_with_state:b shock_target_10bp:f q_target:f q_target_x_pre:f", "sp")
cte("slyo0", """
SELECT root_code, year_number, sum("log_BV_post") AS s, count(*) AS n FROM sw
WHERE NOT is_event AND window_eligible AND "log_BV_post" IS NOT NULL GROUP BY root_code, year_number""")
cte("slyo", """
SELECT root_code, year_number, n AS n_year, (sum(s) OVER r - s) / (sum(n) OVER r - n) AS mean_other_years FROM slyo0
WINDOW r AS (PARTITION BY root_code)""")
twin("leave_year_out_mean", "root_code:s year_number:i n_year:i mean_other_years:f", "slyo")

cte("smr0", """
SELECT p.trade_date, p.root_code, p.clock_late, p.weekday_number, p.is_event, p.window_eligible, o.outcome, o.y, p.pre_state_z,
  p.slow5_log_rv / d.sd AS sl, date_diff('day', DATE '1970-01-01', p.trade_date) AS day
FROM sp p JOIN (SELECT root_code, stddev_samp(slow5_log_rv) AS sd FROM sp WHERE NOT is_event AND window_eligible GROUP BY root_code) d
  USING (root_code), LATERAL (VALUES ('log_BV_post', "log_BV_post", "log_BV_pre"), ('log_RV_post', "log_RV_post", "log_RV_pre"),
  ('jump_share_post', jump_share_post, jump_share_pre)) o(outcome, y, pre)
WHERE o.y IS NOT NULL AND o.pre IS NOT NULL AND p.slow5_log_rv IS NOT NULL AND p.pre_state_z IS NOT NULL""")
cte("smr1", """
SELECT e.trade_date, e.root_code, e.outcome, e.y, c.y AS cy, c.trade_date AS cd, abs(e.pre_state_z - c.pre_state_z) AS g1,
  abs(e.sl - c.sl) AS g2, abs(e.day - c.day) / 365.25 AS g3,
  count(*) FILTER (abs(e.day - c.day) / 365.25 <= 2) OVER (PARTITION BY e.trade_date, e.root_code, e.outcome) AS near,
  count(*) OVER (PARTITION BY e.trade_date, e.root_code, e.outcome) AS wide
FROM smr0 e JOIN smr0 c ON e.is_event AND NOT c.is_event AND c.window_eligible AND c.root_code = e.root_code
  AND c.outcome = e.outcome AND c.clock_late = e.clock_late AND c.weekday_number = e.weekday_number""")
cte("smr2", """
SELECT *, row_number() OVER (PARTITION BY trade_date, root_code, outcome ORDER BY g1 * g1 + g2 * g2 + (g3 / 2) * (g3 / 2), cd) AS k
FROM smr1 WHERE (near < 10 OR g3 <= 2) AND wide >= 2""")
cte("smr", """
SELECT trade_date, root_code, outcome, y AS observed_post, avg(cy) AS matched_control_mean, y - avg(cy) AS matched_abnormal,
  count(*) AS n_matches, avg(g1) AS mean_abs_state_gap, avg(g2) AS mean_abs_slow_gap_z, max(g3) AS max_calendar_gap_years
FROM smr2 WHERE k <= 10 GROUP BY trade_date, root_code, outcome, y""")
twin("matched_root_days", "trade_date:s root_code:s outcome:s observed_post:f matched_control_mean:f matched_abnormal:f n_matches:i "
     "mean_abs_state_gap:f mean_abs_slow_gap_z:f max_calendar_gap_years:f", "smr")

cte("ssup0", """
SELECT trade_date, max(shock_target_10bp) AS shock_target_10bp, max(q_target) AS q_target, max(regime_hike) AS regime_hike,
  avg(pre_state_z) AS mean_pre_state_z, max(pre_state_z) FILTER (root_code = 'fx') AS fx_pre_state_z,
  max(pre_state_z) FILTER (root_code = 'gg') AS gg_pre_state_z, count(*) AS n_roots
FROM sp WHERE is_event AND q_target IS NOT NULL GROUP BY trade_date""")
cte("ssup", """
SELECT *, row_number() OVER o AS energy_rank, q_target / sum(q_target) OVER () AS q_share,
  sum(q_target) OVER (ORDER BY q_target DESC, trade_date ROWS UNBOUNDED PRECEDING) / sum(q_target) OVER () AS q_cumulative_share,
  q_target * q_target / sum(q_target * q_target) OVER () AS q_squared_share,
  sum(q_target * q_target) OVER (ORDER BY q_target DESC, trade_date ROWS UNBOUNDED PRECEDING)
    / sum(q_target * q_target) OVER () AS q_squared_cumulative_share
FROM ssup0 WINDOW o AS (ORDER BY q_target DESC, trade_date)""")
twin("support_by_event", "trade_date:s shock_target_10bp:f q_target:f regime_hike:f mean_pre_state_z:f fx_pre_state_z:f gg_pre_state_z:f "
     "n_roots:i energy_rank:i q_share:f q_cumulative_share:f q_squared_share:f q_squared_cumulative_share:f", "ssup")


def midpoint(values: str, p: float) -> str:
    """Quantile between the points (i - 0.5) / n of a sorted list."""
    pos = f"least(greatest(len({values}) * {p} + 0.5, 1), len({values}))"
    low, high = f"{values}[floor({pos})::BIGINT]", f"{values}[ceil({pos})::BIGINT]"
    return f"({low} + ({pos} - floor({pos})) * ({high} - {low}))"


cte("ssups", f"""
SELECT count(*) AS n_event_dates, avg((q_target = 0)::INT) AS share_zero_q, median(q_target) AS q_median,
  max(q_target) AS q_max, max(q_target) / median(q_target) FILTER (q_target > 0) AS q_max_to_positive_median,
  sum(q_share) FILTER (energy_rank <= 1) AS top1_share_q, sum(q_share) FILTER (energy_rank <= 2) AS top2_share_q,
  sum(q_share) FILTER (energy_rank <= 3) AS top3_share_q, sum(q_squared_share) FILTER (energy_rank <= 1) AS top1_share_q_squared,
  sum(q_squared_share) FILTER (energy_rank <= 2) AS top2_share_q_squared,
  sum(q_squared_share) FILTER (energy_rank <= 3) AS top3_share_q_squared, list_sort(list(q_target)) AS qs FROM ssup""")
cte("ssupsum", f"SELECT *, {midpoint('qs', 0.95)} AS q_p95 FROM ssups")
twin("support_summary", "n_event_dates:i share_zero_q:f q_median:f q_max:f q_max_to_positive_median:f top1_share_q:f top2_share_q:f "
     "top3_share_q:f top1_share_q_squared:f top2_share_q_squared:f top3_share_q_squared:f q_p95:f", "ssupsum")

# ---- rotation -----------------------------------------------------------------------------------

cte("sday", """
SELECT f.session, f.trade_date, f.is_event, f.clock_late, f.weekday_number, f.year_number, f.q_target, f.slow5_log_rv AS slow_fx,
  g.slow5_log_rv AS slow_gg, f.file_name_clean AS ff, g.file_name_clean AS fg
FROM sp f JOIN sp g ON g.session = f.session AND f.root_code = 'fx' AND g.root_code = 'gg'
WHERE f.window_eligible AND g.window_eligible""")
cte("spair", """
SELECT d.session, d.is_event, a.slot, a.r AS x, b.r AS y, a.slot <= 4 AS pre FROM sday d
JOIN sbl a ON a.session = d.session AND a.file_name_clean = d.ff
JOIN sbl b ON b.session = d.session AND b.file_name_clean = d.fg AND b.slot = a.slot
WHERE a.r IS NOT NULL AND b.r IS NOT NULL AND a.slot BETWEEN 1 AND 8""")
cte("scnt", """
SELECT session, count(*) FILTER (pre) AS n_pre_pairs, count(*) FILTER (NOT pre) AS n_post_pairs FROM spair GROUP BY session
HAVING count(*) FILTER (pre) >= 3 AND count(*) FILTER (NOT pre) >= 3""")
cte("sscale", """
SELECT sqrt(avg(x * x)) AS sx, sqrt(avg(y * y)) AS sy FROM spair JOIN scnt USING (session) WHERE NOT is_event""")
cte("smat0", """
SELECT d.*, c.n_pre_pairs, c.n_post_pairs, m.* EXCLUDE (session) FROM sday d JOIN scnt c USING (session) JOIN (
  SELECT session, avg(x * x / (sx * sx)) FILTER (pre) AS qpre_11, avg(x * y / (sx * sy)) FILTER (pre) AS qpre_12,
    avg(y * y / (sy * sy)) FILTER (pre) AS qpre_22, avg(x * x / (sx * sx)) FILTER (NOT pre) AS qpost_11,
    avg(x * y / (sx * sy)) FILTER (NOT pre) AS qpost_12, avg(y * y / (sy * sy)) FILTER (NOT pre) AS qpost_22
  FROM spair, sscale GROUP BY session) m USING (session)""")
cte("smat", """
SELECT *, qpost_11 - qpre_11 AS d_11, qpost_12 - qpre_12 AS d_12, qpost_22 - qpre_22 AS d_22, ln(qpre_11) AS feature_log_fx_pre,
  ln(qpre_22) AS feature_log_gg_pre, atanh(least(greatest(qpre_12 / sqrt(qpre_11 * qpre_22), -0.999), 0.999)) AS feature_pre_corr
FROM smat0""")
twin("second_moment_matrices", "trade_date:s is_event:b n_pre_pairs:i n_post_pairs:i qpre_11:f qpre_12:f qpre_22:f qpost_11:f qpost_12:f "
     "qpost_22:f d_11:f d_12:f d_22:f feature_log_fx_pre:f feature_log_gg_pre:f feature_pre_corr:f", "smat")

FEATURES = ("feature_log_fx_pre", "feature_log_gg_pre", "feature_pre_corr", "slow_fx", "slow_gg")
cte("sz", "SELECT *, " + ", ".join(
    f"coalesce(({f} - avg({f}) FILTER (NOT is_event) OVER ()) / stddev_samp({f}) FILTER (NOT is_event) OVER (), 0) AS z{i}"
    for i, f in enumerate(FEATURES)) + " FROM smat")
GAPS = " + ".join(f"(e.z{i} - c.z{i}) * (e.z{i} - c.z{i})" for i in range(5))
DISTANCE = f"{GAPS} + 0.2 * ((e.year_number - c.year_number) / 5.0) * ((e.year_number - c.year_number) / 5.0)"
cte("sk0", f"""
SELECT e.trade_date AS event_key, c.trade_date AS control_key, {DISTANCE} AS distance, e.year_number AS ey, c.year_number AS cy,
  c.weekday_number = e.weekday_number AS w, abs(c.year_number - e.year_number) <= 2 AS y
FROM sz e JOIN sz c ON e.is_event AND NOT c.is_event AND c.clock_late = e.clock_late""")
cte("sk1", """
SELECT *, CASE WHEN count(*) FILTER (w AND y) OVER e >= 10 THEN 1 WHEN count(*) FILTER (y) OVER e >= 10 THEN 2
  WHEN count(*) FILTER (w) OVER e >= 10 THEN 3 ELSE 4 END AS tier FROM sk0 WINDOW e AS (PARTITION BY event_key)""")
cte("sk2", """
SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY distance, control_key) AS match_rank,
  CASE tier WHEN 1 THEN 'clock_weekday_two_year' WHEN 2 THEN 'clock_two_year' WHEN 3 THEN 'clock_weekday_all_years'
    ELSE 'clock_all_years' END AS match_rule
FROM sk1 WHERE (tier = 1 AND w AND y) OR (tier = 2 AND y) OR (tier = 3 AND w) OR tier = 4""")
cte("sk", "SELECT * FROM sk2 WHERE match_rank <= 10")
twin("knn_matching_ladder", "event_key:s control_key:s match_rank:i distance:f match_rule:s", "sk")
cte("sab", """
SELECT k.event_key AS trade_date, count(*) AS n_matches, max(match_rule) AS match_rule,
  string_agg(control_key::VARCHAR, '|' ORDER BY match_rank) AS match_dates, avg(distance) AS mean_match_distance,
  avg(abs(cy - ey)) AS mean_match_year_gap, max(e.d_11) AS event_d11, avg(c.d_11) AS control_d11,
  max(e.d_11) - avg(c.d_11) AS abnormal_11, max(e.d_12) - avg(c.d_12) AS abnormal_12, max(e.d_22) - avg(c.d_22) AS abnormal_22
FROM sk k JOIN smat e ON e.trade_date = k.event_key JOIN smat c ON c.trade_date = k.control_key GROUP BY k.event_key""")
cte("sabn", "SELECT *, abnormal_22 - abnormal_11 AS rotation_gg_minus_fx FROM sab")
twin("abnormal_matrices", "trade_date:s n_matches:i match_rule:s match_dates:s mean_match_distance:f mean_match_year_gap:f event_d11:f "
     "control_d11:f abnormal_11:f abnormal_12:f abnormal_22:f rotation_gg_minus_fx:f", "sabn")
cte("sobs", """
SELECT count(*) AS n, avg(abnormal_11) AS a, avg(abnormal_12) AS b, avg(abnormal_22) AS c FROM sabn""")
cte("seig", """
SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS lp, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS lm FROM sobs""")
# The eigenvector of value l is (b, l - a) up to scale.
cte("svec", """
SELECT *, b / sqrt(b * b + (lp - a) * (lp - a)) * sign(lp - a) AS px, abs(lp - a) / sqrt(b * b + (lp - a) * (lp - a)) AS py,
  abs(b) / sqrt(b * b + (lm - a) * (lm - a)) AS mx, (lm - a) / sqrt(b * b + (lm - a) * (lm - a)) * sign(b) AS my FROM seig""")
cte("sspec", """
SELECT m.metric, m.value FROM svec, sscale, LATERAL (VALUES ('n_events', n::DOUBLE), ('control_scale_fx', sx), ('control_scale_gg', sy),
  ('A_fx_fx', a), ('A_fx_gg', b), ('A_gg_gg', c), ('trace_A', a + c), ('determinant_A', a * c - b * b), ('lambda_plus', lp),
  ('lambda_minus', lm), ('vplus_fx', px), ('vplus_gg', py), ('vminus_fx', mx), ('vminus_gg', my),
  ('mean_rotation_gg_minus_fx', c - a)) m(metric, value)""")
twin("spectrum_summary", "metric:s value:f", "sspec")
cte("sloo0", """
SELECT trade_date AS excluded_trade_date, (sum(abnormal_11) OVER () - abnormal_11) / (count(*) OVER () - 1) AS "A_fx_fx",
  (sum(abnormal_12) OVER () - abnormal_12) / (count(*) OVER () - 1) AS "A_fx_gg",
  (sum(abnormal_22) OVER () - abnormal_22) / (count(*) OVER () - 1) AS "A_gg_gg" FROM sabn""")
cte("sloo", """
SELECT *, ("A_fx_fx" + "A_gg_gg") / 2 + sqrt(pow("A_fx_fx" - "A_gg_gg", 2) / 4 + pow("A_fx_gg", 2)) AS lambda_plus,
  ("A_fx_fx" + "A_gg_gg") / 2 - sqrt(pow("A_fx_fx" - "A_gg_gg", 2) / 4 + pow("A_fx_gg", 2)) AS lambda_minus,
  "A_gg_gg" - "A_fx_fx" AS rotation_gg_minus_fx FROM sloo0""")
twin("leave_one_out_spectrum", "excluded_trade_date:s A_fx_fx:f A_fx_gg:f A_gg_gg:f lambda_plus:f lambda_minus:f rotation_gg_minus_fx:f", "sloo")

# ---- resolution: common support and matching ----------------------------------------------------

cte("rs0", """
SELECT s.scenario, m.* FROM smat m, (VALUES ('full', 0, 0), ('exclude_2020', 1999, 0), ('exclude_2020_2021', 1999, 2000))
  s(scenario, y1, y2) WHERE m.year_number <> s.y1 AND m.year_number <> s.y2""")
cte("rs1", """
SELECT * REPLACE (coalesce(slow_fx, median(slow_fx) FILTER (NOT is_event) OVER s) AS slow_fx,
  coalesce(slow_gg, median(slow_gg) FILTER (NOT is_event) OVER s) AS slow_gg) FROM rs0 WINDOW s AS (PARTITION BY scenario)""")
cte("rs", "SELECT *, " + ", ".join(
    f"({f} - avg({f}) FILTER (NOT is_event) OVER s) / stddev_samp({f}) FILTER (NOT is_event) OVER s AS z{i}"
    for i, f in enumerate(FEATURES)) + " FROM rs1 WINDOW s AS (PARTITION BY scenario)")
cte("rpair", f"""
SELECT e.scenario, e.trade_date, e.is_event, c.trade_date AS cd, {DISTANCE} AS distance FROM rs e JOIN rs c
ON c.scenario = e.scenario AND NOT c.is_event AND c.trade_date <> e.trade_date AND c.clock_late = e.clock_late
  AND c.weekday_number = e.weekday_number AND abs(c.year_number - e.year_number) <= 2""")
cte("rrank", """
SELECT *, row_number() OVER (PARTITION BY scenario, trade_date ORDER BY distance, cd) AS k FROM rpair""")
cte("rcal0", """
SELECT scenario, list_sort(list(distance)) AS ds FROM rrank WHERE NOT is_event AND k = 10 GROUP BY scenario""")
cte("rcal", f"SELECT scenario, {midpoint('ds', 0.95)} AS caliper FROM rcal0")
cte("rbox0", "SELECT scenario, clock_late, " + ", ".join(f"list_sort(list(z{i})) AS l{i}" for i in range(5)) +
    " FROM rs WHERE NOT is_event GROUP BY scenario, clock_late")
cte("rin", "SELECT e.scenario, e.trade_date, " + " AND ".join(
    f"e.z{i} >= {midpoint(f'b.l{i}', 0.01)} AND e.z{i} <= {midpoint(f'b.l{i}', 0.99)}" for i in range(5)) +
    " AS inside FROM rs e JOIN rbox0 b USING (scenario, clock_late) WHERE e.is_event")
cte("rsup0", """
SELECT i.scenario, i.trade_date, i.inside, max(c.caliper) AS caliper,
  CASE WHEN i.inside THEN count(r.k) ELSE 0 END AS nc, CASE WHEN i.inside THEN count(*) FILTER (r.distance <= c.caliper) ELSE 0 END AS nw,
  min(r.distance) AS d1, min(r.distance) FILTER (r.k = 10) AS d10
FROM rin i JOIN rcal c USING (scenario) LEFT JOIN rrank r ON r.scenario = i.scenario AND r.trade_date = i.trade_date
GROUP BY i.scenario, i.trade_date, i.inside""")
cte("rsup", """
SELECT scenario, trade_date, inside AS inside_quantile_box, nc AS n_exact_candidates,
  CASE WHEN nc >= 10 THEN nw ELSE 0 END AS n_within_caliper, caliper AS distance_caliper,
  CASE WHEN nc >= 10 THEN d1 END AS nearest_distance, CASE WHEN nc >= 10 THEN d10 END AS tenth_distance,
  inside AND nc >= 10 AND nw >= 10 AS retained,
  CASE WHEN NOT inside THEN 'outside_quantile_box' WHEN nc < 10 THEN 'fewer_than_ten_exact_candidates'
    WHEN nw < 10 THEN 'distance_caliper' ELSE 'retained' END AS reason FROM rsup0""")
twin("common_support_matching", "scenario:s trade_date:s inside_quantile_box:b n_exact_candidates:i n_within_caliper:i distance_caliper:f "
     "nearest_distance:f tenth_distance:f retained:b reason:s", "rsup")

# ---- purified shocks: two regressors in closed form ---------------------------------------------

cte("spf0", """
SELECT event_date, shock_target_10bp AS y, regime_hike AS a, state_pre_rv_z AS b FROM sst
WHERE shock_target_10bp IS NOT NULL AND state_pre_rv_z IS NOT NULL""")
cte("spf1", """
SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, sum(a * a) - count(*) * avg(a) * avg(a) AS saa,
  sum(b * b) - count(*) * avg(b) * avg(b) AS sbb, sum(a * b) - count(*) * avg(a) * avg(b) AS sab,
  sum(a * y) - count(*) * avg(a) * avg(y) AS say, sum(b * y) - count(*) * avg(b) * avg(y) AS sby FROM spf0""")
cte("spf2", """
SELECT *, saa * sbb - sab * sab AS det, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba,
  (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb FROM spf1""")
cte("spf3", """
SELECT event_date, y, my + ba * (a - ma) + bb * (b - mb) AS fit,
  1 / n + (sbb * (a - ma) * (a - ma) - 2 * sab * (a - ma) * (b - mb) + saa * (b - mb) * (b - mb)) / det AS h FROM spf0, spf2""")
cte("spf", """
SELECT event_date, y AS shock_target_10bp, fit AS shock_pred_in, y - fit AS shock_resid_in, y - (y - fit) / (1 - h) AS shock_pred_loo,
  (y - fit) / (1 - h) AS shock_resid_loo FROM spf3""")
twin("shock_purification", "event_date:s shock_target_10bp:f shock_pred_in:f shock_resid_in:f shock_pred_loo:f shock_resid_loo:f", "spf")
cte("spfs", """
SELECT count(*) AS n_events, 1 - sum(shock_resid_in * shock_resid_in) / (var_samp(shock_target_10bp) * (count(*) - 1)) AS r2_in_sample,
  1 - sum(shock_resid_loo * shock_resid_loo) / (var_samp(shock_target_10bp) * (count(*) - 1)) AS r2_leave_one_out,
  avg(abs(shock_resid_loo)) AS mean_abs_resid_loo, stddev_samp(shock_resid_loo) AS sd_resid_loo FROM spf""")
twin("purification_summary", "n_events:i r2_in_sample:f r2_leave_one_out:f mean_abs_resid_loo:f sd_resid_loo:f", "spfs")
