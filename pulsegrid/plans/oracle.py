"""SQL twins of the registered queries, composed from shared common table expressions."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
SQL: dict[str, str] = {}

PLAIN = {
    "f": "round({0}::DOUBLE, 6) + 0.0",
    "i": "{0}::BIGINT",
    "s": "{0}::VARCHAR",
    "b": "{0}::BOOLEAN",
}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _needed(sql: str) -> list[str]:
    out: list[str] = []
    for name in re.findall(r"\b\w+\b", sql):
        if name in CTES and name not in out:
            for dep in _needed(CTES[name]):
                if dep not in out:
                    out.append(dep)
            if name not in out:
                out.append(name)
    return out


def with_ctes(sql: str) -> str:
    names = _needed(sql)
    if not names:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + sql


def twin(name: str, columns: str, source: str) -> None:
    """Columns are written ``name:kind`` with kinds f (double), i (long), s (text), b (boolean)."""
    picks = []
    for item in columns.split():
        col, kind = item.split(":")
        picks.append(f'{PLAIN[kind].format(col)} AS "{col}"')
    SQL[name] = with_ctes(f"SELECT {', '.join(picks)} FROM {source}")


# ---- hourly study -------------------------------------------------------------------------------

cte("hb", """
SELECT event_type AS file_name_clean,
  CASE WHEN event_type IN ('click', 'view') THEN 'fx' ELSE 'gg' END AS root_code,
  upper(substr(event_type, 1, 1)) AS expiry_code, 2024.0 AS contract_year, 60.0 AS bar_minutes,
  date_trunc('hour', ts) AS bt,
  first(value ORDER BY ts, event_id) AS po, max(value) AS ph, min(value) AS pl,
  last(value ORDER BY ts, event_id) AS px, count(*)::DOUBLE AS vol
FROM events GROUP BY event_type, date_trunc('hour', ts)""")

cte("hbl", """
SELECT *, bt::DATE AS trade_date,
  date_diff('minute', lag(bt) OVER d, bt)::DOUBLE AS gap, ln(px) - ln(lag(px) OVER d) AS r
FROM hb WINDOW d AS (PARTITION BY file_name_clean, bt::DATE ORDER BY bt)""")

cte("hq", """
SELECT file_name_clean, root_code, expiry_code, contract_year, bar_minutes, trade_date,
  count(*) AS n_bars, sum(vol) AS total_volume, median(vol) AS median_volume, avg(vol) AS mean_volume,
  min(vol) AS min_volume, max(vol) AS max_volume,
  count(*) FILTER (vol <= 1) AS n_low_volume, count(*) FILTER (vol <= 1) / count(*) AS share_low_volume,
  min(bt) AS first_bar_time, max(bt) AS last_bar_time,
  date_diff('minute', min(bt), max(bt)) AS span_minutes, count(gap) AS n_gaps,
  count(*) FILTER (gap = 60) AS n_expected_gaps,
  avg(CASE WHEN gap = 60 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END) AS pct_expected_gaps,
  max(gap) AS max_gap_minutes, median(gap) AS median_gap_minutes,
  count(*) FILTER (gap > 180) AS n_long_gaps, count(*) FILTER (gap > 720) AS n_very_long_gaps,
  sum(r * r) AS ret_var, sum(abs(r)) AS abs_return_sum
FROM hbl GROUP BY ALL""")

twin("contract_day_quality",
     "file_name_clean:s root_code:s expiry_code:s contract_year:f bar_minutes:f trade_date:s n_bars:i "
     "total_volume:f median_volume:f mean_volume:f min_volume:f max_volume:f n_low_volume:f "
     "share_low_volume:f first_bar_time:s last_bar_time:s span_minutes:f n_gaps:i n_expected_gaps:i "
     "pct_expected_gaps:f max_gap_minutes:f median_gap_minutes:f n_long_gaps:i n_very_long_gaps:i "
     "ret_var:f abs_return_sum:f", "hq")

cte("hfile", """
SELECT file_name_clean, root_code, expiry_code, contract_year, bar_minutes, count(*) AS n_days,
  avg(n_bars) AS avg_bars_per_day, avg(total_volume) AS avg_daily_volume,
  median(total_volume) AS median_daily_volume, avg(share_low_volume) AS avg_share_low_volume,
  avg(pct_expected_gaps) AS avg_pct_expected_gaps, avg(max_gap_minutes) AS avg_max_gap_minutes,
  avg(ret_var) AS avg_ret_var FROM hq GROUP BY ALL""")
twin("file_quality",
     "file_name_clean:s root_code:s expiry_code:s contract_year:f bar_minutes:f n_days:i "
     "avg_bars_per_day:f avg_daily_volume:f median_daily_volume:f avg_share_low_volume:f "
     "avg_pct_expected_gaps:f avg_max_gap_minutes:f avg_ret_var:f", "hfile")

cte("hroot", """
SELECT root_code, count(*) AS n_days, avg(n_bars) AS avg_bars, avg(total_volume) AS avg_volume,
  avg(share_low_volume) AS avg_share_low_volume, avg(pct_expected_gaps) AS avg_pct_expected_gaps
FROM hq GROUP BY root_code""")
twin("root_report", "root_code:s n_days:i avg_bars:f avg_volume:f avg_share_low_volume:f "
     "avg_pct_expected_gaps:f", "hroot")

cte("he", """
SELECT DISTINCT ts::DATE AS event_date FROM events WHERE date_diff('day', DATE '2024-01-01', ts::DATE) % 3 = 0""")
cte("hev", """
SELECT event_date, 'ECB_' || strftime(event_date, '%Y%m%d') AS event_id,
  event_date + INTERVAL 14 HOUR AS pr_datetime_local, event_date + INTERVAL 15 HOUR AS pc_datetime_local,
  event_date + INTERVAL 13 HOUR AS pr_datetime_utc, event_date + INTERVAL 14 HOUR AS pc_datetime_utc,
  60.0 AS pr_utc_offset_minutes, 60.0 AS pc_utc_offset_minutes FROM he""")
twin("event_calendar", "event_date:s event_id:s pr_datetime_local:s pc_datetime_local:s pr_datetime_utc:s "
     "pc_datetime_utc:s pr_utc_offset_minutes:f pc_utc_offset_minutes:f", "hev")

cte("hc0", """
SELECT q.*, e.event_date, e.event_id, pr_datetime_local, pc_datetime_local, pr_datetime_utc, pc_datetime_utc,
  coalesce(n_bars >= 18 AND total_volume >= 1 AND share_low_volume <= 0.8 AND pct_expected_gaps >= 0.4, false)
    AS prelim_eligible,
  ln(1 + total_volume) AS log_total_volume, 1 - share_low_volume AS one_minus_lowvol
FROM hq q JOIN hev e ON q.trade_date = e.event_date""")


def _minmax(col: str) -> str:
    return (f"CASE WHEN max({col}) OVER g = min({col}) OVER g THEN 1.0 "
            f"ELSE ({col} - min({col}) OVER g) / (max({col}) OVER g - min({col}) OVER g) END")


cte("hc1", f"""
SELECT *, 0.35 * ({_minmax('log_total_volume')}) + 0.20 * ({_minmax('n_bars')})
  + 0.25 * ({_minmax('one_minus_lowvol')}) + 0.20 * ({_minmax('pct_expected_gaps')}) AS selection_score
FROM hc0 WINDOW g AS (PARTITION BY event_date, root_code)""")
cte("hc", """
SELECT *, row_number() OVER (PARTITION BY event_date, root_code
  ORDER BY selection_score DESC NULLS LAST, file_name_clean) AS rank_within_root_day FROM hc1""")
twin("contract_selection", "event_date:s root_code:s file_name_clean:s prelim_eligible:b selection_score:f "
     "rank_within_root_day:i log_total_volume:f one_minus_lowvol:f", "hc")
cte("hp", """
SELECT * FROM hc QUALIFY row_number() OVER (PARTITION BY event_date, root_code
  ORDER BY prelim_eligible DESC, selection_score DESC NULLS FIRST, rank_within_root_day) = 1""")
twin("preferred_contract", "event_date:s root_code:s file_name_clean:s prelim_eligible:b selection_score:f", "hp")
twin("best_contracts", "event_date:s root_code:s file_name_clean:s selection_score:f",
     "(SELECT * FROM hp ORDER BY selection_score DESC, event_date, root_code LIMIT 10)")
cte("hcov", """
SELECT e.event_date, count(c.root_code) AS n_candidates_total,
  count(*) FILTER (c.root_code = 'fx') AS n_candidates_fx, count(*) FILTER (c.root_code = 'gg') AS n_candidates_gg,
  coalesce(bool_or(c.root_code = 'fx'), false) AS has_preferred_fx,
  coalesce(bool_or(c.root_code = 'gg'), false) AS has_preferred_gg,
  coalesce(bool_or(p.root_code = 'fx' AND p.prelim_eligible), false) AS pref_fx_eligible,
  coalesce(bool_or(p.root_code = 'gg' AND p.prelim_eligible), false) AS pref_gg_eligible
FROM hev e LEFT JOIN hc c ON c.event_date = e.event_date
LEFT JOIN hp p ON p.event_date = c.event_date AND p.root_code = c.root_code AND p.file_name_clean = c.file_name_clean
GROUP BY e.event_date""")
twin("event_coverage", "event_date:s n_candidates_total:i n_candidates_fx:i n_candidates_gg:i "
     "has_preferred_fx:b has_preferred_gg:b pref_fx_eligible:b pref_gg_eligible:b", "hcov")

# Cleaning is checked on the values behind the text lines.
cte("dl0", """
SELECT *, date_diff('hour', TIMESTAMP '2024-01-01', bt) AS h,
  8 * date_diff('hour', TIMESTAMP '2024-01-01', bt) + length(file_name_clean) AS n FROM hb""")
cte("dl1", """
SELECT file_name_clean AS file_name, h, n, copy, 2 * h + 2 + copy AS raw_line_no, n % 107 <> 0 AS parse_ok,
  CASE WHEN n % 109 = 0 THEN 'not a time' ELSE strftime(bt - INTERVAL 6 HOUR, '%Y-%m-%d %H:%M') END AS time_text,
  CASE WHEN n % 109 <> 0 THEN bt END AS bt,
  CASE WHEN n % 101 = 0 THEN 0.0 ELSE po END AS po,
  CASE WHEN n % 127 = 0 THEN greatest(CASE WHEN n % 103 = 0 THEN pl - 1 ELSE ph END, px * 10)
    WHEN n % 103 = 0 THEN pl - 1 ELSE ph END AS ph,
  pl, CASE WHEN n % 127 = 0 THEN px * 10 ELSE px END AS px,
  CASE WHEN n % 107 = 0 THEN NULL WHEN n % 97 = 0 THEN -vol ELSE vol END AS vol
FROM dl0, unnest(range(CASE WHEN n % 113 = 0 THEN 2 ELSE 1 END)) AS u(copy)""")
cte("dl", """
SELECT *, CASE WHEN NOT parse_ok THEN 'parse_failed' ELSE nullif(concat_ws(';',
  CASE WHEN bt IS NULL THEN 'bad_datetime' END,
  CASE WHEN po <= 0 OR ph <= 0 OR pl <= 0 OR px <= 0 THEN 'nonpositive_price' END,
  CASE WHEN vol < 0 THEN 'negative_volume' END,
  CASE WHEN NOT (ph >= po AND ph >= pl AND ph >= px AND pl <= po AND pl <= ph AND pl <= px)
    THEN 'ohlc_inconsistency' END), '') END AS core FROM dl1""")
cte("dk", """
SELECT *, CASE WHEN core IS NULL AND raw_line_no < max(raw_line_no) OVER (PARTITION BY file_name, bt, core)
  THEN 'duplicate_timestamp' ELSE core END AS r1 FROM dl""")
cte("dn", """
SELECT *, lag(px) OVER d AS p0, lead(px) OVER d AS p2, date_diff('minute', lag(bt) OVER d, bt) AS g0,
  date_diff('minute', bt, lead(bt) OVER d) AS g2
FROM dk WHERE r1 IS NULL WINDOW d AS (PARTITION BY file_name, bt::DATE ORDER BY bt)""")
cte("dc", """
SELECT file_name, raw_line_no, time_text, bt, po, ph, pl, px, vol,
  CASE WHEN g0 <= 720 AND g2 <= 720 AND greatest(px / ((p0 + p2) / 2), ((p0 + p2) / 2) / px) >= 5
    AND abs(ln(px) - ln(p0)) >= 1 AND abs(ln(p2) - ln(px)) >= 1
    AND sign(ln(px) - ln(p0)) <> sign(ln(p2) - ln(px)) THEN 'one_bar_price_spike' END AS reason FROM dn
UNION ALL
SELECT file_name, raw_line_no, time_text, bt, po, ph, pl, px, vol, r1 FROM dk WHERE r1 IS NOT NULL""")
cte("dlog", """
SELECT file_name, raw_line_no,
  CASE WHEN reason = 'parse_failed' THEN ''
    WHEN reason IS NULL OR reason IN ('duplicate_timestamp', 'one_bar_price_spike')
    THEN strftime(bt, '%Y-%m-%d %H:%M') ELSE time_text END AS time_ref,
  CASE WHEN reason IS NULL THEN 'flagged_only' ELSE 'dropped' END AS action,
  coalesce(reason, 'low_volume') AS reason FROM dc WHERE reason IS NOT NULL OR vol <= 1""")
twin("bar_cleaning_log", "file_name:s raw_line_no:i time_ref:s action:s reason:s", "dlog")
cte("dsum", """
SELECT file_name, count(*) AS n_raw_rows, count(*) FILTER (reason = 'parse_failed') AS n_parse_failed,
  count(*) FILTER (reason NOT IN ('parse_failed', 'duplicate_timestamp', 'one_bar_price_spike'))
    AS n_invalid_core_dropped,
  count(*) FILTER (reason = 'duplicate_timestamp') AS n_duplicate_ts_dropped,
  count(*) FILTER (reason = 'one_bar_price_spike') AS n_spike_rows_dropped,
  count(*) FILTER (reason IS NULL AND vol <= 1) AS n_lowvol_flagged,
  count(*) FILTER (reason IS NULL) AS n_clean_rows, length(file_name) > 4 AS footer_present,
  min(bt) FILTER (reason IS NULL) AS first_time_clean, max(bt) FILTER (reason IS NULL) AS last_time_clean
FROM dc GROUP BY file_name""")
twin("bar_cleaning_summary", "file_name:s n_raw_rows:i n_parse_failed:i n_invalid_core_dropped:i "
     "n_duplicate_ts_dropped:i n_spike_rows_dropped:i n_lowvol_flagged:i n_clean_rows:i footer_present:b "
     "first_time_clean:s last_time_clean:s", "dsum")
cte("dclean", """
SELECT file_name AS file_name_clean, bt AS "Time", po AS "Open", ph AS "High", pl AS "Low", px AS "Latest",
  vol AS "Volume" FROM dc WHERE reason IS NULL""")
twin("cleaned_bars", "file_name_clean:s Time:s Open:f High:f Low:f Latest:f Volume:f", "dclean")
cte("dstep", """
SELECT file_name, date_diff('minute', lag(bt) OVER (PARTITION BY file_name ORDER BY raw_line_no), bt) AS s
FROM dl WHERE bt IS NOT NULL""")
cte("daud0", """
SELECT file_name, true AS header_ok, length(file_name) > 4 AS footer_present, count(*) AS n_rows,
  min(bt) - INTERVAL 6 HOUR AS first_ts, max(bt) - INTERVAL 6 HOUR AS last_ts,
  count(bt) - count(DISTINCT bt) AS n_duplicates, count(*) FILTER (bt IS NULL) AS n_bad_dt,
  count(*) FILTER (NOT parse_ok) AS n_missing_core,
  count(*) FILTER (po <= 0 OR ph <= 0 OR pl <= 0 OR px <= 0) AS n_nonpositive_price,
  count(*) FILTER (vol < 0) AS n_negative_volume,
  bool_and(ph >= po AND ph >= pl AND ph >= px AND pl <= po AND pl <= ph AND pl <= px) AS ohlc_ok
FROM dl GROUP BY file_name""")
cte("dord", """
SELECT file_name, CASE WHEN count(s) = 0 THEN 'single' WHEN bool_and(s > 0) THEN 'strict_ascending'
  WHEN bool_and(s < 0) THEN 'strict_descending' WHEN bool_and(s >= 0) THEN 'ascending_with_duplicates'
  WHEN bool_and(s <= 0) THEN 'descending_with_duplicates' ELSE 'unsorted' END AS sort_order
FROM dstep GROUP BY file_name""")
cte("daud", """
SELECT *, 'review' AS status, concat_ws(';', 'filename_parse_failed',
  CASE WHEN NOT footer_present THEN 'footer_missing' END,
  CASE WHEN n_duplicates > 0 THEN 'duplicate_timestamps' END, CASE WHEN n_bad_dt > 0 THEN 'bad_datetime' END,
  CASE WHEN n_missing_core > 0 THEN 'missing_core_fields' END,
  CASE WHEN n_nonpositive_price > 0 THEN 'nonpositive_price' END,
  CASE WHEN n_negative_volume > 0 THEN 'negative_volume' END,
  CASE WHEN sort_order = 'unsorted' THEN 'timestamp_unsorted' END,
  CASE WHEN NOT ohlc_ok THEN 'ohlc_inconsistency' END) AS flags
FROM daud0 JOIN dord USING (file_name)""")
twin("file_audit", "file_name:s header_ok:b footer_present:b n_rows:i first_ts:s last_ts:s sort_order:s "
     "n_duplicates:i n_bad_dt:i n_missing_core:i n_nonpositive_price:i n_negative_volume:i ohlc_ok:b "
     "status:s flags:s", "daud")
cte("hgrid", """
SELECT r.root, x.expiry, y.year, count(f.file_name_clean) AS n_files,
  coalesce(string_agg(f.file_name_clean, ' | ' ORDER BY f.file_name_clean), '') AS file_name,
  CASE count(f.file_name_clean) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'duplicate' END AS coverage_status
FROM (VALUES ('fx'), ('gg')) r(root), (VALUES ('C'), ('E'), ('P'), ('V')) x(expiry), (VALUES (2023), (2024)) y(year)
LEFT JOIN (SELECT DISTINCT file_name_clean, root_code, expiry_code, contract_year FROM hb) f
  ON f.root_code = r.root AND f.expiry_code = x.expiry AND f.contract_year = y.year
GROUP BY r.root, x.expiry, y.year""")
twin("coverage_grid", "root:s expiry:s year:f n_files:i file_name:s coverage_status:s", "hgrid")

cte("hw", """
SELECT p.event_date, p.root_code, p.file_name_clean, w.window_name, w.wat AS event_time_utc,
  w.s AS window_start_utc, w.e AS window_end_utc, pr_datetime_utc, pc_datetime_utc
FROM hp p, LATERAL (VALUES
  ('PR', pr_datetime_utc, pr_datetime_utc - INTERVAL 180 MINUTE, pr_datetime_utc + INTERVAL 360 MINUTE),
  ('PC', pc_datetime_utc, pc_datetime_utc - INTERVAL 180 MINUTE, pc_datetime_utc + INTERVAL 900 MINUTE),
  ('ANN', pr_datetime_utc, pr_datetime_utc - INTERVAL 180 MINUTE, pc_datetime_utc + INTERVAL 900 MINUTE))
  w(window_name, wat, s, e) WHERE p.prelim_eligible""")
cte("hi", """
SELECT w.*, b.bt, b.px, b.vol, date_diff('minute', w.event_time_utc, b.bt) AS rel
FROM hw w JOIN hb b ON b.file_name_clean = w.file_name_clean AND b.bt BETWEEN window_start_utc AND window_end_utc""")
cte("hib", """SELECT *, bt AS "Time", px AS "Latest", vol AS "Volume", rel AS rel_event_minutes FROM hi""")
twin("event_window_bars", "event_date:s root_code:s file_name_clean:s window_name:s Time:s Latest:f Volume:f "
     "rel_event_minutes:f", "hib")
cte("hil", """
SELECT *, date_diff('minute', lag(bt) OVER d, bt)::DOUBLE AS gap, ln(px) - ln(lag(px) OVER d) AS r
FROM hi WINDOW d AS (PARTITION BY event_date, root_code, file_name_clean, window_name ORDER BY bt)""")
cte("him", """
SELECT event_date, root_code, file_name_clean, window_name, count(*) AS n, bool_or(bt = event_time_utc) AS ex,
  min(bt) AS f, max(bt) AS l, max(gap) AS mg, median(gap) AS dg, count(*) FILTER (gap > 180) AS lg,
  count(*) FILTER (vol <= 1) / count(*) AS sv, sum(r * r) AS rv,
  CASE WHEN count(*) > 1 THEN coalesce(sum(r * r) FILTER (r > 0), 0) END AS rp,
  CASE WHEN count(*) > 1 THEN coalesce(sum(r * r) FILTER (r < 0), 0) END AS rn, sum(abs(r)) AS ar,
  CASE WHEN count(*) > 1 THEN ln(last(px ORDER BY bt) / first(px ORDER BY bt)) END AS nr
FROM hil GROUP BY ALL""")
cte("hs0", """
SELECT w.*, coalesce(n, 0) AS n_obs_bars,
  date_diff('minute', window_start_utc, window_end_utc) // 60 + 1 AS n_expected_bars,
  coalesce(n, 0) / (date_diff('minute', window_start_utc, window_end_utc) // 60 + 1) AS pct_expected_bars,
  coalesce(ex, false) AS exact_event_bar_present, f AS first_bar_time, l AS last_bar_time,
  mg AS max_gap_minutes, dg AS median_gap_minutes, coalesce(lg, 0) AS n_long_gaps, sv AS share_low_volume,
  rv, rp AS rsv_pos, rn AS rsv_neg, ar AS abs_return_sum, nr AS net_log_return
FROM hw w LEFT JOIN him USING (event_date, root_code, file_name_clean, window_name)""")
cte("hs", """
SELECT *, pct_expected_bars >= 0.8 AND coalesce(share_low_volume <= 0.5, false)
  AND (max_gap_minutes IS NULL OR max_gap_minutes <= 180) AND exact_event_bar_present AS window_eligible FROM hs0""")
twin("event_window_summary", "event_date:s root_code:s file_name_clean:s window_name:s n_obs_bars:i "
     "n_expected_bars:i pct_expected_bars:f exact_event_bar_present:b first_bar_time:s last_bar_time:s "
     "max_gap_minutes:f median_gap_minutes:f n_long_gaps:i share_low_volume:f rv:f rsv_pos:f rsv_neg:f "
     "abs_return_sum:f net_log_return:f window_eligible:b", "hs")
cte("hwide", """
SELECT event_date, root_code, file_name_clean,
  max(rv) FILTER (window_name = 'PR') AS "PR_rv", max(rv) FILTER (window_name = 'PC') AS "PC_rv",
  max(rv) FILTER (window_name = 'ANN') AS "ANN_rv",
  max(n_obs_bars) FILTER (window_name = 'PR') AS "PR_n_obs_bars",
  max(n_obs_bars) FILTER (window_name = 'PC') AS "PC_n_obs_bars",
  max(n_obs_bars) FILTER (window_name = 'ANN') AS "ANN_n_obs_bars",
  max(net_log_return) FILTER (window_name = 'PR') AS "PR_net_log_return",
  max(abs_return_sum) FILTER (window_name = 'ANN') AS "ANN_abs_return_sum",
  bool_or(window_eligible) FILTER (window_name = 'PR') AS "PR_window_eligible",
  bool_or(window_eligible) FILTER (window_name = 'PC') AS "PC_window_eligible",
  bool_or(exact_event_bar_present) FILTER (window_name = 'ANN') AS "ANN_exact_event_bar_present",
  max(pr_datetime_utc) AS pr_datetime_utc, max(pc_datetime_utc) AS pc_datetime_utc
FROM hs GROUP BY event_date, root_code, file_name_clean""")
twin("event_window_panel", "event_date:s root_code:s file_name_clean:s PR_rv:f PC_rv:f ANN_rv:f PR_n_obs_bars:i "
     "PC_n_obs_bars:i ANN_n_obs_bars:i PR_net_log_return:f ANN_abs_return_sum:f PR_window_eligible:b "
     "PC_window_eligible:b ANN_exact_event_bar_present:b pr_datetime_utc:s pc_datetime_utc:s", "hwide")
cte("hwcov", """
SELECT window_name, count(*) AS n_windows, avg(pct_expected_bars) AS mean_pct_expected_bars,
  avg(exact_event_bar_present::INT) AS mean_exact_event_bar_present,
  avg(window_eligible::INT) AS mean_window_eligible, sum(pct_expected_bars) AS sum_pct_expected_bars,
  sum(exact_event_bar_present::INT) AS sum_exact_event_bar_present,
  sum(window_eligible::INT) AS sum_window_eligible FROM hs GROUP BY window_name""")
twin("window_coverage", "window_name:s n_windows:i mean_pct_expected_bars:f mean_exact_event_bar_present:f "
     "mean_window_eligible:f sum_pct_expected_bars:f sum_exact_event_bar_present:f sum_window_eligible:f", "hwcov")
twin("best_windows", "event_date:s root_code:s file_name_clean:s window_name:s pct_expected_bars:f "
     "share_low_volume:f",
     "(SELECT * FROM hs ORDER BY pct_expected_bars DESC, share_low_volume NULLS FIRST, event_date, root_code, "
     "window_name LIMIT 10)")
cte("hpl0", """
SELECT *, ln(px) - ln(lag(px) OVER (PARTITION BY event_date, root_code, file_name_clean ORDER BY bt)) AS r
FROM hi WHERE window_name = 'PR' AND rel BETWEEN -180 AND -60""")
cte("hpl", """
SELECT event_date, root_code, file_name_clean, count(*) AS n,
  CASE WHEN count(*) > 1 THEN ln(last(px ORDER BY bt) / first(px ORDER BY bt)) END AS j, sum(r * r) AS rv,
  CASE WHEN count(*) > 1 THEN coalesce(sum(r * r) FILTER (r < 0), 0) END AS rn FROM hpl0 GROUP BY ALL""")
cte("hplacebo", """
SELECT event_date, root_code, file_name_clean, n AS "pre_PR_n_bars", j AS "pre_PR_signed_jump",
  abs(j) AS "pre_PR_abs_jump", rv AS "pre_PR_rv", rn AS "pre_PR_rsv_neg", asinh(rv) AS "pre_asinh_PR_rv",
  asinh(rn) AS "pre_asinh_PR_rsvneg" FROM hpl""")
twin("placebo_panel", "event_date:s root_code:s file_name_clean:s pre_PR_n_bars:i pre_PR_signed_jump:f "
     "pre_PR_abs_jump:f pre_PR_rv:f pre_PR_rsv_neg:f pre_asinh_PR_rv:f pre_asinh_PR_rsvneg:f", "hplacebo")
cte("hau0", """
SELECT p.event_date, p.root_code, p.file_name_clean, a.alignment, a.off AS offset_from_corrected_minutes,
  pr_datetime_utc + to_minutes(a.off) AS evaluation_time_utc
FROM hp p, (VALUES ('corrected_minus_60m', -60), ('corrected_primary', 0), ('corrected_plus_60m', 60),
  ('legacy_naive_clock', 420)) a(alignment, off) WHERE p.prelim_eligible""")
cte("hau1", """
SELECT a.*, b.px IS NOT NULL AS exact_current_bar, l.px IS NOT NULL AS exact_lag_bar, b.vol AS volume,
  ln(b.px) - ln(l.px) AS log_return
FROM hau0 a LEFT JOIN hb b ON b.file_name_clean = a.file_name_clean AND b.bt = evaluation_time_utc
LEFT JOIN hb l ON l.file_name_clean = a.file_name_clean AND l.bt = evaluation_time_utc - INTERVAL 60 MINUTE""")
cte("hau", """SELECT *, exact_current_bar AND exact_lag_bar AS exact_return_pair, abs(log_return) AS abs_log_return
FROM hau1""")
twin("alignment_audit", "event_date:s root_code:s file_name_clean:s alignment:s offset_from_corrected_minutes:f "
     "evaluation_time_utc:s exact_current_bar:b exact_lag_bar:b exact_return_pair:b log_return:f "
     "abs_log_return:f volume:f", "hau")
cte("haus", """
SELECT alignment, count(*) AS n_rows, avg(exact_return_pair::INT) AS share_exact_return_pairs,
  median(abs_log_return) AS median_abs_log_return, avg(abs_log_return) AS mean_abs_log_return,
  median(volume) AS median_volume FROM hau GROUP BY alignment""")
twin("alignment_summary", "alignment:s n_rows:i share_exact_return_pairs:f median_abs_log_return:f "
     "mean_abs_log_return:f median_volume:f", "haus")
cte("hseq", """
SELECT *, row_number() OVER f AS pos, lag(px) OVER f AS prev, count(*) OVER (PARTITION BY file_name_clean) AS nf
FROM hb WINDOW f AS (PARTITION BY file_name_clean ORDER BY bt)""")
cte("hfirst", """
SELECT p.event_date, p.root_code, p.file_name_clean, p.pr_datetime_utc, p.n_bars % 7 + 3 AS n_bars_target,
  (SELECT count(*) FROM hb b WHERE b.file_name_clean = p.file_name_clean AND b.bt < p.pr_datetime_utc) + 1 AS first_pos,
  (SELECT count(*) FROM hb b WHERE b.file_name_clean = p.file_name_clean) AS nf FROM hp p""")
cte("hasof", """
SELECT f.*, s.pos - f.first_pos + 1 AS bar_index_in_pr, s.bt AS bar_time, s.px AS price_bar, s.prev AS prev_price_bar,
  ln(s.px) - ln(s.prev) AS r_bar
FROM hfirst f JOIN hseq s ON s.file_name_clean = f.file_name_clean AND s.pos >= f.first_pos
  AND s.pos < f.first_pos + f.n_bars_target WHERE f.first_pos > 1""")
twin("asof_bar_panel", "event_date:s root_code:s file_name_clean:s bar_index_in_pr:i bar_time:s price_bar:f "
     "prev_price_bar:f r_bar:f", "hasof")
cte("hasofs", """
SELECT f.event_date, f.root_code, f.file_name_clean, f.n_bars_target,
  CASE WHEN f.first_pos > f.nf THEN 'no_bar_at_or_after_pr' WHEN f.first_pos = 1 THEN 'no_previous_bar'
    WHEN f.nf - f.first_pos + 1 < f.n_bars_target THEN 'insufficient_bars_but_usable' ELSE 'ok' END AS status,
  count(a.r_bar) AS n_bars_extracted, sum(a.r_bar * a.r_bar) AS rv_from_bars, sum(a.r_bar) AS net_return_from_bars,
  min(a.bar_time) AS first_bar_time, max(a.bar_time) AS last_bar_time, count(a.r_bar) >= 5 AS bns_eligible
FROM hfirst f LEFT JOIN hasof a USING (event_date, root_code, file_name_clean) GROUP BY ALL""")
twin("asof_bar_status", "event_date:s root_code:s file_name_clean:s status:s n_bars_target:i n_bars_extracted:i "
     "rv_from_bars:f net_return_from_bars:f first_bar_time:s last_bar_time:s bns_eligible:b", "hasofs")
cte("hbp0", """
SELECT *, abs(r_bar) * abs(lag(r_bar) OVER (PARTITION BY event_date, root_code ORDER BY bar_time)) AS pp FROM hasof""")
cte("hbp", """
SELECT event_date, root_code, count(*) AS m, sum(r_bar) AS nr, sum(r_bar * r_bar) AS rv, pi() / 2 * sum(pp) AS bv,
  greatest(sum(r_bar * r_bar) - pi() / 2 * sum(pp), 0) AS jv FROM hbp0 GROUP BY event_date, root_code""")
cte("hbns", """
SELECT event_date, root_code, m AS "PR_n_obs_bars_BNS", nr AS "PR_net_log_return_BNS", rv AS "RV_PR_BNS",
  bv AS "BV_PR", jv AS "JV_PR", CASE WHEN rv > 0 THEN jv / rv END AS "jump_share_BNS",
  asinh(bv) AS "asinh_BV_PR", asinh(jv) AS "asinh_JV_PR" FROM hbp""")
twin("bipower_components", "event_date:s root_code:s PR_n_obs_bars_BNS:i PR_net_log_return_BNS:f RV_PR_BNS:f "
     "BV_PR:f JV_PR:f jump_share_BNS:f asinh_BV_PR:f asinh_JV_PR:f", "hbns")
cte("hfeas", """
SELECT count(*) AS n_groups, count(*) FILTER (m >= 5) AS n_groups_ok, median(m) AS median_bars, min(m) AS min_bars,
  max(m) AS max_bars, count(*) FILTER (m >= 5) / count(*) AS share_groups_ok,
  CASE WHEN count(*) FILTER (m >= 5) / count(*) < 0.8 THEN 'too_few_groups_with_enough_bars'
    WHEN median(m) < 5 THEN 'median_bar_count_too_small'
    WHEN count(bv) = 0 OR count(jv) = 0 THEN 'bns_components_not_computable' ELSE 'ok' END AS status FROM hbp""")
twin("bipower_feasibility", "n_groups:i n_groups_ok:i median_bars:f min_bars:i max_bars:i share_groups_ok:f "
     "status:s", "hfeas")

# ---- session study ------------------------------------------------------------------------------

cte("sb", """
SELECT l_linestatus || '_' || l_returnflag AS file_name_clean,
  CASE WHEN l_linestatus = 'O' THEN 'fx' ELSE 'gg' END AS root_code, l_shipdate::DATE AS bd,
  (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) // 10)::INT AS session,
  (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) % 10)::INT AS slot,
  last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS px,
  sum(l_quantity) AS vol FROM lineitem GROUP BY 1, 2, 3, 4, 5""")
cte("sbl", """
SELECT *, DATE '1995-01-01' + session * 10 AS trade_date,
  CASE WHEN lag(slot) OVER s = slot - 1 THEN ln(px) - ln(lag(px) OVER s) END AS r,
  ln(px) - ln(lag(px) OVER s) AS ra
FROM sb WINDOW s AS (PARTITION BY session, file_name_clean ORDER BY slot)""")
cte("sbp", """
SELECT *, CASE WHEN lag(slot) OVER s = slot - 1 THEN abs(r) * abs(lag(r) OVER s) END AS pp
FROM sbl WINDOW s AS (PARTITION BY session, file_name_clean ORDER BY slot)""")
cte("sm0", """
SELECT session, trade_date, root_code, file_name_clean,
  count(r) FILTER (slot BETWEEN 1 AND 4) AS n_pre_returns, count(r) FILTER (slot BETWEEN 5 AND 8) AS n_post_returns,
  sum(vol) FILTER (slot BETWEEN 0 AND 4) AS pre_volume,
  sum(r * r) FILTER (slot BETWEEN 1 AND 4) AS q1, sum(r * r) FILTER (slot BETWEEN 5 AND 8) AS q2,
  count(pp) FILTER (slot BETWEEN 2 AND 4) AS c1, count(pp) FILTER (slot BETWEEN 6 AND 8) AS c2,
  pi() / 2 * sum(pp) FILTER (slot BETWEEN 2 AND 4) AS b1, pi() / 2 * sum(pp) FILTER (slot BETWEEN 6 AND 8) AS b2,
  count(*) FILTER (slot <= 8) AS n_grid, sum(ra * ra) AS ret_var
FROM sbp GROUP BY ALL""")
cte("sm1", """
SELECT session, trade_date, root_code, file_name_clean, n_pre_returns, n_post_returns, pre_volume, n_grid, ret_var,
  n_pre_returns / 4 AS pre_coverage, n_post_returns / 4 AS post_coverage,
  CASE WHEN n_pre_returns >= 3 THEN q1 END AS "RV_pre", CASE WHEN n_post_returns >= 3 THEN q2 END AS "RV_post",
  CASE WHEN n_pre_returns >= 3 AND c1 >= 2 THEN b1 END AS "BV_pre",
  CASE WHEN n_post_returns >= 3 AND c2 >= 2 THEN b2 END AS "BV_post" FROM sm0""")
cte("sm", """
SELECT *, CASE WHEN BV_pre IS NOT NULL THEN greatest(RV_pre - BV_pre, 0) END AS "JV_pre",
  CASE WHEN BV_post IS NOT NULL THEN greatest(RV_post - BV_post, 0) END AS "JV_post",
  CASE WHEN BV_pre IS NOT NULL AND RV_pre > 0 THEN greatest(RV_pre - BV_pre, 0) / RV_pre END AS jump_share_pre,
  CASE WHEN BV_post IS NOT NULL AND RV_post > 0 THEN greatest(RV_post - BV_post, 0) / RV_post END AS jump_share_post
FROM sm1""")
twin("grid_returns_variation", "trade_date:s root_code:s file_name_clean:s n_pre_returns:i n_post_returns:i "
     "pre_volume:f pre_coverage:f post_coverage:f RV_pre:f BV_pre:f JV_pre:f jump_share_pre:f RV_post:f BV_post:f "
     "JV_post:f jump_share_post:f", "(SELECT * FROM sm WHERE n_grid > 0)")
cte("sc", """
SELECT *, session % 3 = 0 AS is_event,
  CASE WHEN session % 3 = 0 THEN 'EVENT_' ELSE 'CONTROL_' END || strftime(trade_date, '%Y%m%d') AS event_id,
  pre_coverage >= 0.75 AND n_pre_returns >= 3 AND BV_pre IS NOT NULL AS pre_eligible,
  post_coverage >= 0.75 AND n_post_returns >= 3 AND BV_post IS NOT NULL AS post_eligible FROM sm""")
cte("sw", """
SELECT *, pre_eligible AND post_eligible AS window_eligible,
  CASE WHEN NOT pre_eligible THEN 'no_pre_eligible_contract' WHEN NOT post_eligible THEN 'post_window_ineligible'
    ELSE 'ok' END AS selection_status,
  CASE WHEN RV_pre > 0 THEN ln(RV_pre) END AS "log_RV_pre", CASE WHEN BV_pre > 0 THEN ln(BV_pre) END AS "log_BV_pre",
  CASE WHEN RV_post > 0 THEN ln(RV_post) END AS "log_RV_post",
  CASE WHEN BV_post > 0 THEN ln(BV_post) END AS "log_BV_post",
  CASE WHEN ret_var > 0 THEN ln(ret_var) END AS log_day_rv, (root_code = 'gg')::INT::DOUBLE AS root_gg,
  session % 5 + 2 AS weekday_number, (trade_date >= DATE '1998-07-01')::INT::DOUBLE AS clock_late,
  (trade_date >= DATE '2000-01-01')::INT::DOUBLE AS regime_hike, year(trade_date) AS year_number,
  month(trade_date) AS month_number
FROM sc QUALIFY row_number() OVER (PARTITION BY session, root_code ORDER BY pre_eligible DESC, pre_coverage DESC,
  pre_volume DESC NULLS LAST, file_name_clean) = 1""")
twin("root_day_windows", "trade_date:s root_code:s file_name_clean:s is_event:b event_id:s selection_status:s "
     "window_eligible:b log_BV_pre:f log_BV_post:f log_RV_pre:f log_RV_post:f log_day_rv:f weekday_number:i "
     "clock_late:f year_number:i", "sw")
