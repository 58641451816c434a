"""SQL twins of the source queries: the values that the written files must give back."""

from __future__ import annotations

from pulsegrid.plans import oracle_models  # noqa: F401  (the panels read)
from pulsegrid.plans.oracle import cte, twin

cte("fname", """
SELECT DISTINCT file_name_clean, CASE WHEN file_name_clean IN ('click', 'view') THEN 'fx' ELSE 'gg' END AS root_code,
  substr('hmuz', ascii(file_name_clean) % 4 + 1, 1) AS expiry, length(file_name_clean) + 10 AS yy FROM hb""")
cte("ffile", """
SELECT file_name_clean, root_code, upper(expiry) AS expiry_code, 2000.0 + yy AS contract_year,
  root_code || expiry || yy || '_intraday-60min_historical-data-02-01-2024.csv' AS file_name FROM fname""")
cte("fheld", """
SELECT file_name_clean, count(*) AS n_bars, sum("Latest") AS sum_latest, sum("Volume") AS sum_volume, min("Time") AS first_bar FROM dclean GROUP BY file_name_clean""")
cte("fclean", """
SELECT f.file_name, true AS name_ok, f.root_code, f.expiry_code, f.contract_year, 60.0 AS bar_minutes, DATE '2024-02-01' AS download_date, s.n_raw_rows, s.n_clean_rows,
  s.footer_present, h.n_bars, round(h.sum_latest, 3) AS sum_latest, h.sum_volume, h.first_bar
FROM dsum s JOIN ffile f ON f.file_name_clean = s.file_name LEFT JOIN fheld h ON h.file_name_clean = s.file_name""")
twin("cleaned_files", "file_name:s name_ok:b root_code:s expiry_code:s contract_year:f bar_minutes:f download_date:s n_raw_rows:i n_clean_rows:i footer_present:b "
     "n_bars:i sum_latest:f sum_volume:f first_bar:s", "fclean")
cte("fclock", """
SELECT 'timezone_v1' AS schema_version, 'America/Chicago' AS raw_time_zone, 'Europe/Berlin' AS event_time_zone, 'UTC' AS analysis_time_zone, 'Time' AS cleaned_time_column,
  'timezone-neutral datetime displaying UTC' AS cleaned_time_semantics, 'complete' AS status, count(*) AS n_files, sum(n_clean_rows) AS n_clean_rows FROM dsum""")
twin("clock_manifest", "schema_version:s raw_time_zone:s event_time_zone:s analysis_time_zone:s cleaned_time_column:s cleaned_time_semantics:s status:s n_files:i n_clean_rows:i", "fclock")
cte("ftyped", " UNION ALL ".join(
    f"SELECT '{label}' AS panel, count(*) AS n_rows, count(DISTINCT {day}) AS n_days, min({day}) AS first_day, max({day}) AS last_day, {total} AS total FROM {rows}"
    for label, rows, day, total in (
        ("contract_day_quality", "hq", "trade_date", "sum(ret_var)"), ("event_calendar", "hev", "event_date", "NULL::DOUBLE"),
        ("event_state", "sst", "event_date", "sum(shock_target_10bp)"), ("preferred_contracts", "hp", "event_date", "NULL::DOUBLE"),
        ("counterfactual_windows", "sp", "trade_date", 'sum("log_BV_pre")'), ("date_matrices", "smat", "trade_date", "sum(d_11)"))))
twin("typed_panels", "panel:s n_rows:i n_days:i first_day:s last_day:s total:f", "ftyped")
cte("frange", """
SELECT q.* FROM hq q, (SELECT min(event_date) AS a, max(event_date) AS b FROM hev) e
WHERE q.trade_date >= a - 60 AND q.trade_date <= b AND dayofweek(q.trade_date) BETWEEN 1 AND 5""")
twin("study_range", "trade_date:s root_code:s file_name_clean:s ret_var:f total_volume:f n_bars:f", "frange")
# Summer time by its rule: from the last Sunday of March to the last Sunday of October.
cte("fdays0", """
SELECT DISTINCT (l_shipdate::DATE + INTERVAL 300 MONTH)::DATE AS trade_date FROM lineitem""")
cte("fevents", """
SELECT DISTINCT ((DATE '1995-01-01' + s * 10) + INTERVAL 300 MONTH)::DATE AS event_date
FROM (SELECT DISTINCT (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) // 10)::INT AS s FROM lineitem) q WHERE s % 3 = 0""")
cte("fdays1", """
SELECT d.trade_date, e.event_date IS NOT NULL AS is_event, CASE WHEN e.event_date IS NOT NULL THEN 'ECB_' ELSE 'CONTROL_' END || strftime(d.trade_date, '%Y%m%d') AS event_id,
  CASE WHEN e.event_date IS NOT NULL THEN 840 WHEN d.trade_date >= DATE '2022-07-21' THEN 855 ELSE 825 END AS minute,
  make_date(year(d.trade_date), 3, 31) AS m31, make_date(year(d.trade_date), 10, 31) AS o31 FROM fdays0 d LEFT JOIN fevents e ON e.event_date = d.trade_date""")
cte("fdays2", """
SELECT *, CASE WHEN trade_date >= m31 - dayofweek(m31)::INT AND trade_date < o31 - dayofweek(o31)::INT THEN 120 ELSE 60 END AS ahead FROM fdays1""")
cte("fdays", """
SELECT trade_date, is_event, event_id, trade_date + to_minutes(minute) AS pseudo_pr_datetime_local, trade_date + to_minutes(minute - ahead) AS pseudo_pr_datetime_utc,
  month(trade_date) AS month_number, year(trade_date) AS year_number, dayofweek(trade_date) + 1 AS weekday_number FROM fdays2""")
twin("release_clocks", "trade_date:s is_event:b event_id:s pseudo_pr_datetime_local:s pseudo_pr_datetime_utc:s month_number:i year_number:i weekday_number:i", "fdays")
cte("frec", """
SELECT a.*, w."PR_rv", w."PR_net_log_return", abs(a.rv_from_bars - w."PR_rv") AS absdiff_rv, abs(a.net_return_from_bars - w."PR_net_log_return") AS absdiff_net_return
FROM hasofs a LEFT JOIN hwide w USING (event_date, root_code, file_name_clean)""")
twin("bar_reconciliation", "event_date:s root_code:s file_name_clean:s status:s rv_from_bars:f net_return_from_bars:f PR_rv:f PR_net_log_return:f absdiff_rv:f "
     "absdiff_net_return:f", "frec")
