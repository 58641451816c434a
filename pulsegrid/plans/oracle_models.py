"""SQL twins of the regression queries: cross products, a sweep, clustered or leverage-adjusted errors and t tests, all in SQL.

A battery becomes a chain of common table expressions whose names begin with the battery's prefix: ``x`` rows, ``g`` cross
products, ``f`` fits (``s`` is the swept matrix, its leading block the inverse of X'X), ``e`` residuals, ``c`` scores and ``b``
coefficients. The t distribution with whole degrees of freedom is a finite sum, and its quantile a bisection.
"""

from __future__ import annotations

from pulsegrid.operators.counterfactual import MONTHS, NORMAL, VALIDATION, WEEKDAYS, conditional_effects, normal_terms
from pulsegrid.operators.functional import THRESHOLD_EFFECTS
from pulsegrid.operators.regression import Effect, Model, state_effects
from pulsegrid.plans import batteries
from pulsegrid.plans.oracle import cte, twin
from pulsegrid.plans.oracle_sessions import midpoint  # the panels the models read come with it

_PIVOT = "p[1][1]::BIGINT"


def swept(g: str, k: str) -> str:
    """The symmetric matrix g swept at its first k rows."""
    cell = (f"CASE WHEN i = {_PIVOT} AND j = {_PIVOT} THEN 1 / a[{_PIVOT}][{_PIVOT}] WHEN i = {_PIVOT} THEN a[i][j] / a[i][i] "
            f"WHEN j = {_PIVOT} THEN -a[i][j] / a[j][j] ELSE a[i][j] - a[i][{_PIVOT}] * a[{_PIVOT}][j] / a[{_PIVOT}][{_PIVOT}] END")
    step = f"list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) + 1), lambda j: {cell}))"
    return f"list_reduce(list_prepend({g}, list_transform(range(1, {k} + 1), lambda i: [[i::DOUBLE]])), lambda a, p: {step})"


def inside(t: str, df: str) -> str:
    """Probability that a t variable with ``df`` degrees of freedom is nearer to zero than t."""
    angle, share = f"atan(abs({t}) / sqrt({df}))", f"({df} / ({df} + ({t}) * ({t})))"
    even = f"sin({angle}) / sqrt(pi()) * list_sum(list_transform(range(0, {df} // 2), lambda i: exp(lgamma(i + 0.5) - lgamma(i + 1.0)) * pow({share}, i)))"
    odd = (f"2 / pi() * ({angle} + sin({angle}) * cos({angle}) * sqrt(pi()) / 2 * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), "
           f"lambda i: exp(lgamma(i + 1.0) - lgamma(i + 1.5)) * pow({share}, i))), 0))")
    return f"CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END"


def critical(df: str, level: float) -> str:
    """The t value with ``level`` inside, by bisection."""
    half = f"CASE WHEN ({inside('((a[1] + a[2]) / 2)', df)}) < {level} THEN [(a[1] + a[2]) / 2, a[2]] ELSE [a[1], (a[1] + a[2]) / 2] END"
    return f"list_reduce(list_prepend([0.0::DOUBLE, 200.0], list_transform(range(60), lambda q: [0.0::DOUBLE])), lambda a, q: {half})[1]"


def texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def fits(p: str, rows: str, models: list[tuple[str, str, tuple[str, ...]]]) -> None:
    """Fits of the rows (model_name, cluster, x, y); ``models`` are (name, outcome, terms with the intercept)."""
    cte(f"{p}x", rows)
    cte(f"{p}m", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{y}', {texts(t)})" for n, y, t in models) + ") v(model_name, outcome, terms)")
    cte(f"{p}g0", f"""
SELECT model_name, i, j, sum(z[i] * z[j]) AS v FROM (SELECT model_name, list_append(x, y) AS z FROM {p}x) r,
  unnest(range(1, len(z) + 1)) a(i), unnest(range(1, len(z) + 1)) b(j) GROUP BY model_name, i, j""")
    cte(f"{p}g", f"""
SELECT model_name, list(r ORDER BY i) AS g FROM (SELECT model_name, i, list(v ORDER BY j) AS r FROM {p}g0 GROUP BY model_name, i) q
GROUP BY model_name""")
    cte(f"{p}s", f"""
SELECT model_name, len(g) - 1 AS k, g[1][1]::BIGINT AS n, g[1][len(g)] AS sy, g[len(g)][len(g)] AS syy, {swept('g', 'len(g) - 1')} AS s FROM {p}g""")
    cte(f"{p}f", f"""
SELECT f.*, m.outcome, m.terms, list_transform(range(1, k + 1), lambda i: s[i][k + 1]) AS beta, s[k + 1][k + 1] AS sse, syy - sy * sy / n AS tss,
  1 - s[k + 1][k + 1] / (syy - sy * sy / n) AS r2, 1 - s[k + 1][k + 1] / (syy - sy * sy / n) * (n - 1) / greatest(n - k, 1) AS adj_r2
FROM {p}s f JOIN {p}m m USING (model_name)""")
    cte(f"{p}e", f"SELECT x.*, f.k, f.s, y - list_dot_product(x.x, f.beta) AS e FROM {p}x x JOIN {p}f f USING (model_name)")


def clustered(p: str) -> None:
    """Scores per cluster; t tests have clusters - 1 degrees of freedom."""
    cte(f"{p}c", f"""
SELECT model_name, cluster, list(v ORDER BY i) AS score FROM (
  SELECT model_name, cluster, i, sum(x[i] * e) AS v FROM {p}e, unnest(range(1, k + 1)) a(i) GROUP BY model_name, cluster, i) q GROUP BY model_name, cluster""")
    cte(f"{p}n", f"""
SELECT model_name, g AS n_clusters, g - 1 AS df, g / (g - 1.0) * (n - 1.0) / (n - k) AS scale
FROM {p}f JOIN (SELECT model_name, count(*) AS g FROM {p}c GROUP BY model_name) q USING (model_name)""")


def adjusted(p: str) -> None:
    """A score per row, its residual divided by one less its leverage; t tests have n - k degrees of freedom."""
    lever = "list_dot_product(x, list_transform(range(1, k + 1), lambda i: list_dot_product(s[i][1:k], x)))"
    cte(f"{p}c", f"SELECT model_name, cluster, list_transform(x, lambda v: v * e / greatest(1 - h, 1e-8)) AS score FROM (SELECT *, {lever} AS h FROM {p}e) q")
    cte(f"{p}n", f"SELECT model_name, n AS n_clusters, n - k AS df, 1.0 AS scale FROM {p}f")


def tests(p: str) -> None:
    cte(f"{p}t", f"SELECT df, {critical('df', 0.95)} AS crit, {critical('df', 0.90)} AS crit90 FROM (SELECT DISTINCT df FROM {p}n) q")
    cte(f"{p}b0", f"""
SELECT f.model_name, f.outcome, j, f.terms[j] AS term, f.beta[j] AS beta, n.n_clusters, n.df, f.n AS n_obs, f.r2, f.adj_r2,
  sqrt(n.scale * sum(pow(list_dot_product(c.score, f.s[j][1:f.k]), 2))) AS se
FROM {p}f f JOIN {p}c c USING (model_name) JOIN {p}n n USING (model_name), unnest(range(1, f.k + 1)) a(j)
GROUP BY f.model_name, f.outcome, j, f.terms[j], f.beta[j], n.n_clusters, n.df, n.scale, f.n, f.r2, f.adj_r2""")
    cte(f"{p}b", f"""
SELECT *, beta / se AS t_stat, 1 - ({inside('beta / se', 'df')}) AS p_value, beta - crit * se AS ci95_lo, beta + crit * se AS ci95_hi FROM {p}b0 JOIN {p}t USING (df)""")


COEFFICIENTS = "model_name:s outcome:s term:s beta:f se:f t_stat:f p_value:f ci95_lo:f ci95_hi:f n_obs:i n_clusters:i r2:f adj_r2:f"


def battery(p: str, panel: str, models: list[Model]) -> None:
    """A clustered battery over the columns of a panel."""
    rows = " UNION ALL ".join(
        f"SELECT '{m.name}' AS model_name, {m.cluster}::VARCHAR AS cluster, [1.0, {', '.join(m.terms)}]::DOUBLE[] AS x, {m.outcome}::DOUBLE AS y FROM {panel} "
        f"WHERE {' AND '.join([f'({m.where})'] * bool(m.where) + [f'{c} IS NOT NULL' for c in (m.outcome, *m.terms, m.cluster)])}" for m in models)
    fits(p, rows, [(m.name, m.outcome, ("Intercept", *m.terms)) for m in models])
    clustered(p)
    tests(p)


def effects(p: str, found: list[Effect]) -> None:
    """Linear combinations, for the models that have their terms."""
    rows = ", ".join(
        f"('{e.name}', {'NULL' if e.value is None else e.value}::DOUBLE, '{e.note}', {texts(t for t, _ in e.weights)}, {[float(w) for _, w in e.weights]}::DOUBLE[], {texts(e.models)}::VARCHAR[])"
        for e in found)
    cte(f"{p}l", f"SELECT * FROM (VALUES {rows}) v(effect_name, state_value, note, names, weights, only_for)")
    cte(f"{p}h0", f"""
SELECT f.model_name, f.outcome, l.effect_name, l.state_value, l.note, f.k, f.s, f.beta,
  list_transform(f.terms, lambda t: coalesce(l.weights[list_position(l.names, t)], 0.0)) AS load
FROM {p}f f JOIN {p}l l ON list_has_all(f.terms, l.names) AND (len(l.only_for) = 0 OR list_contains(l.only_for, f.model_name))""")
    cte(f"{p}h1", f"""
SELECT model_name, outcome, effect_name, state_value, note, list_dot_product(load, beta) AS estimate,
  list_transform(range(1, k + 1), lambda i: list_dot_product(s[i][1:k], load)) AS lever FROM {p}h0""")
    cte(f"{p}h2", f"""
SELECT h.model_name, h.outcome, h.effect_name, h.state_value, h.note, h.estimate, n.df, sqrt(n.scale * sum(pow(list_dot_product(c.score, h.lever), 2))) AS se
FROM {p}h1 h JOIN {p}c c USING (model_name) JOIN {p}n n USING (model_name)
GROUP BY h.model_name, h.outcome, h.effect_name, h.state_value, h.note, h.estimate, n.df, n.scale""")
    cte(f"{p}h", f"""
SELECT *, estimate / se AS t_stat, 1 - ({inside('estimate / se', 'df')}) AS p_value, estimate - crit * se AS ci95_lo, estimate + crit * se AS ci95_hi
FROM {p}h2 JOIN {p}t USING (df)""")


EFFECTS = "model_name:s outcome:s effect_name:s state_value:f estimate:f se:f t_stat:f p_value:f ci95_lo:f ci95_hi:f note:s"


def wild(p: str, columns: str, draws: int = 999, seed: int = 20260717) -> None:
    """Wild draws of the tested columns; ``columns`` is a condition on ``term``. Signs fall on cluster scores of the fit without the column."""
    cte(f"{p}w0", f"""
SELECT f.model_name, j, f.terms[j] AS term, f.k, f.s, f.s[j][1:f.k] AS a,
  list_transform(range(1, f.k + 1), lambda i: f.beta[i] - f.s[i][j] * f.beta[j] / f.s[j][j]) AS b0
FROM {p}f f, unnest(range(1, f.k + 1)) q(j) WHERE {columns.format('f.terms[j]')}""")
    cte(f"{p}w1", f"""
SELECT model_name, j, cluster, list(v ORDER BY i) AS v, list(r ORDER BY i) AS r FROM (
  SELECT x.model_name, w.j, x.cluster, i, sum(x.x[i] * (x.y - list_dot_product(x.x, w.b0))) AS v, sum(x.x[i] * list_dot_product(x.x, w.a)) AS r
  FROM {p}x x JOIN {p}w0 w USING (model_name), unnest(range(1, w.k + 1)) q(i) GROUP BY x.model_name, w.j, x.cluster, i) u GROUP BY model_name, j, cluster""")
    cte(f"{p}w2", f"""
SELECT c.*, d, CASE WHEN d = 0 OR md5('{seed}|' || d || '|' || cluster) < '8' THEN 1.0 ELSE -1.0 END AS sign FROM {p}w1 c, range({draws + 1}) q(d)""")
    cte(f"{p}w3", f"""
SELECT model_name, j, d, list(v ORDER BY i) AS sums FROM (SELECT model_name, j, d, i, sum(sign * v[i]) AS v FROM {p}w2, unnest(range(1, len(v) + 1)) q(i)
  GROUP BY model_name, j, d, i) u GROUP BY model_name, j, d""")
    cte(f"{p}w4", f"""
SELECT u.model_name, u.j, u.d, w.a, list_transform(range(1, w.k + 1), lambda i: list_dot_product(w.s[i][1:w.k], u.sums)) AS delta
FROM {p}w3 u JOIN {p}w0 w USING (model_name, j)""")
    cte(f"{p}w5", f"""
SELECT c.model_name, c.j, c.d, any_value(u.delta[u.j]) / sqrt(any_value(n.scale) * sum(pow(c.sign * list_dot_product(u.a, c.v) - list_dot_product(c.r, u.delta), 2))) AS t
FROM {p}w2 c JOIN {p}w4 u USING (model_name, j, d) JOIN {p}n n USING (model_name) GROUP BY c.model_name, c.j, c.d""")
    cte(f"{p}w", f"""
SELECT a.model_name, w.term, (1 + count(*) FILTER (WHERE abs(a.t) >= abs(o.t))) / (1.0 + count(*)) AS p_wild_cluster
FROM {p}w5 a JOIN {p}w5 o ON o.model_name = a.model_name AND o.j = a.j AND o.d = 0 JOIN {p}w0 w ON w.model_name = a.model_name AND w.j = a.j
WHERE a.d > 0 GROUP BY a.model_name, w.term""")


# ---- target and path factors --------------------------------------------------------------------

cte("spcs0", """
SELECT (date_diff('day', DATE '1995-01-01', o_orderdate::DATE) // 10)::INT AS session, o_totalprice AS p, substr(o_orderpriority, 1, 1)::INT AS k FROM orders""")
cte("spcs1", """
SELECT session, """ + ", ".join(f"(avg(p) FILTER (k = {k}) - (SELECT avg(p) FROM spcs0 WHERE k = {k})) / 1000 AS z{k}" for k in range(1, 5)) + " FROM spcs0 GROUP BY session")
cte("spcs2", """
SELECT DISTINCT b.event_date, b.shock_target / 10 AS t, z1, z2, z3, z4 FROM sbase b LEFT JOIN spcs1 z USING (session)""")


def factors(p: str, target: str, partial: str, spread: str) -> None:
    """First principal component by squaring the correlations; ``spread`` are the rows that set the scale."""
    cte(f"{p}0", f"SELECT event_date, {target} AS t, [z1, z2, z3, z4, {partial}]::DOUBLE[] AS z, z1 + z2 + z3 + z4 + {partial} IS NOT NULL AS known FROM spcs2")
    cte(f"{p}1", f"""
SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(v ORDER BY j) AS r FROM (SELECT i, j, covar_samp(z[i], z[j]) AS v FROM {p}0, range(1, 6) a(i), range(1, 6) b(j)
  WHERE known GROUP BY i, j) q GROUP BY i) u""")
    corr = "list_transform(range(1, 5), lambda i: list_transform(range(1, 5), lambda j: c[i][j] / sqrt(c[i][i] * c[j][j])))"
    trace = "(a[1][1] + a[2][2] + a[3][3] + a[4][4])"
    square = f"list_transform(range(1, 5), lambda i: list_transform(range(1, 5), lambda j: list_dot_product(a[i], a[j]) / ({trace} * {trace})))"
    cte(f"{p}2", f"SELECT c, list_reduce(list_prepend({corr}, list_transform(range(60), lambda q: [[0.0::DOUBLE]])), lambda a, q: {square}) AS m FROM {p}1")
    cte(f"{p}3", f"SELECT c, list_transform(range(1, 5), lambda i: m[i][1] / sqrt(c[i][i])) AS l FROM {p}2")
    cte(f"{p}4", f"""
SELECT c, list_transform(l, lambda v: v * CASE WHEN list_sum(list_transform(range(1, 5), lambda i: l[i] * list_sum(c[i][1:4]))) < 0 THEN -1 ELSE 1 END) AS l FROM {p}3""")
    cte(f"{p}5", f"SELECT l, list_sum(list_transform(range(1, 5), lambda i: l[i] * c[i][5])) / c[5][5] AS slope FROM {p}4")
    cte(f"{p}6", f"SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(z[i]) AS m FROM {p}0, range(1, 6) a(i) WHERE known GROUP BY i) q")
    cte(f"{p}7", f"""
SELECT event_date, t, CASE WHEN known THEN list_sum(list_transform(range(1, 5), lambda i: l[i] * (z[i] - m[i]))) - slope * (z[5] - m[5]) END AS path FROM {p}0, {p}5, {p}6""")
    cte(f"{p}8", f"SELECT stddev_samp(path) AS sp, stddev_samp(t) AS st FROM {spread.format(f'{p}7')}")
    cte(p, f"SELECT event_date, t AS target_pca_10bp, path / sp * st AS path_pca_10bp FROM {p}7, {p}8")


factors("spca", "t", "t", "{0}")
factors("spcr", "coalesce(t, 0.0)", "coalesce(t * 10, 0.0)", "{0} JOIN sbase USING (event_date)")
twin("target_path_factors", "event_date:s target_pca_10bp:f path_pca_10bp:f", "spca")
twin("target_path_factors_rows", "event_date:s target_pca_10bp:f path_pca_10bp:f", "spcr")

# ---- release and state models -------------------------------------------------------------------

cte("sfull", """
SELECT s.*, s.pre_j AS "pre_PR_signed_jump", asinh(s."pre_PR_rv") AS "pre_asinh_PR_rv", (s.root_code = 'gg')::INT::DOUBLE AS root_gg,
  abs(f.target_pca_10bp) AS abs_target_pca_10bp, abs(f.path_pca_10bp) AS abs_path_pca_10bp FROM ssig s LEFT JOIN spca f USING (event_date)""")
battery("msig", "sfull", batteries.SIGNAL)
twin("signal_models", COEFFICIENTS, "msigb")

_STATE_COLUMNS = ("state_pre_rv_z", "ma3_target_10bp_z", "state_pre_rsvneg_z", "regime_hike")
cte("sstate", f"""
SELECT f.*, {', '.join(f't.{c}' for c in _STATE_COLUMNS)}, l.target_x_hike, l."target_x_preRV", l.target_x_memory, l."target_x_preRSVneg"
FROM sfull f JOIN sst t USING (event_date) JOIN slong l ON l.event_date = f.event_date AND l.root_code = f.root_code""")
battery("msta", "sstate", batteries.STATE)
effects("msta", state_effects())
twin("state_models", COEFFICIENTS, "mstab")
twin("marginal_effects", EFFECTS, "mstah")
cte("mstas_", """
SELECT f.model_name, f.outcome, array_to_string(f.terms, ' + ') AS rhs, f.n AS n_obs, n.n_clusters, f.k AS n_params, f.k AS rank_design, f.r2, f.adj_r2,
  f.sy / f.n AS mean_depvar, sqrt(f.tss / (f.n - 1)) AS sd_depvar FROM mstaf f JOIN mstan n USING (model_name)""")
twin("state_model_summary", "model_name:s outcome:s rhs:s n_obs:i n_clusters:i n_params:i rank_design:i r2:f adj_r2:f mean_depvar:f sd_depvar:f", "mstas_")
cte("spur", """
SELECT s.*, p.shock_resid_loo AS shock_purified_10bp, p.shock_resid_loo * s.regime_hike AS target_purified_x_hike,
  p.shock_resid_loo * s.state_pre_rv_z AS "target_purified_x_preRV", p.shock_resid_loo * s.ma3_target_10bp_z AS target_purified_x_memory,
  p.shock_resid_loo * s.state_pre_rsvneg_z AS "target_purified_x_preRSVneg" FROM sstate s LEFT JOIN spf p USING (event_date)""")
battery("mpur", "spur", batteries.PURIFIED)
effects("mpur", state_effects("shock_purified_10bp", "target_purified"))
twin("purified_models", COEFFICIENTS, "mpurb")
twin("purified_effects", EFFECTS, "mpurh")
cte("scompl", "SELECT s.*, c.asinh_directional_var, c.asinh_dispersion_var FROM sstate s JOIN scomp c ON c.event_date = s.event_date AND c.root_code = s.root_code")
battery("mvc", "scompl", batteries.COMPONENTS)
twin("component_models", COEFFICIENTS, "mvcb")

# ---- normal continuation and abnormal outcomes ---------------------------------------------------

cte("snorm0", """
SELECT p.trade_date, p.root_code, p.year_number, p.is_event, p.clock_late, p.weekday_number, month(p.trade_date) AS month_number, p.slow5_log_rv, o.outcome, o.y, o.pre,
  date_diff('day', DATE '1970-01-01', p.trade_date)::DOUBLE AS day, 'NORMAL_' || o.outcome || '_' || p.root_code AS model_name, NOT p.is_event AND o.y IS NOT NULL AS train
FROM sp p, LATERAL (VALUES """ + ", ".join(f"('{y}', {y}, {pre})" for y, (pre, _) in NORMAL.items()) + """) o(outcome, y, pre)
WHERE p.window_eligible AND o.pre IS NOT NULL AND p.slow5_log_rv IS NOT NULL""")
cte("snorm1", """
SELECT model_name, avg(pre) AS mp, avg(slow5_log_rv) AS ms, avg(day) AS md FROM snorm0 WHERE train GROUP BY model_name HAVING count(*) >= 100""")
cte("snorm", f"""
SELECT r.*, [1.0, pre - mp, (pre - mp) * (pre - mp), slow5_log_rv - ms, clock_late, (day - md) / 365.25,
  {', '.join(f'(weekday_number = {d})::INT' for d in WEEKDAYS)}, {', '.join(f'(month_number = {m})::INT' for m in MONTHS)}]::DOUBLE[] AS x
FROM snorm0 r JOIN snorm1 USING (model_name)""")
_NORMAL_MODELS = [(f"NORMAL_{y}_{r}", y, tuple(normal_terms(p))) for y, (p, _) in NORMAL.items() for r in ("fx", "gg")]
fits("mnor", "SELECT model_name, trade_date::VARCHAR AS cluster, x, y FROM snorm WHERE train", _NORMAL_MODELS)
adjusted("mnor")
tests("mnor")
twin("normal_models", COEFFICIENTS, "mnorb")
cte("sabo0", "SELECT r.trade_date, r.root_code, r.outcome, r.y, list_dot_product(r.x, f.beta) AS cf FROM snorm r JOIN mnorf f USING (model_name)")
cte("sabo", "SELECT p.*, (p.root_code = 'gg')::INT::DOUBLE AS root_gg, " + ", ".join(
    f"max(a.cf) FILTER (a.outcome = '{y}') AS \"cf_{y}\", max(a.y - a.cf) FILTER (a.outcome = '{y}') AS \"{name}\"" for y, (_, name) in NORMAL.items())
    + " FROM sp p LEFT JOIN sabo0 a ON a.trade_date = p.trade_date AND a.root_code = p.root_code GROUP BY ALL")
twin("abnormal_outcomes", "trade_date:s root_code:s cf_log_BV_post:f abnormal_log_BV:f abnormal_log_RV:f abnormal_jump_share:f", "sabo")
# Every year's fit leaves that year out.
cte("snly0", "SELECT DISTINCT model_name, year_number AS left_out FROM snorm WHERE train")
fits("mnly", """SELECT o.model_name || '#' || left_out AS model_name, trade_date::VARCHAR AS cluster, x, y FROM snorm r JOIN snly0 o
ON o.model_name = r.model_name AND r.year_number <> o.left_out WHERE train""", [("none", "none", ("none",))])
cte("snly1", """
SELECT r.model_name, r.y, r.y - list_dot_product(r.x, list_transform(range(1, s.k + 1), lambda i: s.s[i][s.k + 1])) AS err
FROM snorm r JOIN mnlys s ON s.model_name = r.model_name || '#' || r.year_number WHERE r.train AND s.n >= 50""")
cte("snsum", """
SELECT f.model_name, f.outcome, f.n AS n_controls, f.k AS n_parameters, f.k AS rank_design, f.r2 AS r2_in_sample, f.adj_r2 AS adj_r2_in_sample,
  sqrt(f.sse / f.n) AS rmse_in_sample, l.n AS n_leave_year_out, l.rmse AS rmse_leave_year_out, l.r2 AS r2_leave_year_out
FROM mnorf f LEFT JOIN (SELECT model_name, count(*) AS n, sqrt(avg(err * err)) AS rmse, 1 - sum(err * err) / (var_samp(y) * (count(*) - 1)) AS r2
  FROM snly1 GROUP BY model_name) l USING (model_name)""")
twin("normal_summary", "model_name:s outcome:s n_controls:i n_parameters:i rank_design:i r2_in_sample:f adj_r2_in_sample:f rmse_in_sample:f "
     "n_leave_year_out:i rmse_leave_year_out:f r2_leave_year_out:f", "snsum")

# ---- event models -------------------------------------------------------------------------------

cte("sevent", """
SELECT a.*, t.regime_hike, f.target_pca_10bp * f.target_pca_10bp + f.path_pca_10bp * f.path_pca_10bp AS q_factor,
  (f.target_pca_10bp * f.target_pca_10bp + f.path_pca_10bp * f.path_pca_10bp) * a.pre_state_z AS q_factor_x_pre
FROM sabo a LEFT JOIN sst t ON t.event_date = a.trade_date AND a.is_event LEFT JOIN spca f ON f.event_date = a.trade_date AND a.is_event""")
battery("mcf", "sevent", batteries.COUNTERFACTUAL)
effects("mcf", conditional_effects(batteries.COUNTERFACTUAL))
_TESTED = "(suffix({0}, 'q_target') OR suffix({0}, 'q_factor') OR suffix({0}, '_x_pre'))"
wild("mcf", _TESTED)
cte("mcfall", "SELECT b.*, w.p_wild_cluster FROM mcfb b LEFT JOIN mcfw w ON w.model_name = b.model_name AND w.term = b.term WHERE b.n_clusters >= 30")
twin("counterfactual_models", COEFFICIENTS + " p_wild_cluster:f", "mcfall")
cte("mcfcond", "SELECT *, CASE WHEN contains(outcome, 'log') THEN exp(estimate) - 1 END AS implied_relative_change FROM mcfh")
twin("conditional_effects", EFFECTS + " implied_relative_change:f", "mcfcond")


def _below(t: str, df: str) -> str:
    return f"(0.5 + 0.5 * sign({t}) * ({inside(t, df)}))"


cte("mcfeq0", "SELECT model_name, term, beta, se, df, crit90, ln(1.25) AS m FROM mcfb WHERE suffix(term, '_x_pre') AND contains(outcome, 'log') AND n_clusters >= 30")
cte("mcfeq1", f"SELECT *, greatest(1 - {_below('((beta + m) / se)', 'df')}, {_below('((beta - m) / se)', 'df')}) AS p FROM mcfeq0")
cte("mcfeq", """
SELECT model_name, term, beta AS estimate, se AS se_cluster, m AS margin_log_points, exp(m) AS margin_multiplier_ratio, beta - crit90 * se AS ci90_lo,
  beta + crit90 * se AS ci90_hi, p AS p_tost, p < 0.05 AS equivalent_at_5pct FROM mcfeq1""")
twin("equivalence_tests", "model_name:s term:s estimate:f se_cluster:f margin_log_points:f margin_multiplier_ratio:f ci90_lo:f ci90_hi:f p_tost:f equivalent_at_5pct:b", "mcfeq")

# ---- matched models -----------------------------------------------------------------------------

_MATCHED = {"log_BV_post": "matched_abnormal_log_BV", "log_RV_post": "matched_abnormal_log_RV", "jump_share_post": "matched_abnormal_jump_share"}
cte("smp", "SELECT e.*, " + ", ".join(f"max(r.matched_abnormal) FILTER (r.outcome = '{y}') AS {n}" for y, n in _MATCHED.items())
    + " FROM sevent e LEFT JOIN smr r ON r.trade_date = e.trade_date AND r.root_code = e.root_code WHERE e.is_event GROUP BY ALL")
_SPECIFICATIONS = [
    Model(f"MATCHED_{name}", _MATCHED[y], (q, "pre_state_z", f"{q}_x_pre", "regime_hike", *(("root_gg",) if root == "pooled" else ())),
          "window_eligible" + ("" if root == "pooled" else f" AND root_code = '{root}'"), "trade_date")
    for name, y, q, root in VALIDATION]
battery("mmt", "smp", _SPECIFICATIONS)
wild("mmt", _TESTED)
cte("mmtall", "SELECT b.*, w.p_wild_cluster FROM mmtb b LEFT JOIN mmtw w ON w.model_name = b.model_name AND w.term = b.term WHERE b.n_clusters >= 30")
twin("matched_models", COEFFICIENTS + " p_wild_cluster:f", "mmtall")

# ---- bipower models and predictability ----------------------------------------------------------

cte("xseq", """
SELECT *, row_number() OVER f AS pos, lag(px) OVER f AS prev FROM sb WINDOW f AS (PARTITION BY file_name_clean ORDER BY bd)""")
cte("xfirst", """
SELECT p.event_date, p.root_code, p.file_name_clean,
  (SELECT count(*) FROM sb b WHERE b.file_name_clean = p.file_name_clean AND b.bd < p.event_date + 5) + 1 AS first_pos FROM ssig p""")
cte("xasof", """
SELECT f.event_date, f.root_code, s.bd, ln(s.px) - ln(s.prev) AS r FROM xfirst f JOIN xseq s ON s.file_name_clean = f.file_name_clean
  AND s.pos >= f.first_pos AND s.pos < f.first_pos + 6 WHERE f.first_pos > 1""")
cte("xpair", "SELECT *, abs(r) * abs(lag(r) OVER (PARTITION BY event_date, root_code ORDER BY bd)) AS pp FROM xasof")
cte("xbns", """
SELECT event_date, root_code, asinh(pi() / 2 * sum(pp)) AS "asinh_BV_PR", asinh(greatest(sum(r * r) - pi() / 2 * sum(pp), 0)) AS "asinh_JV_PR"
FROM xpair GROUP BY event_date, root_code""")
cte("xpanel", """
SELECT s.*, b."asinh_BV_PR", b."asinh_JV_PR" FROM sstate s LEFT JOIN xbns b ON b.event_date = s.event_date AND b.root_code = s.root_code""")
battery("mbns", "xpanel", batteries.BIPOWER)
twin("bipower_models", COEFFICIENTS, "mbnsb")

_TENSION = ("shock_target_10bp", "state_pre_rv_z", "target_x_preRV", "root_gg")
_FULL = ("shock_target_10bp", "regime_hike", "target_x_hike", "state_pre_rv_z", "target_x_preRV", "state_pre_rsvneg_z", "target_x_preRSVneg",
         "ma3_target_10bp_z", "target_x_memory", "root_gg")
_OUTCOMES = ("asinh_BV_PR", "asinh_PR_rv")


def dated(panel: str, models: list[tuple[str, str, tuple[str, ...], str]], kept: str) -> str:
    """Rows (model_name, event_date, root_code, x, y, ...) of models given as (name, outcome, terms, condition)."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS model_name, event_date, root_code, {kept}, [1.0, {', '.join(x)}]::DOUBLE[] AS x, {y}::DOUBLE AS y FROM {panel} "
        f"WHERE {' AND '.join([where] + [f'{c} IS NOT NULL' for c in (y, *x)])}" for name, y, x, where in models)


def date_solves(p: str, sums: str) -> None:
    """Coefficients per (model, date) of sums (model_name, event_date, i, j, v) of cross products."""
    cte(f"{p}q", f"""
SELECT model_name, event_date, list(r ORDER BY i) AS g FROM (SELECT model_name, event_date, i, list(v ORDER BY j) AS r FROM {sums} GROUP BY model_name, event_date, i) q
GROUP BY model_name, event_date""")
    cte(f"{p}z", f"""
SELECT model_name, event_date, len(g) - 1 AS k, round(g[1][1])::BIGINT AS n_train_obs, list_transform({swept('g', 'len(g) - 1')}[1:len(g) - 1], lambda r: r[len(g)]) AS beta
FROM {p}q WHERE round(g[1][1]) > len(g) - 1""")


def date_grams(p: str) -> None:
    cte(f"{p}d", f"""
SELECT model_name, event_date, i, j, sum(z[i] * z[j]) AS v FROM (SELECT model_name, event_date, list_append(x, y) AS z FROM {p}r) r,
  unnest(range(1, len(z) + 1)) a(i), unnest(range(1, len(z) + 1)) b(j) GROUP BY model_name, event_date, i, j""")


cte("mxfr", dated("xpanel", [(f"{y}|{n}", y, x, "true") for y in _OUTCOMES for n, x in (
    ("M0_mean", ("shock_target_10bp", "root_gg")), ("M1_tension", _TENSION), ("M2_full", _FULL))], "shock_target_10bp, state_pre_rv_z"))
date_grams("mxf")
cte("mxfo", "SELECT model_name, event_date, i, j, sum(v) OVER (PARTITION BY model_name, i, j) - v AS v FROM mxfd")
date_solves("mxf", "mxfo")
cte("mxf", """
SELECT r.event_date, r.root_code, string_split(r.model_name, '|')[1] AS outcome, string_split(r.model_name, '|')[2] AS model_name, r.y AS observed_y,
  list_dot_product(r.x, z.beta) AS fitted_cf, r.y - list_dot_product(r.x, z.beta) AS residual_cf, r.shock_target_10bp, r.state_pre_rv_z, z.n_train_obs,
  e.n - 1 AS n_train_events, z.k AS n_parameters, z.k AS rank_x, false AS rank_deficient
FROM mxfr r JOIN mxfz z ON z.model_name = r.model_name AND z.event_date = r.event_date
JOIN (SELECT model_name, count(DISTINCT event_date) AS n FROM mxfr GROUP BY model_name) e ON e.model_name = r.model_name""")
twin("crossfit_residuals", "event_date:s root_code:s outcome:s model_name:s observed_y:f fitted_cf:f residual_cf:f shock_target_10bp:f state_pre_rv_z:f n_train_obs:i "
     "n_train_events:i n_parameters:i rank_x:i rank_deficient:b", "mxf")

# ---- collinearity, leverage, stacked models, leave-top-k ------------------------------------------

_COLLINEAR = ("q_target", "pre_state_z", "q_target_x_pre", "regime_hike", "root_gg")
cte("mcol0", f"SELECT [{', '.join(_COLLINEAR)}]::DOUBLE[] AS v FROM sevent WHERE is_event AND window_eligible AND {' AND '.join(f'{c} IS NOT NULL' for c in _COLLINEAR)}")
cte("mcol1", """
SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(v ORDER BY j) AS r FROM (SELECT i, j, corr(v[i], v[j]) AS v FROM mcol0, range(1, 6) a(i), range(1, 6) b(j) GROUP BY i, j) q
GROUP BY i) u""")
cte("mcol", f"SELECT c[1][3] AS corr_q_q_x_state, s[1][1] AS vif_q, s[3][3] AS vif_q_x_state FROM (SELECT c, {swept('c', '5')} AS s FROM mcol1) q")
twin("energy_collinearity", "corr_q_q_x_state:f vif_q:f vif_q_x_state:f", "mcol")
cte("mlev", f"""
SELECT cluster AS trade_date, sum(list_dot_product(x, list_transform(range(1, k + 1), lambda i: list_dot_product(s[i][1:k], x)))) AS leverage
FROM mcfe WHERE model_name = '{batteries.COUNTERFACTUAL[0].name}' GROUP BY cluster""")
twin("event_leverage", "trade_date:s leverage:f", "mlev")

_ZEROS = "list_transform(range(21), lambda q: 0.0)"


def stacked() -> None:
    """One-stage models: a normal block per root next to the event terms."""
    rows, models = [], []
    for name, y, q, root in VALIDATION:
        event = "is_event::INT::DOUBLE"
        tail = [f"CASE WHEN is_event THEN {q} ELSE 0.0 END", f"{event} * pre_state_z", f"CASE WHEN is_event THEN {q} * pre_state_z ELSE 0.0 END",
                "CASE WHEN is_event THEN regime_hike ELSE 0.0 END"]
        labels = [f"event_{q}", "event_state", f"event_{q}_x_pre", "event_regime_hike"]
        terms = normal_terms(NORMAL[y][0])
        if root == "pooled":
            own = [f"CASE WHEN root_code = '{r}' THEN x ELSE {_ZEROS} END" for r in ("fx", "gg")]
            x = f"list_concat({own[0]}, list_concat({own[1]}, [{event}, {event} * root_gg, {', '.join(tail)}]))"
            names = [f"{r}_normal_{t}" for r in ("fx", "gg") for t in terms] + ["event_intercept", "event_root_gg", *labels]
        else:
            x = f"list_concat(x, [{event}, {', '.join(tail)}])"
            names = [f"{root}_normal_{t}" for t in terms] + ["event_intercept", *labels]
        only = "" if root == "pooled" else f" AND root_code = '{root}'"
        rows.append(f"SELECT 'STACKED_{name}' AS model_name, trade_date::VARCHAR AS cluster, {x}::DOUBLE[] AS x, y, is_event FROM mstk0 "
                    f"WHERE outcome = '{y}' AND (NOT is_event OR {q} IS NOT NULL){only}")
        models.append((f"STACKED_{name}", y, tuple(names)))
    fits("mst", " UNION ALL ".join(rows), models)


cte("mstk0", """
SELECT r.trade_date, r.root_code, r.outcome, r.x, r.y, e.is_event, e.root_gg, e.pre_state_z, e.regime_hike, e.q_target, e.q_factor FROM snorm r JOIN sevent e
ON e.trade_date = r.trade_date AND e.root_code = r.root_code WHERE r.y IS NOT NULL AND e.pre_state_z IS NOT NULL""")
stacked()
clustered("mst")
cte("mstev", "SELECT model_name, count(DISTINCT cluster) FILTER (is_event) AS g FROM mstx GROUP BY model_name")
cte("mstt", f"""
SELECT df, {critical('df', 0.95)} AS crit FROM (SELECT df FROM mstn UNION SELECT g - 1 FROM mstev) q""")
cte("mstb0", """
SELECT f.model_name, f.outcome, f.terms[j] AS term, f.beta[j] AS beta, n.n_clusters, CASE WHEN starts_with(f.terms[j], 'event_') THEN v.g - 1 ELSE n.df END AS df, f.n AS n_obs,
  f.r2, f.adj_r2, sqrt(n.scale * sum(pow(list_dot_product(c.score, f.s[j][1:f.k]), 2))) AS se
FROM mstf f JOIN mstc c USING (model_name) JOIN mstn n USING (model_name) JOIN mstev v USING (model_name), unnest(range(1, f.k + 1)) a(j) WHERE v.g >= 30
GROUP BY f.model_name, f.outcome, f.terms[j], f.beta[j], n.n_clusters, n.df, v.g, n.scale, f.n, f.r2, f.adj_r2""")
cte("mstb", f"""
SELECT *, beta / se AS t_stat, 1 - ({inside('beta / se', 'df')}) AS p_value, beta - crit * se AS ci95_lo, beta + crit * se AS ci95_hi FROM mstb0 JOIN mstt USING (df)""")
twin("stacked_models", COEFFICIENTS, "mstb")

cte("mtop0", " UNION ALL ".join(
    f"SELECT '{q}' AS q, trade_date, energy, row_number() OVER (ORDER BY energy DESC, trade_date) AS energy_rank, least(10, greatest(count(*) OVER () - 30, 0)) AS most "
    f"FROM (SELECT trade_date, min_by({q}, root_code) AS energy FROM sevent WHERE is_event AND {q} IS NOT NULL GROUP BY trade_date) u" for q in ("q_target", "q_factor")))
cte("mtop1", " UNION ALL ".join(
    f"SELECT '{m.name}' AS base, trade_date, [1.0, {', '.join(m.terms)}]::DOUBLE[] AS x, {m.outcome}::DOUBLE AS y, '{m.terms[0]}' AS q FROM sevent "
    f"WHERE ({m.where}) AND {' AND '.join(f'{c} IS NOT NULL' for c in (m.outcome, *m.terms))}" for m in batteries.COUNTERFACTUAL))
fits("mtk", """
SELECT r.base || '#' || lpad(k::VARCHAR, 2, '0') AS model_name, r.trade_date::VARCHAR AS cluster, r.x, r.y FROM mtop1 r JOIN mtop0 t ON t.trade_date = r.trade_date AND t.q = r.q,
  unnest(range(0, least(t.energy_rank - 1, t.most) + 1)) u(k)""", [(f"{m.name}#{k:02d}", m.outcome, ("Intercept", *m.terms)) for m in batteries.COUNTERFACTUAL for k in range(11)])
clustered("mtk")
tests("mtk")
wild("mtk", _TESTED + " AND string_split(f.model_name, '#')[2] IN ('00', '01', '02', '03', '05')")
cte("mtopd", """
SELECT k, q, string_agg(trade_date::VARCHAR, ';' ORDER BY energy_rank) FILTER (energy_rank <= k) AS removed, max(energy) FILTER (energy_rank <= k) AS largest_removed_energy,
  max(energy) FILTER (energy_rank = k + 1) AS largest_retained_energy FROM mtop0, range(11) a(k) GROUP BY k, q""")
cte("mtkall", """
SELECT string_split(b.model_name, '#')[1] AS model_name, string_split(b.model_name, '#')[2]::INT AS k_removed, b.term, b.beta, b.se, b.t_stat, b.p_value, b.n_obs, b.n_clusters,
  w.p_wild_cluster, coalesce(d.removed, '') AS removed_dates, d.largest_removed_energy, d.largest_retained_energy
FROM mtkb b LEFT JOIN mtkw w ON w.model_name = b.model_name AND w.term = b.term
JOIN mtopd d ON d.k = string_split(b.model_name, '#')[2]::INT AND d.q = CASE WHEN contains(b.term, 'q_factor') THEN 'q_factor' ELSE 'q_target' END
WHERE starts_with(b.term, 'q_') AND b.n_clusters >= 30""")
twin("leave_top_k", "model_name:s k_removed:i term:s beta:f se:f t_stat:f p_value:f n_obs:i n_clusters:i p_wild_cluster:f removed_dates:s largest_removed_energy:f "
     "largest_retained_energy:f", "mtkall")

# ---- thresholds ---------------------------------------------------------------------------------

_PROBS = [round(0.20 + 0.05 * i, 2) for i in range(13)]
cte("mth0", " UNION ALL ".join(
    f"SELECT '{n}' AS base, '{y}' AS outcome, event_date, shock_target_10bp AS shock, {q}::DOUBLE AS q, root_gg, {y}::DOUBLE AS y FROM sstate "
    f"WHERE shock_target_10bp IS NOT NULL AND {q} IS NOT NULL AND {y} IS NOT NULL" for n, y, q in batteries.FUNCTIONAL))
cte("mth1", "SELECT base, list_sort(list(q)) AS qs FROM (SELECT base, event_date, avg(q) AS q FROM mth0 GROUP BY base, event_date) u GROUP BY base")
cte("mth2", f"SELECT base, i, c FROM (SELECT base, [{', '.join(midpoint('qs', p) for p in _PROBS)}] AS cs FROM mth1) u, unnest(range(1, 14)) a(i), unnest([cs[i]]) b(c)")
cte("mth3", "SELECT base, c, row_number() OVER (PARTITION BY base ORDER BY min(i)) - 1 AS cand FROM mth2 GROUP BY base, c")
cte("mth4", """
SELECT r.*, t.c, r.base || '#' || lpad(t.cand::VARCHAR, 2, '0') AS model_name, (r.q > t.c)::INT::DOUBLE AS hi FROM mth0 r JOIN mth3 t USING (base)""")
cte("mth5", """
SELECT model_name, base, outcome, c, count(*) FILTER (hi = 0) AS n_left, count(*) FILTER (hi = 1) AS n_right FROM mth4 GROUP BY model_name, base, outcome, c
HAVING least(count(*) FILTER (hi = 0), count(*) FILTER (hi = 1)) >= greatest(10, ceil(count(*) * 0.15))""")
_THRESHOLD_MODELS = [(f"{n}#{i:02d}", y, ("Intercept", "shock_target_10bp", q, "threshold_hi", "shock_x_threshold_hi", "root_gg")) for n, y, q in batteries.FUNCTIONAL for i in range(13)]
fits("mthr", "SELECT r.model_name, r.event_date::VARCHAR AS cluster, [1.0, shock, q, hi, shock * hi, root_gg]::DOUBLE[] AS x, r.y FROM mth4 r JOIN mth5 USING (model_name)", _THRESHOLD_MODELS)
cte("mth6", "SELECT m.* FROM mth5 m JOIN mthrs f USING (model_name) QUALIFY row_number() OVER (PARTITION BY m.base ORDER BY f.s[f.k + 1][f.k + 1], m.model_name) = 1")
fits("mthb", "SELECT r.* FROM mthrx r JOIN mth6 USING (model_name)", _THRESHOLD_MODELS)
clustered("mthb")
tests("mthb")
effects("mthb", THRESHOLD_EFFECTS)
cte("mthall", """
SELECT m.base, m.outcome, m.c AS threshold_c, m.n_left, m.n_right, f.n AS n_obs, n.n_clusters, f.r2, f.adj_r2 FROM mth6 m JOIN mthbf f USING (model_name) JOIN mthbn n USING (model_name)""")
twin("threshold_search", "base:s outcome:s threshold_c:f n_left:i n_right:i n_obs:i n_clusters:i r2:f adj_r2:f", "mthall")
twin("threshold_slopes", EFFECTS, "mthbh")

# ---- resampled spectra and placebos -------------------------------------------------------------

_SEED, _DRAWS = 20260717, 999


def picked(n: str, *keys: str) -> str:
    """The same draw as functions.draws.pick, from 1."""
    return f"('0x' || substr(md5('{_SEED}|' || {' || chr(124) || '.join(keys)}), 1, 12))::BIGINT % {n} + 1"


cte("bsp0", "SELECT abnormal_11 AS a, abnormal_12 AS b, abnormal_22 AS c, row_number() OVER (ORDER BY trade_date) AS seq, count(*) OVER () AS n FROM sabn")
cte("bsp1", f"SELECT d, {picked('n', 'd', 'seq', chr(39) + '1' + chr(39))} AS seq FROM bsp0, range(1, {_DRAWS + 1}) q(d)")
cte("bsp2", "SELECT d, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM bsp1 JOIN bsp0 USING (seq) GROUP BY d")
cte("bsp3", """
SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS lp, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS lm, cos(atan2(b, (a - c) / 2) / 2) AS x,
  sin(atan2(b, (a - c) / 2) / 2) AS y FROM bsp2""")
cte("bsp", """
SELECT d AS draw, t.a AS "A_fx_fx", t.b AS "A_fx_gg", t.c AS "A_gg_gg", t.lp AS lambda_plus, t.lm AS lambda_minus, t.c - t.a AS rotation_gg_minus_fx,
  CASE WHEN x * v.px + y * v.py < 0 THEN -x ELSE x END AS vplus_fx, CASE WHEN x * v.px + y * v.py < 0 THEN -y ELSE y END AS vplus_gg,
  CASE WHEN -y * v.mx + x * v.my < 0 THEN y ELSE -y END AS vminus_fx, CASE WHEN -y * v.mx + x * v.my < 0 THEN -x ELSE x END AS vminus_gg FROM bsp3 t, svec v""")
twin("bootstrap_spectrum", "draw:i A_fx_fx:f A_fx_gg:f A_gg_gg:f lambda_plus:f lambda_minus:f vplus_fx:f vplus_gg:f vminus_fx:f vminus_gg:f rotation_gg_minus_fx:f", "bsp")
cte("psp0", """
SELECT k.event_key, k.match_rank, count(*) OVER e AS n, """ + ", ".join(
    f"CASE WHEN count(*) OVER e > 1 THEN m.d_{i} - (sum(m.d_{i}) OVER e - m.d_{i}) / (count(*) OVER e - 1) ELSE 0.0 END AS p{i}" for i in ("11", "12", "22")) + """
FROM sk k JOIN smat m ON m.trade_date = k.control_key WINDOW e AS (PARTITION BY k.event_key)""")
cte("psp1", f"""
SELECT event_key, d, {picked('n', 'd', 'event_key')} AS match_rank FROM (SELECT DISTINCT event_key, n FROM psp0) u, range(1, {_DRAWS + 1}) q(d)""")
cte("psp2", "SELECT d, avg(p11) AS a, avg(p12) AS b, avg(p22) AS c FROM psp1 JOIN psp0 USING (event_key, match_rank) GROUP BY d")
cte("psp", """
SELECT d AS draw, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS lambda_plus, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS lambda_minus,
  c - a AS rotation_gg_minus_fx FROM psp2""")
twin("placebo_spectrum", "draw:i lambda_plus:f lambda_minus:f rotation_gg_minus_fx:f", "psp")

cte("mpl0", """
SELECT m.trade_date, m.root_code, m.outcome, m.k AS match_rank, count(*) OVER e AS n, m.cy - (sum(m.cy) OVER e - m.cy) / (count(*) OVER e - 1) AS pseudo, c.pre_state_z AS state
FROM smr2 m JOIN smr0 c ON c.trade_date = m.cd AND c.root_code = m.root_code AND c.outcome = m.outcome WHERE m.k <= 10
WINDOW e AS (PARTITION BY m.trade_date, m.root_code, m.outcome)""")
cte("mpl1", f"""
SELECT trade_date, root_code, outcome, d, {picked('n', 'd', 'trade_date', 'root_code', 'outcome')} AS match_rank FROM (SELECT DISTINCT trade_date, root_code, outcome, n FROM mpl0) u,
  range(1, {_DRAWS + 1}) q(d)""")
cte("mpl2", """
SELECT a.d, p.*, e.q_target, e.q_factor, e.regime_hike, e.root_gg FROM mpl1 a JOIN mpl0 p USING (trade_date, root_code, outcome, match_rank)
JOIN sevent e ON e.trade_date = p.trade_date AND e.root_code = p.root_code WHERE e.is_event AND e.window_eligible""")
fits("mpl", " UNION ALL ".join(
    f"SELECT '{name}#' || d AS model_name, '' AS cluster, [1.0, {q}, state, {q} * state, regime_hike{', root_gg' if root == 'pooled' else ''}]::DOUBLE[] AS x, pseudo AS y FROM mpl2 "
    f"WHERE outcome = '{y}' AND {q} IS NOT NULL AND regime_hike IS NOT NULL AND state IS NOT NULL AND pseudo IS NOT NULL" + ("" if root == "pooled" else f" AND root_code = '{root}'")
    for name, y, q, root in VALIDATION), [("none", "none", ("none",))])
cte("mpl4", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{q}', 2), ('{n}', '{q}_x_pre', 4)" for n, _, q, _ in VALIDATION) + ") v(spec, term, j)")
cte("mpl5", """
SELECT t.spec, t.term, s.s[t.j][s.k + 1] AS beta, o.beta AS observed_beta FROM mpls s JOIN mpl4 t ON string_split(s.model_name, '#')[1] = t.spec
JOIN mmtb o ON o.model_name = 'MATCHED_' || t.spec AND o.term = t.term WHERE s.n >= s.k""")
cte("mpl6", """
SELECT spec, term, max(observed_beta) AS observed_beta, avg(beta) AS placebo_mean, stddev_samp(beta) AS placebo_sd,
  (1 + count(*) FILTER (WHERE abs(beta) >= abs(observed_beta))) / (1.0 + count(*)) AS p_placebo_two_sided, count(*) AS n_usable, list_sort(list(beta)) AS bs
FROM mpl5 GROUP BY spec, term""")
cte("mplall", f"SELECT * EXCLUDE (bs), {midpoint('bs', 0.025)} AS placebo_ci95_lo, {midpoint('bs', 0.975)} AS placebo_ci95_hi FROM mpl6")
twin("matched_placebos", "spec:s term:s observed_beta:f placebo_mean:f placebo_sd:f p_placebo_two_sided:f n_usable:i placebo_ci95_lo:f placebo_ci95_hi:f", "mplall")

_INTERVALS = {"lambda_plus": "lambda_plus", "lambda_minus": "lambda_minus", "A_fx_fx": "A_fx_fx", "A_fx_gg": "A_fx_gg", "A_gg_gg": "A_gg_gg", "rotation": "rotation_gg_minus_fx",
              "vplus_fx": "vplus_fx", "vplus_gg": "vplus_gg", "vminus_fx": "vminus_fx", "vminus_gg": "vminus_gg"}
cte("rif0", "SELECT name, list_sort(list(v)) AS vs FROM bsp, LATERAL (VALUES " + ", ".join(f"('{n}', \"{c}\")" for n, c in _INTERVALS.items()) + ") u(name, v) GROUP BY name")
cte("rif1", f"""
SELECT name || '_ci95_' || s AS metric, CASE WHEN s = 'lo' THEN {midpoint('vs', 0.025)} ELSE {midpoint('vs', 0.975)} END AS value FROM rif0, (VALUES ('lo'), ('hi')) t(s)""")
cte("rif2", """
SELECT (1 + count(*) FILTER (p.lambda_plus >= o.lp)) / (count(*) + 1.0) AS a, (1 + count(*) FILTER (p.lambda_minus <= o.lm)) / (count(*) + 1.0) AS b,
  (1 + count(*) FILTER (p.lambda_plus >= o.lp AND p.lambda_minus <= o.lm)) / (count(*) + 1.0) AS c,
  (1 + count(*) FILTER (p.rotation_gg_minus_fx >= o.c - o.a)) / (count(*) + 1.0) AS d, count(*)::DOUBLE AS n FROM psp p, svec o""")
cte("rif3", "SELECT avg((lambda_plus > 0 AND lambda_minus < 0)::INT) AS a, count(*)::DOUBLE AS n FROM bsp")
cte("rif4", """
SELECT avg((lambda_plus > 0 AND lambda_minus < 0)::INT) AS a, min(lambda_plus) AS pl, max(lambda_plus) AS ph, min(lambda_minus) AS ml, max(lambda_minus) AS mh,
  min(rotation_gg_minus_fx) AS rl, max(rotation_gg_minus_fx) AS rh FROM sloo""")
cte("rif", """
SELECT metric, value FROM rif1
UNION ALL SELECT m.metric, m.value FROM rif2, LATERAL (VALUES ('p_placebo_lambda_plus', a), ('p_placebo_lambda_minus', b), ('p_placebo_joint_indefinite', c),
  ('p_placebo_rotation_positive', d), ('placebo_draws', n)) m(metric, value)
UNION ALL SELECT m.metric, m.value FROM rif3, LATERAL (VALUES ('bootstrap_share_indefinite', a), ('bootstrap_draws', n)) m(metric, value)
UNION ALL SELECT m.metric, m.value FROM rif4, LATERAL (VALUES ('loo_share_indefinite', a), ('loo_lambda_plus_min', pl), ('loo_lambda_plus_max', ph), ('loo_lambda_minus_min', ml),
  ('loo_lambda_minus_max', mh), ('loo_rotation_min', rl), ('loo_rotation_max', rh)) m(metric, value)""")
twin("rotation_inference", "metric:s value:f", "rif")

# ---- continuation of the resolution study -------------------------------------------------------

cte("ccx", """
SELECT scenario, trade_date, is_event, year_number, [1.0, z0, z1, z2, z3, z4, clock_late, (weekday_number = 3)::INT, (weekday_number = 4)::INT, (weekday_number = 5)::INT,
  (weekday_number = 6)::INT, yz, yz * yz]::DOUBLE[] AS x, [d_11, d_12, d_22]::DOUBLE[] AS y
FROM (SELECT *, (year_number - avg(year_number) FILTER (NOT is_event) OVER s) / stddev_samp(year_number) FILTER (NOT is_event) OVER s AS yz FROM rs
  WINDOW s AS (PARTITION BY scenario)) q""")
cte("ccg0", """
SELECT y.scenario, y.year_number, i, j, sum(z[i] * z[j]) AS v0, sum(z[i] * z[j]) FILTER (r.year_number <> y.year_number) AS v1
FROM (SELECT DISTINCT scenario, year_number FROM ccx) y JOIN (SELECT scenario, year_number, list_concat(x, y) AS z FROM ccx WHERE NOT is_event) r ON r.scenario = y.scenario,
  unnest(range(1, 17)) a(i), unnest(range(1, 17)) b(j) GROUP BY y.scenario, y.year_number, i, j""")
cte("ccg1", """
SELECT scenario, year_number, list(r0 ORDER BY i) AS g0, list(r1 ORDER BY i) AS g1 FROM (
  SELECT scenario, year_number, i, list(v0 ORDER BY j) AS r0, list(v1 ORDER BY j) AS r1 FROM ccg0 GROUP BY scenario, year_number, i) q GROUP BY scenario, year_number""")
cte("ccg2", """
SELECT scenario, year_number, g, greatest(list_sum(list_transform(range(1, 14), lambda i: g[i][i])) / 13, 1.0) * 1e-6 AS ridge
FROM (SELECT *, CASE WHEN g1[1][1] >= 23 THEN g1 ELSE g0 END AS g FROM ccg1) q""")
cte("ccg3", f"""
SELECT scenario, year_number, g, {swept('h', '13')} AS s FROM (SELECT *, list_transform(range(1, 17), lambda i: list_transform(range(1, 17),
  lambda j: g[i][j] + CASE WHEN i = j AND i > 1 AND i <= 13 THEN ridge ELSE 0 END)) AS h FROM ccg2) q""")
cte("ccp", """
SELECT r.scenario, r.trade_date, r.is_event, o, r.y[o] AS y, list_dot_product(r.x, list_transform(range(1, 14), lambda i: f.s[i][13 + o])) AS lin, f.g[1][13 + o] / f.g[1][1] AS base
FROM ccx r JOIN ccg3 f ON f.scenario = r.scenario AND f.year_number = r.year_number, unnest(range(1, 4)) q(o)""")
cte("cca", """
SELECT scenario, o, count(*) AS n, CASE WHEN sum(pow(lin - base, 2)) > 0 THEN least(greatest(sum((y - base) * (lin - base)) / sum(pow(lin - base, 2)), 0.0), 1.0) ELSE 0.0 END AS a,
  sum(y * y) - pow(sum(y), 2) / count(*) AS tss FROM ccp WHERE NOT is_event GROUP BY scenario, o""")
cte("ccd", """
SELECT p.scenario, ['d_11', 'd_12', 'd_22'][p.o] AS outcome, 1 - sum(pow(p.y - p.lin, 2)) / any_value(a.tss) AS linear_leave_year_out_r2, any_value(a.a) AS shrinkage_weight,
  1 - sum(pow(p.y - p.base - a.a * (p.lin - p.base), 2)) / any_value(a.tss) AS leave_year_out_r2, any_value(a.n) AS n_control
FROM ccp p JOIN cca a ON a.scenario = p.scenario AND a.o = p.o WHERE NOT p.is_event GROUP BY p.scenario, p.o""")
twin("continuation_diagnostics", "scenario:s outcome:s linear_leave_year_out_r2:f shrinkage_weight:f leave_year_out_r2:f n_control:i", "ccd")
cte("ccr", """
SELECT p.scenario, p.trade_date, p.is_event, p.o, p.y, p.base + a.a * (p.lin - p.base) AS mu, p.y - p.base - a.a * (p.lin - p.base) AS e FROM ccp p JOIN cca a ON a.scenario = p.scenario AND a.o = p.o""")
cte("ccm", """
SELECT r.scenario, r.trade_date, r.cd FROM rrank r JOIN rsup s ON s.scenario = r.scenario AND s.trade_date = r.trade_date WHERE s.retained AND r.is_event AND r.k <= 10""")
cte("cce0", """
SELECT m.scenario, m.trade_date, c.o, count(*) AS n, avg(c.y) AS cy, avg(c.e) AS ce FROM ccm m JOIN ccr c ON c.scenario = m.scenario AND c.trade_date = m.cd GROUP BY m.scenario, m.trade_date, c.o""")
cte("cce", "SELECT e.scenario, e.trade_date, any_value(m.n) AS n_matches, " + ", ".join(
    f"max({expression}) FILTER (e.o = {o}) AS {name}{s}" for name, expression in (
        ("event_d", "e.y"), ("control_d", "m.cy"), ("raw_", "e.y - m.cy"), ("predicted_event_", "e.mu"), ("corrected_", "e.e - m.ce")) for o, s in ((1, "11"), (2, "12"), (3, "22")))
    + ", max(e.e - m.ce) FILTER (e.o = 3) - max(e.e - m.ce) FILTER (e.o = 1) AS rotation_gg_minus_fx "
    "FROM ccr e JOIN cce0 m ON m.scenario = e.scenario AND m.trade_date = e.trade_date AND m.o = e.o WHERE e.is_event GROUP BY e.scenario, e.trade_date")
twin("corrected_events", "scenario:s trade_date:s n_matches:i " + " ".join(
    f"{name}{s}:f" for name in ("event_d", "control_d", "raw_", "predicted_event_", "corrected_") for s in ("11", "12", "22")) + " rotation_gg_minus_fx:f", "cce")
# Balance of the five features before and after matching.
cte("ccb0", "SELECT scenario, trade_date, is_event, f, [z0, z1, z2, z3, z4][f + 1] AS v FROM rs, range(5) q(f)")
cte("ccb1", "SELECT scenario, f, avg(v) AS m, stddev_samp(v) AS sd FROM ccb0 WHERE NOT is_event GROUP BY scenario, f")
cte("ccb2", """
SELECT scenario, f, avg(v) AS m FROM ccb0 b WHERE is_event AND EXISTS (SELECT 1 FROM ccm m WHERE m.scenario = b.scenario AND m.trade_date = b.trade_date) GROUP BY scenario, f""")
cte("ccb3", """
SELECT scenario, f, avg(m) AS m FROM (SELECT m.scenario, m.trade_date, c.f, avg(c.v) AS m FROM ccm m JOIN ccb0 c ON c.scenario = m.scenario AND c.trade_date = m.cd
  GROUP BY m.scenario, m.trade_date, c.f) q GROUP BY scenario, f""")
cte("ccb", """
SELECT scenario, ['log_fx_pre', 'log_gg_pre', 'fisher_pre_corr', 'slow_fx', 'slow_gg'][f + 1] AS feature, e.m AS event_mean, b.m AS unmatched_control_mean, n.m AS matched_control_mean,
  (e.m - b.m) / CASE WHEN b.sd > 0 THEN b.sd ELSE 1.0 END AS smd_before, (e.m - n.m) / CASE WHEN b.sd > 0 THEN b.sd ELSE 1.0 END AS smd_after
FROM ccb1 b JOIN ccb2 e USING (scenario, f) JOIN ccb3 n USING (scenario, f)""")
twin("matching_balance", "scenario:s feature:s event_mean:f unmatched_control_mean:f matched_control_mean:f smd_before:f smd_after:f", "ccb")
