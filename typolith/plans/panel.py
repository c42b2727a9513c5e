"""Panel construction, features, labels and their descriptions, as declarative plans.

The panel has one row per entity (supplier) and quarter, with the value of five named categories, of all, and of the rest. Entities with fewer
than MIN_PERIODS complete quarters are left out. Labels name the category with the largest share (ties: the first in order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import materialise
from .sqlpair import Book, spark_text

MIN_PERIODS = 24
NAMED = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")
_ALL = [*(c.lower() for c in NAMED), "other"]
_pivot = ",\n    ".join(f"avg(CASE WHEN category = '{c}' THEN value END) AS {c.lower()}" for c in NAMED)
_named = " + ".join(f"coalesce({c.lower()}, 0e0)" for c in NAMED)
_complete = " AND ".join(f"{c.lower()} IS NOT NULL" for c in NAMED)
_share = ",\n    ".join(f"greatest({c}, 0e0) / greatest(total, 1e0) AS s_{c}" for c in _ALL)
_mean_log = "(" + " + ".join(f"ln(s_{c} + 1e-6)" for c in _ALL) + ") / 6"
_clr = ",\n    ".join(f"ln(s_{c} + 1e-6) - {_mean_log} AS clr_{c}" for c in _ALL)
_label = "CASE " + " ".join(f"WHEN s_{c} >= greatest({', '.join('s_' + x for x in _ALL)}) THEN {i}" for i, c in enumerate(_ALL)) + " END"

_BUILD = f"""WITH long AS (
  SELECT l_suppkey AS entity, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, p_type AS category, sum(l_extendedprice) AS value
  FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY 1, 2, 3
), wide AS (
  SELECT entity, period, sum(value) AS total,
    {_pivot}
  FROM long GROUP BY entity, period
), whole AS (
  SELECT *, total - ({_named}) AS other FROM wide WHERE {_complete}
), panel AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS n_periods FROM whole) AS w WHERE n_periods >= {MIN_PERIODS}
), shares AS (
  SELECT *, {_share} FROM panel
), level AS (
  SELECT *, {_clr},
    ln(greatest(total, 1e0)) AS log_total,
    ln(greatest(total, 1e0)) - median(ln(greatest(total, 1e0))) OVER (PARTITION BY period) AS rel_level
  FROM shares
)"""
_DERIVED = f"""feats AS (
  SELECT a.*, a.log_total - b.log_total AS yoy_log FROM level AS a
  LEFT JOIN level AS b ON a.entity = b.entity AND b.period = CAST(a.period - INTERVAL '12' MONTH AS DATE)
), labels_at AS (
  SELECT entity, period, CAST({_label} AS BIGINT) AS label, rel_level, log_total, s_economy, s_large, total FROM level
), steps AS (
  SELECT *, lag(label) OVER (PARTITION BY entity ORDER BY period) AS before FROM labels_at
), modal AS (
  SELECT entity, label FROM (
    SELECT entity, label, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, label) AS place FROM labels_at GROUP BY entity, label) AS m WHERE place = 1
), profile AS (
  SELECT entity, avg(rel_level) AS rel_mean, stddev_samp(rel_level) AS rel_sd, max(log_total) - min(log_total) AS amplitude, avg(yoy_log) AS growth,
    avg(s_economy) AS m_economy, avg(s_large) AS m_large, avg(s_medium) AS m_medium, avg(s_promo) AS m_promo, avg(s_small) AS m_small, avg(s_other) AS m_other
  FROM feats GROUP BY entity
)
"""
ORACLE_PREFIX = _BUILD + ", " + _DERIVED
PREFIX = "WITH wide AS (SELECT * FROM {wide}), panel AS (SELECT * FROM {level}), level AS (SELECT * FROM {level}), " + _DERIVED


def panel_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The wide table of entities and periods, and the complete panel with shares and levels; both are written once for a query."""
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part")}
    cut = _BUILD.index("), whole AS (")
    wide = materialise(spark.sql(spark_text(_BUILD[:cut] + ") SELECT * FROM wide"), **read), "panel-wide")
    level = "WITH " + _BUILD[cut + 3 :] + " SELECT * FROM level"
    return {"wide": wide, "level": materialise(spark.sql(spark_text(level.replace("FROM wide", "FROM {wide}")), wide=wide), "panel-level")}


BOOK = Book(PREFIX, ORACLE_PREFIX, panel_tables)
_add = BOOK.add
_feature_columns = ", ".join([*(f"R[s_{c};6] AS share_{c}" for c in _ALL), *(f"R[clr_{c};6] AS clr_{c}" for c in _ALL)])

# panel and features
_add("panel_pivot", "SELECT entity, period, R[total;4] AS total, " + ", ".join(f"R[{c.lower()};4] AS {c.lower()}" for c in NAMED) + " FROM wide")
_add("panel_complete", "SELECT entity, period, n_periods, R[total;4] AS total, R[other;4] AS other FROM panel")
_add("features_panel", f"SELECT entity, period, {_feature_columns}, R[log_total;6] AS log_total, R[rel_level;6] AS rel_level, R[yoy_log;6] AS yoy_log FROM feats")
_add("features_profile", "SELECT entity, R[rel_mean;6] AS rel_mean, R[rel_sd;6] AS rel_sd, R[amplitude;6] AS amplitude, R[growth;6] AS growth, R[m_economy;6] AS share_economy FROM profile")
_add("trend_six", """SELECT entity, R[avg(CASE WHEN late <= 6 THEN s_economy END) - avg(CASE WHEN early <= 6 THEN s_economy END);6] AS trend FROM (
  SELECT entity, s_economy, row_number() OVER (PARTITION BY entity ORDER BY period) AS early, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS late FROM level) AS t GROUP BY entity""")
_add("zscore_clip", """SELECT entity, R[coalesce(greatest(-4e0, least(4e0, (rel_mean - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END)), 0e0);6] AS z FROM profile
  CROSS JOIN (SELECT avg(rel_mean) AS m, stddev_samp(rel_mean) AS sd FROM profile) AS s""")
_add("zscore_robust", """SELECT entity, R[greatest(-4e0, least(4e0, coalesce((rel_mean - m) / CASE WHEN mad > 0 THEN 1.4826e0 * mad ELSE 1 END, 0e0)));6] AS z FROM profile CROSS JOIN (
  SELECT m, median(abs(rel_mean - m)) AS mad FROM profile CROSS JOIN (SELECT median(rel_mean) AS m FROM profile) AS c GROUP BY m) AS s""")
_add("fill_rate_columns", """SELECT 'yoy_log' AS name, R[avg(CASE WHEN yoy_log IS NOT NULL THEN 1e0 ELSE 0e0 END);6] AS rate FROM feats
  UNION ALL SELECT 'rel_level', R[avg(CASE WHEN rel_level IS NOT NULL THEN 1e0 ELSE 0e0 END);6] FROM feats""")
_add("moving_average_centred", "SELECT entity, period, R[avg(rel_level) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING);6] AS smooth FROM level")
_add("growth_demedianed", """SELECT entity, period, R[d - median(d) OVER (PARTITION BY period);6] AS growth FROM (
  SELECT entity, period, log_total - lag(log_total) OVER (PARTITION BY entity ORDER BY period) AS d FROM level) AS g WHERE d IS NOT NULL""")
# labels
_add("type_sizes", "SELECT period, label, count(*) AS n FROM labels_at GROUP BY period, label")
_add("modal_type", "SELECT entity, label FROM modal")
_add("switch_counts", "SELECT entity, CAST(sum(CASE WHEN before <> label THEN 1 ELSE 0 END) AS BIGINT) AS switches FROM steps GROUP BY entity")
_add("switches_by_period", "SELECT period, CAST(sum(CASE WHEN before <> label THEN 1 ELSE 0 END) AS BIGINT) AS switches, count(before) AS n FROM steps GROUP BY period")
_add("stability_summary", """SELECT count(*) AS entities, R[avg(CASE WHEN k = 0 THEN 1e0 ELSE 0e0 END);6] AS never, R[avg(CASE WHEN k > 3 THEN 1e0 ELSE 0e0 END);6] AS over_three FROM (
  SELECT entity, sum(CASE WHEN before <> label THEN 1 ELSE 0 END) AS k FROM steps GROUP BY entity) AS s""")
_add("run_lengths", """SELECT entity, label, min(period) AS first_period, count(*) AS length FROM (
  SELECT entity, period, label, sum(CASE WHEN before IS NULL OR before <> label THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM steps) AS r
  GROUP BY entity, island, label""")
_add("percentile_rank", """SELECT entity, R[(rank() OVER (PARTITION BY label ORDER BY rel_mean) - 1) / CAST(count(*) OVER (PARTITION BY label) AS DOUBLE);6] AS below
  FROM profile JOIN modal USING (entity)""")
_add("contingency", "SELECT m.label AS modal_label, s_nationkey % 5 AS zone, count(*) AS n FROM modal AS m JOIN {supplier} ON s_suppkey = m.entity GROUP BY 1, 2")
_add("purity", """SELECT R[sum(most) / sum(n);6] AS purity FROM (
  SELECT label, max(n) AS most, sum(n) AS n FROM (SELECT m.label, s_nationkey % 5 AS zone, count(*) AS n FROM modal AS m JOIN {supplier} ON s_suppkey = m.entity GROUP BY 1, 2) AS c GROUP BY label) AS p""")
_add("ari", """SELECT R[CASE WHEN (a + b) / 2 = a * b / n2 THEN 1e0 ELSE (nij - a * b / n2) / nullif((a + b) / 2 - a * b / n2, 0e0) END;6] AS ari FROM (
  SELECT (SELECT sum(n * (n - 1) / 2e0) FROM (SELECT count(*) AS n FROM modal JOIN {supplier} ON s_suppkey = entity GROUP BY label, s_nationkey % 5) AS x) AS nij,
    (SELECT sum(n * (n - 1) / 2e0) FROM (SELECT count(*) AS n FROM modal GROUP BY label) AS x) AS a,
    (SELECT sum(n * (n - 1) / 2e0) FROM (SELECT count(*) AS n FROM modal JOIN {supplier} ON s_suppkey = entity GROUP BY s_nationkey % 5) AS x) AS b,
    (SELECT count(*) * (count(*) - 1) / 2e0 FROM modal) AS n2) AS q""")
_add("mirkin_profile", """SELECT label, n, R[(c - g) / nullif(g, 0e0);6] AS economy FROM (SELECT label, count(*) AS n, avg(m_economy) AS c FROM profile JOIN modal USING (entity) GROUP BY label) AS t
  CROSS JOIN (SELECT avg(m_economy) AS g FROM profile) AS a""")
_add("interval_patterns", """SELECT b.label, R[b.lo;6] AS lo, R[b.hi;6] AS hi, R[b.mid;6] AS mid, R[avg(CASE WHEN o.label <> b.label THEN CASE WHEN o.x BETWEEN b.lo AND b.hi THEN 1e0 ELSE 0e0 END END);6] AS others_inside
  FROM (SELECT label, PCT[m_large;0.1] AS lo, PCT[m_large;0.9] AS hi, median(m_large) AS mid FROM profile JOIN modal USING (entity) GROUP BY label) AS b
  CROSS JOIN (SELECT label, m_large AS x FROM profile JOIN modal USING (entity)) AS o GROUP BY b.label, b.lo, b.hi, b.mid""")
_add("markov_matrix", """SELECT before AS origin, label AS target, count(*) AS n, R[count(*) / CAST(sum(count(*)) OVER (PARTITION BY before) AS DOUBLE);6] AS p FROM steps WHERE before IS NOT NULL GROUP BY before, label""")
_add("sojourn_times", """SELECT before AS label, R[1 / nullif(1 - avg(CASE WHEN before = label THEN 1e0 ELSE 0e0 END), 0e0);6] AS quarters FROM steps WHERE before IS NOT NULL GROUP BY before""")
_add("type_flows", """SELECT a.label AS origin, b.label AS target, count(*) AS n FROM labels_at AS a JOIN labels_at AS b ON a.entity = b.entity
  WHERE a.period = DATE '1996-01-01' AND b.period = DATE '1997-01-01' GROUP BY 1, 2""")
_add("history_order", """SELECT entity, label, k AS switches, row_number() OVER (ORDER BY label, k DESC, entity) AS place FROM modal
  JOIN (SELECT entity, CAST(sum(CASE WHEN before <> label THEN 1 ELSE 0 END) AS BIGINT) AS k FROM steps GROUP BY entity) AS s USING (entity)""".replace("row_number() OVER (ORDER BY label, k DESC, entity)", "CAST(row_number() OVER (ORDER BY label, k DESC, entity) AS BIGINT)"))
# aggregates and econometrics on panels
_add("group_iqr", "SELECT label, count(*) AS n, R[PCT[x;0.25];6] AS q25, R[median(x);6] AS q50, R[PCT[x;0.75];6] AS q75 FROM (SELECT label, growth AS x FROM profile JOIN modal USING (entity)) AS t GROUP BY label".replace("R[PCT[x;0.25];6]", "round(PCT[x;0.25], 6)").replace("R[PCT[x;0.75];6]", "round(PCT[x;0.75], 6)"))
_add("quantile_buckets", """SELECT bucket, count(*) AS n, R[avg(x);6] AS mean FROM (SELECT x, CASE WHEN x <= e1 THEN 1 WHEN x <= e2 THEN 2 WHEN x <= e3 THEN 3 WHEN x <= e4 THEN 4 ELSE 5 END AS bucket
  FROM (SELECT rel_mean AS x FROM profile) AS p CROSS JOIN (SELECT PCT[rel_mean;0.2] AS e1, PCT[rel_mean;0.4] AS e2, PCT[rel_mean;0.6] AS e3, PCT[rel_mean;0.8] AS e4 FROM profile) AS e) AS b GROUP BY bucket""")
_add("weighted_series", """SELECT period, R[avg(s_economy);6] AS mean_share, R[median(s_economy);6] AS median_share, R[sum(s_economy * total) / sum(total);6] AS weighted_share, R[stddev_samp(s_economy);6] AS sd FROM labels_at GROUP BY period""")
_add("within_type_sd", "SELECT period, R[avg(sd);6] AS within_sd FROM (SELECT period, label, stddev_samp(s_economy) AS sd FROM labels_at GROUP BY period, label) AS t GROUP BY period")
_add("year_end_means", "SELECT label, R[avg(CASE WHEN month(period) = 10 THEN s_large END);6] AS year_end, R[avg(CASE WHEN month(period) <> 10 THEN s_large END);6] AS rest FROM labels_at GROUP BY label")
_add("yoy_share_change", """SELECT m.label, count(*) AS n, R[median((b.s - a.s) * 100);6] AS change_pp FROM (SELECT entity, avg(s_economy) AS s FROM labels_at WHERE year(period) = 1996 GROUP BY entity) AS a
  JOIN (SELECT entity, avg(s_economy) AS s FROM labels_at WHERE year(period) = 1997 GROUP BY entity) AS b USING (entity) JOIN modal AS m USING (entity) GROUP BY m.label""")
_add("deviation_from_type", "SELECT entity, period, R[rel_level - median(rel_level) OVER (PARTITION BY label, period);6] AS deviation FROM labels_at")
_add("event_window", """SELECT s.entity, e.period AS event, s.period, R[s.rel_level;6] AS rel_level FROM (SELECT entity, min(period) AS period FROM steps WHERE before <> label GROUP BY entity) AS e
  JOIN labels_at AS s ON s.entity = e.entity AND s.period BETWEEN CAST(e.period - INTERVAL '9' MONTH AS DATE) AND CAST(e.period + INTERVAL '18' MONTH AS DATE)""")
_add("top_bottom_n", """SELECT entity, R[growth;6] AS growth FROM (SELECT *, row_number() OVER (ORDER BY growth DESC, entity) AS hi, row_number() OVER (ORDER BY growth, entity) AS lo FROM profile WHERE growth IS NOT NULL) AS r WHERE hi <= 15 OR lo <= 15""")
_add("top_n_per_group", """SELECT label, entity, CAST(place AS BIGINT) AS place FROM (SELECT label, entity, row_number() OVER (PARTITION BY label ORDER BY rel_mean DESC, entity) AS place FROM profile JOIN modal USING (entity)) AS r WHERE place <= 5""")
_add("correlation", "SELECT R[corr(m_economy, m_large);6] AS r, count(*) AS n FROM profile")
_add("eta_squared", """SELECT R[sum(n * (m - g) * (m - g)) / max(t);6] AS eta2 FROM (SELECT label, count(*) AS n, avg(rel_mean) AS m FROM profile JOIN modal USING (entity) GROUP BY label) AS x
  CROSS JOIN (SELECT avg(rel_mean) AS g, var_pop(rel_mean) * count(*) AS t FROM profile) AS y""")
# ranks of values with their ties; groups of at most five are left out; eta2 is (h - k + 1) / (n - k)
_add("kruskal_h", """, kept AS (SELECT label, growth AS x FROM profile JOIN modal USING (entity) WHERE growth IS NOT NULL AND label IN (
   SELECT label FROM profile JOIN modal USING (entity) WHERE growth IS NOT NULL GROUP BY label HAVING count(*) > 5)),
 counts AS (SELECT x, count(*) AS t FROM kept GROUP BY x), below AS (SELECT a.x, a.t, coalesce(sum(b.t), 0) AS less FROM counts AS a LEFT JOIN counts AS b ON b.x < a.x GROUP BY a.x, a.t),
 ranks AS (SELECT label, count(*) AS n, sum(less + (t + 1) / 2e0) AS r FROM kept JOIN below USING (x) GROUP BY label),
 total AS (SELECT CAST(sum(n) AS DOUBLE) AS nn, count(*) AS k, sum(r * r / n) AS q FROM ranks), ties AS (SELECT CAST(sum(t * t * t - t) AS DOUBLE) AS c FROM counts),
 h AS (SELECT nn, k, (12 / (nn * (nn + 1)) * q - 3 * (nn + 1)) / nullif(1 - c / (nn * nn * nn - nn), 0e0) AS h FROM total CROSS JOIN ties)
 SELECT CAST(nn AS BIGINT) AS n, k, R[h;6] AS h, R[(h - k + 1) / nullif(nn - k, 0e0);6] AS eta2 FROM h""")
_add("ols_two", """SELECT R[covar_samp(growth, rel_mean) / var_samp(rel_mean);6] AS slope, R[avg(growth) - covar_samp(growth, rel_mean) / var_samp(rel_mean) * avg(rel_mean);6] AS intercept, R[power(corr(growth, rel_mean), 2);6] AS r2, count(*) AS n FROM profile WHERE growth IS NOT NULL""")
_add("dispersion_ratio", """SELECT period, R[ln(first_value(h) OVER (ORDER BY period) / h);6] AS log_ratio FROM (SELECT period, avg(power(total / mean_total - 1, 2)) AS h FROM (
  SELECT period, total, avg(total) OVER (PARTITION BY period) AS mean_total FROM panel) AS x GROUP BY period) AS y""")
_add("calinski_harabasz", """SELECT R[(between_ss / (k - 1)) / (within_ss / (n - k));6] AS ch, R[k * within_ss / between_ss;6] AS wb FROM (
  SELECT count(DISTINCT label) AS k, count(*) AS n, sum(power(x - c, 2) + power(y - d, 2)) AS within_ss, sum(power(c - gx, 2) + power(d - gy, 2)) AS between_ss FROM (
    SELECT label, m_economy AS x, m_large AS y, avg(m_economy) OVER (PARTITION BY label) AS c, avg(m_large) OVER (PARTITION BY label) AS d, avg(m_economy) OVER () AS gx, avg(m_large) OVER () AS gy FROM profile JOIN modal USING (entity)) AS t) AS s""")
_add("peers", """SELECT i, j, CAST(place AS BIGINT) AS place FROM (SELECT a.entity AS i, b.entity AS j, row_number() OVER (PARTITION BY a.entity ORDER BY R[power(a.m_economy - b.m_economy, 2) + power(a.m_large - b.m_large, 2) + power(a.m_small - b.m_small, 2);12], b.entity) AS place
  FROM profile AS a JOIN modal AS la ON la.entity = a.entity JOIN modal AS lb ON lb.label = la.label JOIN profile AS b ON b.entity = lb.entity WHERE a.entity <> b.entity) AS p WHERE place <= 5""")
_add("entity_document", """SELECT entity, label, R[m_economy;6] AS economy, R[rel_mean;6] AS rel_mean, s_name AS name, n_name AS nation FROM profile JOIN modal USING (entity)
  LEFT JOIN {supplier} ON s_suppkey = entity LEFT JOIN {nation} ON n_nationkey = s_nationkey""")

QUERIES, ORACLES = BOOK.queries, BOOK.oracles
