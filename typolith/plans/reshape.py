"""Reshaping, joins, naming and text functions on panels and tables. Where the engines differ, the oracle has a text of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import panel
from .sqlpair import Book, duck_text, spark_text

PANEL = Book(panel.PREFIX, panel.ORACLE_PREFIX, panel.panel_tables)
BASE = Book()
_panel, _add = PANEL.add, BASE.add

# pivots and their inverses
_YEARS = range(1993, 1998)
_panel(
    "unstack_series",
    "SELECT entity, " + ", ".join(f"R[y{y};6] AS y{y}" for y in _YEARS) + " FROM (SELECT entity, year(period) AS y, rel_level FROM level) PIVOT (avg(rel_level) FOR y IN (" + ", ".join(f"{y} AS y{y}" for y in _YEARS) + "))",
    "SELECT entity, " + ", ".join(f"R[avg(CASE WHEN year(period) = {y} THEN rel_level END);6] AS y{y}" for y in _YEARS) + " FROM level GROUP BY entity",
)
_panel(
    "stack_long",
    "SELECT entity, period, name, R[value;6] AS value FROM level UNPIVOT INCLUDE NULLS (value FOR name IN (clr_economy AS economy, clr_large AS large, clr_other AS other))",
    " UNION ALL ".join(f"SELECT entity, period, '{c}' AS name, R[clr_{c};6] AS value FROM level" for c in ("economy", "large", "other")),
)
_add(
    "pivot_mean",
    "SELECT l_suppkey, R[a;4] AS mean_a, R[n;4] AS mean_n, R[r;4] AS mean_r FROM (SELECT l_suppkey, l_returnflag, l_extendedprice FROM {lineitem}) PIVOT (avg(l_extendedprice) FOR l_returnflag IN ('A' AS a, 'N' AS n, 'R' AS r))",
    "SELECT l_suppkey, " + ", ".join(f"R[avg(CASE WHEN l_returnflag = '{c.upper()}' THEN l_extendedprice END);4] AS mean_{c}" for c in "anr") + " FROM {lineitem} GROUP BY l_suppkey",
)
_add(
    "pivot_first_of_total",
    """SELECT nation, R[a / nullif(total, 0e0);6] AS building, R[b / nullif(total, 0e0);6] AS machinery FROM (
  SELECT c_nationkey AS nation, min_by(c_acctbal, c_custkey) FILTER (WHERE c_mktsegment = 'BUILDING') AS a, min_by(c_acctbal, c_custkey) FILTER (WHERE c_mktsegment = 'MACHINERY') AS b, sum(c_acctbal) AS total FROM {customer} GROUP BY c_nationkey) AS t""",
    """SELECT c_nationkey AS nation, R[first(c_acctbal ORDER BY c_custkey) FILTER (WHERE c_mktsegment = 'BUILDING') / nullif(sum(c_acctbal), 0e0);6] AS building,
  R[first(c_acctbal ORDER BY c_custkey) FILTER (WHERE c_mktsegment = 'MACHINERY') / nullif(sum(c_acctbal), 0e0);6] AS machinery FROM {customer} GROUP BY c_nationkey""",
)
_panel("reindex", "SELECT 1 + s_suppkey * 7 % 61 AS place, s_suppkey AS entity, R[rel_mean;6] AS rel_mean FROM {supplier} LEFT JOIN profile ON entity = s_suppkey WHERE s_suppkey <= 60")
_panel(
    "feature_concat",
    "SELECT entity, pos AS place, R[x;6] AS value FROM (SELECT p.entity, concat(array(rel_mean, rel_sd, amplitude), array(m_economy, m_large, s_acctbal)) AS block FROM profile AS p JOIN {supplier} ON s_suppkey = p.entity) LATERAL VIEW posexplode(block) AS pos, x",
    " UNION ALL ".join(f"SELECT entity, {k} AS place, R[{c};6] AS value FROM profile JOIN {{supplier}} ON s_suppkey = entity" for k, c in enumerate(("rel_mean", "rel_sd", "amplitude", "m_economy", "m_large", "s_acctbal"))),
)
_panel(
    "map_names",
    "SELECT entity, period, element_at(map(0, 'economy', 1, 'large', 2, 'medium', 3, 'promo', 4, 'small'), CAST(label AS INT)) AS name FROM labels_at",
    "SELECT entity, period, CASE label WHEN 0 THEN 'economy' WHEN 1 THEN 'large' WHEN 2 THEN 'medium' WHEN 3 THEN 'promo' WHEN 4 THEN 'small' END AS name FROM labels_at",
)
_add("guarded_fill", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN coalesce(CASE WHEN o_totalprice > 100000 THEN o_totalprice END, 0e0) ELSE CASE WHEN o_totalprice > 200000 THEN o_totalprice END END AS value FROM {orders}")

# joins and groups
_add("chosen_year_join", """SELECT s.o_custkey, s.y, s.n, R[s.total / nullif(w.whole, 0e0);6] AS share FROM (SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey, year(o_orderdate)) AS s
  JOIN (SELECT o_custkey, CAST(max(year(o_orderdate)) AS BIGINT) AS chosen FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey) AS c ON c.o_custkey = s.o_custkey AND s.y = chosen
  LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS whole FROM {orders} GROUP BY o_custkey) AS w ON w.o_custkey = s.o_custkey""")
_add("totals_left_join_shares", """SELECT c_custkey, R[c_acctbal;2] AS balance, R[urgent;6] AS urgent FROM {customer} LEFT JOIN (
  SELECT o_custkey, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1e0 ELSE 0e0 END) AS urgent FROM {orders} GROUP BY o_custkey) AS s ON o_custkey = c_custkey""")
_PAIRS = """WITH trade AS (SELECT s_nationkey AS a, c_nationkey AS b, min(l_quantity * 100 + l_linenumber) AS km FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey JOIN {supplier} ON s_suppkey = l_suppkey
    WHERE l_returnflag = 'A' AND l_discount > 0.05 GROUP BY s_nationkey, c_nationkey),
  least AS (SELECT i, j, min(km) AS km FROM (SELECT a AS i, b AS j, km FROM trade UNION ALL SELECT b, a, km FROM trade) AS x GROUP BY i, j),
  road AS (SELECT i.n_nationkey AS i, j.n_nationkey AS j, CASE WHEN i.n_nationkey = j.n_nationkey THEN 0 ELSE coalesce(km, 5000) END AS km FROM {nation} AS i CROSS JOIN {nation} AS j LEFT JOIN least ON least.i = i.n_nationkey AND least.j = j.n_nationkey)"""
_add("pair_min_symmetric", _PAIRS + " SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, R[km;4] AS km FROM road")
_add("road_gravity", _PAIRS + " SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, R[exp(-km / 700e0);6] AS s FROM road")
_add("distance_similarity", _PAIRS + ", scale AS (SELECT median(km) AS m FROM road WHERE i < j) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, R[exp(-km / m);6] AS s, R[greatest(1 - exp(-km / m), 0e0);6] AS d FROM road CROSS JOIN scale")
_add("grouped_means", "SELECT l_returnflag, l_linestatus, R[avg(l_quantity);4] AS quantity, R[avg(l_extendedprice);4] AS price, R[avg(l_discount);6] AS discount, R[avg(l_tax);6] AS tax FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
_panel("type_sizes_spine", "SELECT p.period, k.label, count(l.entity) AS n FROM (SELECT DISTINCT period FROM labels_at) AS p CROSS JOIN (SELECT DISTINCT label FROM labels_at) AS k LEFT JOIN labels_at AS l ON l.period = p.period AND l.label = k.label GROUP BY p.period, k.label")
_CROSS = "SELECT label, s_nationkey % 5 AS zone, count(*) AS n FROM modal JOIN {supplier} ON s_suppkey = entity GROUP BY label, s_nationkey % 5"
_panel(
    "contingency_wide",
    f"SELECT label, coalesce(z0, 0) AS z0, coalesce(z1, 0) AS z1, coalesce(z2, 0) AS z2, coalesce(z3, 0) AS z3, coalesce(z4, 0) AS z4 FROM (SELECT label, zone, n FROM ({_CROSS})) PIVOT (max(n) FOR zone IN (0 AS z0, 1 AS z1, 2 AS z2, 3 AS z3, 4 AS z4))",
    "SELECT label, " + ", ".join(f"CAST(sum(CASE WHEN zone = {z} THEN n ELSE 0 END) AS BIGINT) AS z{z}" for z in range(5)) + f" FROM ({_CROSS}) AS c GROUP BY label",
)
_panel("purity_both", f"SELECT 'row' AS side, label AS key, R[max(n) / CAST(sum(n) AS DOUBLE);6] AS purity FROM ({_CROSS}) AS c GROUP BY label UNION ALL SELECT 'column', zone, R[max(n) / CAST(sum(n) AS DOUBLE);6] FROM ({_CROSS}) AS c GROUP BY zone")
_panel("parent_type", f"SELECT zone, label AS parent, n FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY n DESC, label) AS k FROM ({_CROSS}) AS c) AS r WHERE k = 1")
_panel("layer_counts", "SELECT label, count(*) AS n FROM labels_at WHERE period = DATE '1996-01-01' AND label NOT IN (2, 3) GROUP BY label")
_panel(
    "best_model",
    "SELECT max_by(label, struct(score, -label)) AS best, R[max(score);6] AS score FROM (SELECT label, avg(rel_level) AS score FROM labels_at GROUP BY label)",
    "SELECT label AS best, R[score;6] AS score FROM (SELECT label, avg(rel_level) AS score FROM labels_at GROUP BY label) AS s ORDER BY score DESC, label LIMIT 1",
)
_panel("top_by_absolute", "SELECT entity, period, R[rel_level;6] AS rel_level FROM (SELECT entity, period, rel_level, row_number() OVER (PARTITION BY entity ORDER BY abs(rel_level) DESC, period) AS k FROM level) AS r WHERE k <= 8")
_panel("cluster_jaccard", f""", c AS ({_CROSS}), a AS (SELECT label, sum(n) AS a FROM c GROUP BY label), b AS (SELECT zone, sum(n) AS b FROM c GROUP BY zone)
 SELECT label, R[max(n / CAST(a + b - n AS DOUBLE));6] AS jaccard FROM c JOIN a USING (label) JOIN b USING (zone) GROUP BY label""")
# edges of a year join a supplier's nation with a customer's; two years without edges are alike
_add("edge_jaccard_years", """WITH e AS (SELECT DISTINCT year(o_orderdate) AS y, least(s_nationkey, c_nationkey) AS i, greatest(s_nationkey, c_nationkey) AS j FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey
    JOIN {supplier} ON s_suppkey = l_suppkey WHERE s_nationkey <> c_nationkey AND l_quantity > 48 AND l_returnflag = 'R'),
  spine AS (SELECT DISTINCT year(o_orderdate) AS y FROM {orders}), n AS (SELECT y, count(*) AS n FROM e GROUP BY y),
  shared AS (SELECT a.y, count(*) AS n FROM e AS a JOIN e AS b ON a.y = b.y + 1 AND a.i = b.i AND a.j = b.j GROUP BY a.y)
  SELECT CAST(s.y AS BIGINT) AS y, R[CASE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) = 0 THEN 1e0 ELSE coalesce(shared.n, 0) / CAST(coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(shared.n, 0) AS DOUBLE) END;6] AS jaccard
  FROM spine AS s JOIN spine AS before ON before.y = s.y - 1 LEFT JOIN n AS a ON a.y = s.y LEFT JOIN n AS b ON b.y = before.y LEFT JOIN shared ON shared.y = s.y""")

# text, dates and codes
# the first three letters of translate's list look like Latin ones
_SECTION = "SELECT p_partkey, regexp_extract(p_type, '^([A-Z]+)', 1) AS section, substring(lower(regexp_replace(translate(replace(p_name, 'a', 'а'), 'авс', 'abc'), '[^A-Za-z0-9]+', '_'ALL)), 1, 30) AS slug FROM {part}"
_add("section_key", _SECTION.replace("ALL", ""), _SECTION.replace("ALL", ", 'g'"))
_add(
    "text_parts",
    "SELECT p_partkey, contains(p_name, 'ring') AS has_ring, replace(p_name, ' ', '-') AS dashed, startswith(p_name, 'small') AS small, substring(p_name, 2, 5) AS part, length(p_name) AS n FROM {part}",
    "SELECT p_partkey, contains(p_name, 'ring') AS has_ring, replace(p_name, ' ', '-') AS dashed, starts_with(p_name, 'small') AS small, substring(p_name, 2, 5) AS part, CAST(length(p_name) AS INTEGER) AS n FROM {part}",
)
_panel(
    "label_sequence",
    "SELECT entity, lpad(array_join(transform(array_sort(collect_list(struct(period, label))), x -> CAST(x.label AS STRING)), ''), 32, '0') AS history FROM labels_at GROUP BY entity",
    "SELECT entity, lpad(string_agg(CAST(label AS STRING), '' ORDER BY period), 32, '0') AS history FROM labels_at GROUP BY entity",
)
_add("search_folded", """SELECT p_partkey, score FROM (SELECT p_partkey, p_retailprice, CASE WHEN name = q THEN 3 WHEN name LIKE concat(q, '%') THEN 2 WHEN name LIKE concat('%', q, '%') THEN 1 ELSE 0 END AS score
  FROM (SELECT p_partkey, p_retailprice, replace(lower(p_name), 'ё', 'е') AS name FROM {part}) AS p CROSS JOIN (SELECT replace(lower('RED'), 'ё', 'е') AS q) AS q) AS s WHERE score > 0 ORDER BY score DESC, p_retailprice DESC, p_partkey LIMIT 8""")
_add(
    "date_parts",
    "SELECT o_orderkey, date_format(d, 'yyyy-MM') AS month, year(d) AS y, month(d) AS m, to_date(concat(date_format(d, 'yyyy-MM'), '-01'), 'yyyy-MM-dd') AS first_day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM {orders})",
    "SELECT o_orderkey, strftime(d, '%Y-%m') AS month, CAST(year(d) AS INTEGER) AS y, CAST(month(d) AS INTEGER) AS m, CAST(strptime(concat(strftime(d, '%Y-%m'), '-01'), '%Y-%m-%d') AS DATE) AS first_day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM {orders}) AS o",
)
_add("factorize", "SELECT p_partkey, p_type, code FROM {part} JOIN (SELECT p_type AS t, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS BIGINT) AS code FROM {part} GROUP BY p_type) AS f ON t = p_type")
_add(
    "json_round_trip",
    "SELECT id, text, back.name AS name, back.tags[1] AS second FROM (SELECT id, text, from_json(text, 'id BIGINT, name STRING, tags ARRAY<STRING>') AS back FROM (SELECT c_custkey AS id, to_json(named_struct('id', c_custkey, 'name', c_name, 'tags', array(c_mktsegment, c_name))) AS text FROM {customer}))",
    "SELECT id, text, json_extract_string(text, '$.name') AS name, json_extract_string(text, '$.tags[1]') AS second FROM (SELECT c_custkey AS id, CAST(to_json({'id': c_custkey, 'name': c_name, 'tags': [c_mktsegment, c_name]}) AS VARCHAR) AS text FROM customer) AS t",
)
_add(
    "map_lookup",
    "SELECT c_custkey, coalesce(try_element_at(map_from_arrays(array('BUILDING', 'MACHINERY', 'FURNITURE'), array(1, 2, 3)), c_mktsegment), -1) AS code FROM {customer}",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'FURNITURE' THEN 3 ELSE -1 END AS code FROM {customer}",
)
_panel("auto_name", "SELECT entity, CASE WHEN rel_mean > 0.1 AND m_economy > 0.17 THEN 'large, economy' WHEN rel_mean > 0.1 THEN 'large' WHEN growth < 0 THEN 'shrinking' WHEN m_large >= greatest(m_economy, m_small) THEN 'large goods' ELSE 'even' END AS name FROM profile")
_panel("static_attributes", """SELECT entity, R[ln(greatest(s_acctbal, 100e0));6] AS log_balance, R[ln(greatest(coalesce(orders, 0), 1e0));6] AS log_orders, R[ln(greatest(price, 1000e0));6] AS log_price,
  R[CASE WHEN big IS NULL AND small IS NULL THEN NULL ELSE coalesce(big, 0) + coalesce(small, 0) END;4] AS units FROM profile JOIN {supplier} ON s_suppkey = entity LEFT JOIN (
  SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS orders, max(l_extendedprice) AS price, sum(CASE WHEN l_quantity > 45 THEN l_quantity END) AS big, sum(CASE WHEN l_quantity < 5 THEN l_quantity END) AS small FROM {lineitem} GROUP BY l_suppkey) AS x ON l_suppkey = entity""")
_panel(
    "entity_passport",
    """SELECT p.entity, to_json(named_struct('name', s_name, 'label', m.label, 'history', h.history, 'shares', map('economy', CAST(round(m_economy * 1000) AS BIGINT), 'large', CAST(round(m_large * 1000) AS BIGINT)))) AS passport
  FROM profile AS p JOIN modal AS m ON m.entity = p.entity JOIN {supplier} ON s_suppkey = p.entity JOIN (SELECT entity, transform(array_sort(collect_list(struct(period, label))), x -> x.label) AS history FROM labels_at GROUP BY entity) AS h ON h.entity = p.entity""",
    """SELECT p.entity, concat('{"name":"', s_name, '","label":', m.label, ',"history":[', h.history, '],"shares":{"economy":', CAST(round(m_economy * 1000) AS BIGINT), ',"large":', CAST(round(m_large * 1000) AS BIGINT), '}}') AS passport
  FROM profile AS p JOIN modal AS m ON m.entity = p.entity JOIN {supplier} ON s_suppkey = p.entity JOIN (SELECT entity, string_agg(CAST(label AS VARCHAR), ',' ORDER BY period) AS history FROM labels_at GROUP BY entity) AS h ON h.entity = p.entity""",
)
_panel("shock_case", """, event AS (SELECT entity, min(period) AS at FROM steps WHERE before <> label GROUP BY entity), dev AS (SELECT l.entity, l.period, l.label, l.rel_level, l.rel_level - mid AS deviation FROM labels_at AS l JOIN (
   SELECT label, period, median(rel_level) AS mid FROM labels_at GROUP BY label, period) AS t ON t.label = l.label AND t.period = l.period)
 SELECT e.entity, e.at, d.label, R[d.rel_level;6] AS rel_level, R[f.yoy_log;6] AS yoy, R[d.deviation;6] AS deviation FROM event AS e JOIN dev AS d ON d.entity = e.entity AND d.period = e.at JOIN feats AS f ON f.entity = e.entity AND f.period = e.at""")
_panel("cluster_means", "SELECT k.label, f.name, R[coalesce(avg(x), 0e0);6] AS mean FROM (SELECT 0 AS label UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 9) AS k CROSS JOIN (SELECT 'economy' AS name UNION ALL SELECT 'large') AS f LEFT JOIN (SELECT label AS l, 'economy' AS n, m_economy AS x FROM profile JOIN modal USING (entity) UNION ALL SELECT label, 'large', m_large FROM profile JOIN modal USING (entity)) AS v ON l = k.label AND n = f.name GROUP BY k.label, f.name")
_panel("robust_variance", """, c AS (SELECT label, median(growth) AS m FROM profile JOIN modal USING (entity) WHERE growth IS NOT NULL GROUP BY label), d AS (SELECT label, m, 3 * 1.4826e0 * median(abs(growth - m)) AS reach FROM profile JOIN modal USING (entity) JOIN c USING (label) WHERE growth IS NOT NULL GROUP BY label, m)
 SELECT label, count(*) AS n, R[var_samp(greatest(m - reach, least(m + reach, growth)));8] AS variance FROM profile JOIN modal USING (entity) JOIN d USING (label) WHERE growth IS NOT NULL GROUP BY label""")
_panel("before_after", """, a AS (SELECT entity, label FROM labels_at WHERE period = DATE '1996-01-01'), b AS (SELECT entity, label FROM labels_at WHERE period = DATE '1997-01-01')
 SELECT count(*) AS n, CAST(sum(CASE WHEN a.label = b.label THEN 1 ELSE 0 END) AS BIGINT) AS same, R[avg(CASE WHEN a.label = b.label THEN 1e0 ELSE 0e0 END);6] AS share, count(DISTINCT a.label) AS types_before, count(DISTINCT b.label) AS types_after FROM a JOIN b USING (entity)""")


def fill_rate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, period, name, value) of the numeric columns whose share of values is over 0.9."""
    feats = spark.sql(spark_text(panel.PREFIX + "SELECT entity, period, rel_level, yoy_log, CASE WHEN s_large > 0.2 THEN s_large END AS big_large FROM feats"), **panel.panel_tables(spark, sf_dir))
    names = ("rel_level", "yoy_log", "big_large")
    rates = feats.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in names]).first()
    kept = [c for c in names if (rates[c] or 0) > 0.9]
    return feats.select("entity", "period", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), (F.round(c, 6) + F.lit(0e0)).alias("value")) for c in kept])).alias("x")).select("entity", "period", "x.name", "x.value")


_LONG = "SELECT entity, period, 'rel_level' AS name, rel_level AS value FROM feats UNION ALL SELECT entity, period, 'yoy_log', yoy_log FROM feats UNION ALL SELECT entity, period, 'big_large', CASE WHEN s_large > 0.2 THEN s_large END FROM feats"
QUERIES = PANEL.queries | BASE.queries | {"fill_rate_selection": fill_rate_selection}
ORACLES = PANEL.oracles | BASE.oracles | {
    "fill_rate_selection": duck_text(panel.ORACLE_PREFIX + f", x AS ({_LONG}) SELECT entity, period, name, R[value;6] AS value FROM x WHERE name IN (SELECT name FROM x GROUP BY name HAVING avg(CASE WHEN value IS NULL THEN 0e0 ELSE 1e0 END) > 0.9)")
}
