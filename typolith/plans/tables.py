"""Scans, joins, text functions, pairs and graphs over the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbours
from ..session import materialise
from .sqlpair import Book, duck_text, spark_text

BOOK = Book()
_add = BOOK.add

# scans, text and keys
_add("scan_cast", "SELECT CAST(l_suppkey AS BIGINT) AS entity, CAST(l_shipdate AS DATE) AS day, R[l_extendedprice;2] AS value FROM {lineitem} WHERE l_returnflag = 'R'")
_add("text_number_parse", "SELECT o_orderkey, R[TRY_CAST(replace(replace(CAST(o_totalprice AS STRING), '.', ','), ',', '.') AS DOUBLE);2] AS value FROM {orders} WHERE o_orderpriority = '5-LOW'")
_add("substring_filter", "SELECT p_partkey, p_name FROM {part} WHERE coalesce(p_name LIKE '%ring%', false)")
_add("padded_key", "SELECT s_suppkey, lpad(substring(replace(CAST(s_suppkey AS STRING), '-', ''), 1, 8), 8, '0') AS key8 FROM {supplier}")
_add("ranked_search", """SELECT p_partkey, p_name, score FROM (SELECT p_partkey, p_name, p_retailprice, CASE WHEN lower(p_name) LIKE 'small%' THEN 2 WHEN lower(p_name) LIKE '%small%' THEN 1 ELSE 0 END AS score FROM {part}) AS s
  WHERE score > 0 ORDER BY score DESC, p_retailprice DESC, p_partkey LIMIT 8""")
_add("unique_suffix", "SELECT n_nationkey, CASE WHEN k = 1 THEN z ELSE concat(z, ' (', CAST(k AS STRING), ')') END AS name FROM (SELECT n_nationkey, concat('zone ', CAST(n_regionkey AS STRING)) AS z, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM {nation}) AS t")
_add("value_counts", "SELECT p_type, count(*) AS n FROM {part} GROUP BY p_type")
_add("count_distinct", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations FROM {customer} GROUP BY c_mktsegment")
_add("fill_median", "SELECT s_suppkey, R[coalesce(CASE WHEN s_acctbal >= 0 THEN s_acctbal END, m);4] AS balance FROM {supplier} CROSS JOIN (SELECT median(CASE WHEN s_acctbal >= 0 THEN s_acctbal END) AS m FROM {supplier}) AS c")
_add("conditional_annual", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS has FROM {orders}) AS o WHERE (has = 1 AND o_orderpriority = '1-URGENT') OR has = 0")
# versions and joins
_add("latest_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM {orders}) AS o WHERE k = 1")
_add("preferred_year", """SELECT o_custkey, y FROM (SELECT o_custkey, year(o_orderdate) AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE year(o_orderdate) WHEN 1997 THEN 1 WHEN 1996 THEN 2 WHEN 1995 THEN 3 END, o_orderkey) AS k
  FROM {orders} WHERE year(o_orderdate) IN (1995, 1996, 1997)) AS o WHERE k = 1""".replace("SELECT o_custkey, y FROM", "SELECT o_custkey, CAST(y AS BIGINT) AS picked FROM"))
_add("version_pick", """WITH v AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS year_from, coalesce(lead(year(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 9999) AS year_to FROM {orders}),
  valid AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM v WHERE year_from <= 1998 AND 1998 < year_to GROUP BY o_custkey)
  SELECT o_custkey, o_orderkey, 'valid' AS kind FROM valid UNION ALL
  SELECT o_custkey, max(o_orderkey), 'latest' FROM v WHERE NOT EXISTS (SELECT 1 FROM valid WHERE valid.o_custkey = v.o_custkey) GROUP BY o_custkey""")
_add("semi_filter", "SELECT c_custkey, c_nationkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_add("anti_union", "SELECT c_custkey AS id, 'no order' AS kind FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey) UNION ALL SELECT s_suppkey, 'supplier' FROM {supplier} WHERE s_acctbal < 0")
_add("star_left_join", "SELECT s_suppkey, R[s_acctbal;2] AS balance, n_name, r_name FROM {supplier} LEFT JOIN {nation} ON s_nationkey = n_nationkey LEFT JOIN {region} ON n_regionkey = r_regionkey")
_add("unique_name_join", """SELECT n_name, s_suppkey, regions FROM (SELECT n_name, n_nationkey, n_regionkey, count(*) OVER (PARTITION BY n_name) AS same FROM {nation}) AS n
  JOIN {supplier} ON s_nationkey = n_nationkey JOIN (SELECT r_regionkey, count(*) OVER (PARTITION BY r_name) AS regions FROM {region}) AS r ON r_regionkey = n_regionkey WHERE same = 1 AND regions = 1""")
_add("pivot_first_share", """SELECT nation, R[low / nullif(total, 0e0);6] AS low_share, R[high / nullif(total, 0e0);6] AS high_share FROM (SELECT c_nationkey AS nation, CAST(count(*) AS DOUBLE) AS total,
  CAST(count(CASE WHEN c_acctbal < 0 THEN 1 END) AS DOUBLE) AS low, CAST(count(CASE WHEN c_acctbal > 5000 THEN 1 END) AS DOUBLE) AS high FROM {customer} GROUP BY c_nationkey) AS t""")
_add("event_transitions", "SELECT origin, target, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS origin, event_type AS target FROM {events}) AS e WHERE origin IS NOT NULL GROUP BY origin, target")
_add("label_contingency", "SELECT CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, count(*) AS n FROM {labels} GROUP BY quality, toxic")

# vectors and graphs; edges go both ways
K, K_WIDE = 15, 50
_PAIRS_DUCK = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 sims AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id),
 near AS MATERIALIZED (SELECT i, j, li, lj, s FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS k FROM sims) AS r WHERE k <= 15),"""
_MUTUAL = "SELECT a.i, a.j, a.li, a.lj, greatest(a.s, 1e-9) AS w FROM {near} AS a JOIN {near} AS b ON a.i = b.j AND a.j = b.i"


def graph_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The K nearest of every vector, and the edges of the mutual graph; both are written once for a query."""
    near = materialise(neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), K), "near")
    return {"near": near, "mutual": materialise(spark.sql(_MUTUAL, near=near), "mutual")}


_GRAPH_DUCK = """ mutual AS MATERIALIZED (SELECT a.i, a.j, a.li, a.lj, greatest(a.s, 1e-9) AS w FROM near AS a JOIN near AS b ON a.i = b.j AND a.j = b.i),
 degree AS (SELECT i, count(*) AS d, sum(w) AS strength FROM mutual GROUP BY i)
"""
_GRAPH = "WITH near AS (SELECT * FROM {near}), mutual AS (SELECT * FROM {mutual}), degree AS (SELECT i, count(*) AS d, sum(w) AS strength FROM {mutual} GROUP BY i)\n"
_edges = Book(_GRAPH, _PAIRS_DUCK + _GRAPH_DUCK, graph_tables)
_graph = _edges.add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _shown(pairs: DataFrame, value: str = "s") -> DataFrame:
    return pairs.select("i", "j", (F.round("s", 6) + F.lit(0e0)).alias(value))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(neighbours.similar(_vectors(spark, sf_dir), 0.4))


def epsilon_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many of the most similar pairs as the mutual graph has edges."""
    edges = graph_tables(spark, sf_dir)["mutual"].count() // 2
    return _shown(neighbours.best_pairs(_vectors(spark, sf_dir), edges))


def disparity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the union of the K_WIDE nearest, the probability with which they stand out at either end, and whether that is under 0.05."""
    near = materialise(neighbours.nearest(_vectors(spark, sf_dir), K_WIDE), "wide")
    return spark.sql(spark_text(_DISPARITY), near=near)


_DISPARITY = """WITH e AS (SELECT i, j, max(greatest(s, 1e-9)) AS w FROM (SELECT i, j, s FROM {near} UNION ALL SELECT j, i, s FROM {near}) AS x GROUP BY i, j),
 degree AS (SELECT i, count(*) AS d, sum(w) AS strength FROM e GROUP BY i)
 SELECT i, j, R[w;6] AS w, R[p;6] AS p, p < 0.05 AS kept FROM (SELECT e.i, e.j, e.w, least(CASE WHEN a.d > 1 THEN power(1 - e.w / a.strength, a.d - 1) ELSE 1 END, CASE WHEN b.d > 1 THEN power(1 - e.w / b.strength, b.d - 1) ELSE 1 END) AS p
  FROM e JOIN degree AS a ON a.i = e.i JOIN degree AS b ON b.i = e.j WHERE e.i < e.j) AS x"""


_graph("knn_mutual", "SELECT i, j, R[w;6] AS w FROM mutual")
_graph("knn_union", "SELECT i, j, R[max(s);6] AS w FROM (SELECT i, j, s FROM near UNION ALL SELECT j, i, s FROM near) AS x GROUP BY i, j")
_graph("graph_stats", "SELECT CAST(sum(d) / 2 AS BIGINT) AS edges, R[avg(d);6] AS mean_degree, min(d) AS least, max(d) AS most FROM degree")
_graph("row_normalise", "SELECT m.i, m.j, R[m.w / a.strength;6] AS p FROM mutual AS m JOIN degree AS a ON a.i = m.i")
_graph("diffusion_two_step", """, t AS (SELECT m.i, m.j, m.w / a.strength AS p FROM mutual AS m JOIN degree AS a ON a.i = m.i)
 SELECT i, j, R[sum(p) / 2;6] AS p FROM (SELECT i, j, p FROM t UNION ALL SELECT a.i, b.j, a.p * b.p FROM t AS a JOIN t AS b ON a.j = b.i) AS x GROUP BY i, j""")
_graph("block_sums", "SELECT CAST(li AS BIGINT) AS a, CAST(lj AS BIGINT) AS b, R[sum(w);6] AS w FROM mutual GROUP BY li, lj")
_graph("modularity", """SELECT R[sum(inside / m2 - power(total / m2, 2));6] AS q FROM (SELECT li, sum(CASE WHEN li = lj THEN w ELSE 0e0 END) AS inside, sum(w) AS total FROM mutual GROUP BY li) AS c
 CROSS JOIN (SELECT sum(w) AS m2 FROM mutual) AS t""")
_graph("mean_conductance", "SELECT R[avg(1 - inside / total);6] AS conductance FROM (SELECT li, sum(CASE WHEN li = lj THEN w ELSE 0e0 END) AS inside, sum(w) AS total FROM mutual GROUP BY li) AS c")
_graph("edge_jaccard", """SELECT R[sum(CASE WHEN n = 2 THEN 1e0 ELSE 0e0 END) / count(*);6] AS jaccard FROM (SELECT i, j, count(*) AS n FROM (
 SELECT DISTINCT i, j, 1 AS g FROM mutual WHERE i < j UNION ALL SELECT DISTINCT i, j, 2 FROM near WHERE i < j) AS e GROUP BY i, j) AS x""")
_graph("local_clustering", """SELECT d.i, R[CASE WHEN d.d < 2 THEN 0e0 ELSE coalesce(t.n, 0) / (d.d * (d.d - 1e0)) END;6] AS c FROM degree AS d LEFT JOIN (
 SELECT a.i, count(*) AS n FROM mutual AS a JOIN mutual AS b ON a.i = b.i AND a.j <> b.j JOIN mutual AS c ON c.i = a.j AND c.j = b.j GROUP BY a.i) AS t ON t.i = d.i""")
_graph("same_label_share", "SELECT R[avg(CASE WHEN li = lj THEN 1e0 ELSE 0e0 END);6] AS share FROM mutual")
_graph("degree_assortativity", "SELECT R[corr(a.d, b.d);6] AS r FROM mutual AS m JOIN degree AS a ON a.i = m.i JOIN degree AS b ON b.i = m.j")

QUERIES = BOOK.queries | _edges.queries | {"cosine_pairs": cosine_pairs, "epsilon_edges": epsilon_edges, "disparity_edges": disparity_edges}
ORACLES = BOOK.oracles | _edges.oracles | {
    "cosine_pairs": duck_text(_PAIRS_DUCK[:-1] + " SELECT i, j, R[s;6] AS s FROM sims WHERE i < j AND s > 0.4"),
    "epsilon_edges": duck_text(_PAIRS_DUCK + _GRAPH_DUCK + "SELECT i, j, R[s;6] AS s FROM (SELECT i, j, s, row_number() OVER (ORDER BY s DESC, i, j) AS k FROM sims WHERE i < j) AS r WHERE k <= (SELECT count(*) / 2 FROM mutual)"),
    "disparity_edges": duck_text(_PAIRS_DUCK.replace("k <= 15", f"k <= {K_WIDE}") + _DISPARITY.replace("WITH ", " ", 1).replace("{near}", "near")),
}
