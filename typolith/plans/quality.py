"""Quality of clusterings and graphs, agreement of labellings, transitions given neighbours, similarity of series.

Tables with a row for each pair of labels (and period) are small and may come to the driver; all that grows with entities stays distributed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement, neighbours, warping
from ..session import materialise
from . import panel
from .sqlpair import Book, duck_text, spark_text
from .tables import _GRAPH, _GRAPH_DUCK, _PAIRS_DUCK, graph_tables

PANEL = Book(panel.PREFIX, panel.ORACLE_PREFIX, panel.panel_tables)
GRAPH = Book(_GRAPH, _PAIRS_DUCK + _GRAPH_DUCK, graph_tables)
QUERIES, ORACLES = {}, {}
_SHARES = ", ".join(f"m_{c}" for c in panel._ALL)


def _query(oracle: str | None = None):
    """Registers a function under its name, with SQL that gives the same."""

    def add(run):
        QUERIES[run.__name__] = run
        if oracle is not None:
            ORACLES[run.__name__] = duck_text(oracle)
        return run

    return add


def _on_panel(spark: SparkSession, sf_dir: str, sql: str, **more: DataFrame) -> DataFrame:
    return spark.sql(spark_text(panel.PREFIX + sql), **panel.panel_tables(spark, sf_dir), **more)


def _six(column: str) -> str:
    return f"round(CAST({column} AS DOUBLE), 6) + 0e0 AS {column}"


# clusters in features
_PROFILES = f"SELECT entity, label, array({_SHARES}) AS x FROM profile JOIN modal USING (entity)"
_SILHOUETTE = """own AS (SELECT id, total / n AS a FROM d WHERE own = label AND n > 0), other AS (SELECT id, min(total / n) AS b FROM d WHERE own <> label GROUP BY id)
 SELECT count(*) AS n, R[avg(CASE WHEN a IS NULL THEN 0e0 ELSE (b - a) / nullif(greatest(a, b), 0e0) END);6] AS silhouette FROM other LEFT JOIN own USING (id)"""
_FAR = " + ".join(f"power(a.m_{c} - b.m_{c}, 2)" for c in panel._ALL)


@_query(panel.ORACLE_PREFIX + f""", p AS (SELECT * FROM profile JOIN modal USING (entity)), d AS (SELECT a.entity AS id, a.label AS own, b.label, sum(sqrt({_FAR})) AS total, count(*) AS n
 FROM p AS a JOIN p AS b ON a.entity <> b.entity GROUP BY a.entity, a.label, b.label), """ + _SILHOUETTE)
def silhouette_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean silhouette of the modal types, by Euclidean distance of mean shares; a type of one entity counts as zero."""
    profiles = materialise(_on_panel(spark, sf_dir, _PROFILES), "profiles")
    return spark.sql(spark_text("WITH d AS (SELECT * FROM {d}), " + _SILHOUETTE), d=materialise(neighbours.label_distances(profiles, "entity", "x", "label"), "distances"))


# clusters in graphs
_BLOCKS = """, s AS (SELECT li AS a, lj AS b, sum(w) AS w FROM mutual GROUP BY li, lj), r AS (SELECT a, sum(w) AS total, sum(CASE WHEN a = b THEN w ELSE 0e0 END) AS inside FROM s GROUP BY a),
 size AS (SELECT li AS a, count(DISTINCT i) AS n FROM near GROUP BY li), k AS (SELECT count(*) AS k, sum(total) AS m2 FROM r),
 u AS (SELECT sum(s.w / nullif(x.total - x.inside + y.total - y.inside - s.w, 0e0)) AS u FROM s JOIN r AS x ON x.a = s.a JOIN r AS y ON y.a = s.b WHERE s.a <> s.b),
 g AS (SELECT max(k) AS k, coalesce(max(u), 0e0) / max(k) AS avu, avg(inside / nullif(total, 0e0)) AS avi, sum(inside / m2 - power(total / m2, 2)) AS q, sum((inside / 2 - power(total, 2) / (2 * m2)) / size.n) AS dq,
  sum(coalesce((inside / 2) / nullif(inside / 2 + 0.5e0 * (total - inside), 0e0), 0e0)) AS mq, avg(1 - inside / total) AS conductance FROM r JOIN size USING (a) CROSS JOIN k CROSS JOIN u)"""
GRAPH.add("graph_quality", _BLOCKS + " SELECT k, R[avi;6] AS avi, R[avu;6] AS avu, R[CASE WHEN avi <> 0 THEN 1 / (avu + 1 / avi) ELSE 0e0 END;6] AS anui, R[q;6] AS modularity, R[dq;6] AS density_modularity, R[mq;6] AS mq, R[conductance;6] AS conductance FROM g")
GRAPH.add("sub_graph", "SELECT i, j, R[w;6] AS w FROM mutual WHERE i IN (SELECT vec_id FROM {embeddings} WHERE label IN (0, 1, 2)) AND j IN (SELECT vec_id FROM {embeddings} WHERE label IN (0, 1, 2))")
_REPAIRED = """, lone AS (SELECT i, j, greatest(s, 1e-9) AS w FROM (SELECT n.i, n.j, n.s, row_number() OVER (PARTITION BY n.i ORDER BY n.s DESC, n.j) AS k FROM near AS n LEFT JOIN degree AS d ON d.i = n.i WHERE d.i IS NULL) AS x WHERE k = 1),
 whole AS (SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM mutual UNION ALL SELECT i, j, w FROM lone UNION ALL SELECT j, i, w FROM lone) AS x GROUP BY i, j)"""
GRAPH.add("knn_without_isolates", _REPAIRED + " SELECT i, j, R[w;6] AS w FROM whole")
GRAPH.add("graph_stats_spine", """, spine AS (SELECT n.i, coalesce(max(d.d), 0) AS d FROM near AS n LEFT JOIN degree AS d ON d.i = n.i GROUP BY n.i)
 SELECT count(*) AS nodes, CAST(sum(d) / 2 AS BIGINT) AS edges, R[avg(d);6] AS mean_degree, min(d) AS least, max(d) AS most, CAST(sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS isolates, max(weight) AS weight_median, max(top) AS weight_most
 FROM spine CROSS JOIN (SELECT R[median(w);6] AS weight, R[max(w);6] AS top FROM mutual WHERE i < j) AS w""")
GRAPH.add("similarity_distance", "SELECT i, j, R[greatest(1 - s, 0e0);6] AS d FROM near")
_REACH = "near_edges AS (SELECT i, j FROM sims WHERE s > 0.4), walk AS (SELECT i AS node, j AS seen FROM near_edges UNION SELECT w.node, e.j FROM walk AS w JOIN near_edges AS e ON e.i = w.seen), part AS (SELECT node, least(node, min(seen)) AS label FROM walk GROUP BY node)"


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.components(neighbours.similar(vectors, 0.4).select("i", "j"))


@_query(_PAIRS_DUCK.replace("WITH v", "WITH RECURSIVE v") + _REACH + " SELECT node, label FROM part")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, label) of the graph of similar vectors: the smallest node that each reaches."""
    return _components(spark, sf_dir)


_COMMUNITY = """SELECT community, CAST(sum(n) AS BIGINT) AS size, min(CASE WHEN k = 1 THEN label END) AS dominant, R[max(CASE WHEN k = 1 THEN n END) / CAST(sum(n) AS DOUBLE);6] AS share FROM (
 SELECT p.label AS community, CAST(e.label AS BIGINT) AS label, count(*) AS n, row_number() OVER (PARTITION BY p.label ORDER BY count(*) DESC, e.label) AS k FROM @of AS p JOIN {embeddings} AS e ON e.vec_id = p.node GROUP BY p.label, e.label) AS x GROUP BY community"""


@_query(_PAIRS_DUCK.replace("WITH v", "WITH RECURSIVE v") + _REACH + " " + _COMMUNITY.replace("@of", "part"))
def community_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, commonest label (the smaller of equals) and its share of every community."""
    text = spark_text(_COMMUNITY.replace("@of", "{part_of}"))
    return spark.sql(text, part_of=_components(spark, sf_dir), embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# agreement of two labellings
def scores(counts: np.ndarray) -> tuple[float, float, float]:
    """(ARI, AMI, NMI) of a contingency table; two labellings of one class each agree fully. Means of entropies are arithmetic."""
    n, a, b = counts.sum(), counts.sum(axis=1), counts.sum(axis=0)
    pairs = lambda v: float((v * (v - 1) / 2).sum())
    expected, middle = pairs(a) * pairs(b) / max(n * (n - 1) / 2, 1), (pairs(a) + pairs(b)) / 2
    ari = 1.0 if middle == expected else (pairs(counts) - expected) / (middle - expected)
    entropy = lambda v: -float(sum(x / n * math.log(x / n) for x in v if x))
    shared = entropy(a) + entropy(b) - entropy(counts.ravel())
    chance = 0.0
    for x in a:
        for y in b:
            for k in range(max(1, int(x + y - n)), int(min(x, y)) + 1):
                ways = sum(math.lgamma(v + 1) for v in (x, y, n - x, n - y)) - sum(math.lgamma(v + 1) for v in (n, k, x - k, y - k, n - x - y + k))
                chance += k / n * math.log(n * k / (x * y)) * math.exp(ways)
    mean = (entropy(a) + entropy(b)) / 2
    return float(ari), 1.0 if mean == chance else float((shared - chance) / (mean - chance)), 1.0 if mean == 0 else float(shared / mean)


_SCORES = """n AS (SELECT g, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY g), a AS (SELECT g, x, CAST(sum(n) AS DOUBLE) AS a FROM c GROUP BY g, x), b AS (SELECT g, y, CAST(sum(n) AS DOUBLE) AS b FROM c GROUP BY g, y),
 ha AS (SELECT g, -sum(a / n * ln(a / n)) AS h, sum(a * (a - 1) / 2) AS p FROM a JOIN n USING (g) GROUP BY g), hb AS (SELECT g, -sum(b / n * ln(b / n)) AS h, sum(b * (b - 1) / 2) AS p FROM b JOIN n USING (g) GROUP BY g),
 hc AS (SELECT c.g, -sum(c.n / n.n * ln(c.n / n.n)) AS h, sum(c.n * (c.n - 1) / 2) AS p FROM c JOIN n USING (g) GROUP BY c.g),
 ways AS (SELECT g, n, a, b, CAST(unnest(range(CAST(greatest(1, a + b - n) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS DOUBLE) AS k FROM a JOIN b USING (g) JOIN n USING (g)),
 chance AS (SELECT g, sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS e FROM ways GROUP BY g),
 score AS (SELECT g, (hc.p - ha.p * hb.p / (n * (n - 1) / 2)) / ((ha.p + hb.p) / 2 - ha.p * hb.p / (n * (n - 1) / 2)) AS ari, (ha.h + hb.h - hc.h - e) / ((ha.h + hb.h) / 2 - e) AS ami, (ha.h + hb.h - hc.h) / ((ha.h + hb.h) / 2) AS nmi
  FROM n JOIN ha USING (g) JOIN hb USING (g) JOIN hc USING (g) JOIN chance USING (g))"""
_ZONES = "SELECT 0 AS g, label AS x, s_nationkey % 5 AS y, count(*) AS n FROM modal JOIN {supplier} ON s_suppkey = entity GROUP BY 2, 3"
_MONTHS = "SELECT period AS g, before AS x, label AS y, count(*) AS n FROM steps WHERE before IS NOT NULL GROUP BY 1, 2, 3"


def _tables(rows: DataFrame) -> dict:
    """Contingency tables by group, from rows (g, x, y, n)."""
    groups: dict = {}
    for r in rows.collect():
        groups.setdefault(r["g"], []).append(r)
    out = {}
    for g, found in groups.items():
        xs, ys = sorted({r["x"] for r in found}), sorted({r["y"] for r in found})
        table = np.zeros((len(xs), len(ys)))
        for r in found:
            table[xs.index(r["x"]), ys.index(r["y"])] = r["n"]
        out[g] = table, xs, ys
    return out


@_query(panel.ORACLE_PREFIX + f", c AS ({_ZONES}), {_SCORES} SELECT R[ari;6] AS ari, R[ami;6] AS ami, R[nmi;6] AS nmi FROM score")
def agreement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARI, AMI and NMI of the modal types and the zones."""
    rows = _on_panel(spark, sf_dir, _ZONES, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    return spark.createDataFrame([tuple(round(v, 6) + 0.0 for v in scores(_tables(rows)[0][0]))], "ari double, ami double, nmi double")


@_query(panel.ORACLE_PREFIX + f""", c AS ({_MONTHS}), {_SCORES}, moved AS (SELECT g, sum(CASE WHEN x <> y THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS switched FROM c GROUP BY g), small AS (SELECT g, CAST(min(n) AS BIGINT) AS least FROM (SELECT g, y, sum(n) AS n FROM c GROUP BY g, y) AS z GROUP BY g)
 SELECT g AS period, R[ari;6] AS ari, R[ami;6] AS ami, R[switched;6] AS switched, switched > 0.1 AS event, least FROM score JOIN moved USING (g) JOIN small USING (g)""")
def stability_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of each period's types with those of the period before, the share that switched, and the smallest type."""
    out = []
    for period, (table, xs, ys) in _tables(_on_panel(spark, sf_dir, _MONTHS)).items():
        ari, ami, _ = scores(table)
        same = sum(table[xs.index(v), ys.index(v)] for v in xs if v in ys)
        switched = float(1 - same / table.sum())
        out.append((period, round(ari, 6) + 0.0, round(ami, 6) + 0.0, round(switched, 6) + 0.0, bool(switched > 0.1), int(table.sum(axis=0).min())))
    return spark.createDataFrame(out, "period date, ari double, ami double, switched double, event boolean, least long")


PANEL.add("switch_summary", """SELECT R[median(k);6] AS switches_median, max(k) AS switches_most, R[avg(CASE WHEN k = 0 THEN 1e0 ELSE 0e0 END);6] AS never, R[avg(CASE WHEN k > 3 THEN 1e0 ELSE 0e0 END);6] AS over_three FROM (
  SELECT entity, CAST(sum(CASE WHEN before <> label THEN 1 ELSE 0 END) AS BIGINT) AS k FROM steps GROUP BY entity) AS s""")


@_query(panel.ORACLE_PREFIX + " SELECT entity, period, label AS aligned FROM labels_at")
def aligned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose names were exchanged in every period, named again by the best matching with the labels they came from."""
    labels = materialise(_on_panel(spark, sf_dir, "SELECT entity, period, label, (label * 5 + 3 + month(period)) % 6 AS found FROM labels_at"), "labels")
    counts = labels.groupBy(F.col("period").alias("g"), F.col("found").alias("x"), F.col("label").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    names = [(g, x, ys[c] if c >= 0 else -1) for g, (table, xs, ys) in _tables(counts).items() for x, c in zip(xs, agreement.matching(table), strict=True)]
    named = spark.createDataFrame(names, "period date, found long, aligned long")
    return labels.join(F.broadcast(named), ["period", "found"]).select("entity", "period", "aligned")


# transitions
_STEPS = "SELECT 0 AS g, before AS x, label AS y, count(*) AS n FROM steps WHERE before IS NOT NULL GROUP BY 2, 3"


@_query(panel.ORACLE_PREFIX.replace("WITH long", "WITH RECURSIVE long") + f""", c AS ({_STEPS}), p AS (SELECT x, y, n / CAST(sum(n) OVER (PARTITION BY x) AS DOUBLE) AS p FROM c), k AS (SELECT DISTINCT y AS label FROM c),
 pi AS (SELECT 0 AS step, label, 1e0 / (SELECT count(*) FROM k) AS v FROM k UNION ALL SELECT max(step) + 1, y, sum(v * p) FROM pi JOIN p ON x = label WHERE step < 300 GROUP BY y),
 last AS (SELECT label, count(*) AS n FROM labels_at WHERE period = (SELECT max(period) FROM labels_at) GROUP BY label)
 SELECT k.label, R[coalesce(v, 0e0);5] AS stationary, R[1 / greatest(1 - coalesce(p, 0e0), 1e-9);6] AS sojourn, R[coalesce(last.n, 0) / CAST((SELECT sum(n) FROM last) AS DOUBLE);6] AS final_share
 FROM k LEFT JOIN pi ON pi.label = k.label AND step = 300 LEFT JOIN p ON x = k.label AND y = k.label LEFT JOIN last ON last.label = k.label""")
def markov_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stationary share, mean sojourn and share at the end of every type."""
    steps = materialise(_on_panel(spark, sf_dir, "SELECT entity, period, before, label FROM steps"), "steps")
    rows = spark.sql("SELECT 0 AS g, before AS x, label AS y, count(*) AS n FROM {s} WHERE before IS NOT NULL GROUP BY before, label", s=steps).collect()
    names = sorted({r["x"] for r in rows} | {r["y"] for r in rows})
    p = np.zeros((len(names), len(names)))
    for r in rows:
        p[names.index(r["x"]), names.index(r["y"])] = r["n"]
    p /= np.maximum(p.sum(axis=1, keepdims=True), 1.0)
    last = {r["label"]: r["n"] for r in spark.sql("SELECT label, count(*) AS n FROM {s} WHERE period = (SELECT max(period) FROM {s}) GROUP BY label", s=steps).collect()}
    pi, whole = agreement.stationary(p), sum(last.values())
    out = [(v, round(float(pi[k]), 5) + 0.0, round(float(1 / max(1 - p[k, k], 1e-9)), 6), round(last.get(v, 0) / whole, 6)) for k, v in enumerate(names)]
    return spark.createDataFrame(out, "label long, stationary double, sojourn double, final_share double")


_NEAR_DUCK = f""", pv AS (SELECT entity, [{_SHARES}] AS x FROM profile), ps AS (SELECT a.entity AS i, b.entity AS j, round(list_cosine_similarity(a.x, b.x), 9) AS s FROM pv AS a JOIN pv AS b ON a.entity <> b.entity),
 peer AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS k FROM ps) AS r WHERE k <= 5)"""
_AROUND = """, around AS (SELECT entity, period, label AS nearby FROM (SELECT q.i AS entity, l.period, l.label, row_number() OVER (PARTITION BY q.i, l.period ORDER BY count(*) DESC, l.label) AS k
   FROM peer AS q JOIN labels_at AS l ON l.entity = q.j GROUP BY q.i, l.period, l.label) AS x WHERE k = 1),
 given AS (SELECT nearby, before, label, count(*) AS n FROM (SELECT s.before, s.label, a.nearby FROM steps AS s JOIN (SELECT entity, period, lag(period) OVER (PARTITION BY entity ORDER BY period) AS was FROM labels_at) AS w ON w.entity = s.entity AND w.period = s.period
   JOIN around AS a ON a.entity = s.entity AND a.period = w.was WHERE s.before IS NOT NULL) AS y GROUP BY nearby, before, label),
 chance AS (SELECT nearby, before, label, n, n / CAST(sum(n) OVER (PARTITION BY nearby, before) AS DOUBLE) AS p FROM given)"""
_ATTRACTION = """, base AS (SELECT before, label, n / CAST(sum(n) OVER (PARTITION BY before) AS DOUBLE) AS p FROM (SELECT before, label, count(*) AS n FROM steps WHERE before IS NOT NULL GROUP BY before, label) AS x), k AS (SELECT CAST(count(DISTINCT label) AS DOUBLE) AS k FROM labels_at)
 SELECT c.label, R[c.p / (k - 1);6] AS attraction, R[b.p / (k - 1);6] AS base FROM (SELECT label, sum(p) AS p FROM chance WHERE nearby = label AND before <> label GROUP BY label) AS c JOIN (SELECT label, sum(p) AS p FROM base WHERE before <> label GROUP BY label) AS b USING (label) CROSS JOIN k"""


def _given_peers(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    made = panel.panel_tables(spark, sf_dir)
    vectors = spark.sql(spark_text(panel.PREFIX + f"SELECT entity, array({_SHARES}) AS x FROM profile"), **made)
    peer = materialise(neighbours.nearest(vectors, 5, "entity", "x", None).select("i", "j"), "peers")
    return spark.sql(spark_text(panel.PREFIX + ", peer AS (SELECT * FROM {peer})" + _AROUND + sql), **made, peer=peer)


@_query(panel.ORACLE_PREFIX + _NEAR_DUCK + _AROUND + " SELECT nearby, before, label, n, R[p;6] AS p FROM chance")
def spatial_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions by the commonest type (the smallest of equals) of an entity's five peers in the period before."""
    return _given_peers(spark, sf_dir, " SELECT nearby, before, label, n, R[p;6] AS p FROM chance")


@_query(panel.ORACLE_PREFIX + _NEAR_DUCK + _AROUND + _ATTRACTION)
def attraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely others turn to a type that is common around them, against how likely they do at all."""
    return _given_peers(spark, sf_dir, _ATTRACTION)


# recursion, series
PANEL.add(
    "recursive_mean",
    "SELECT entity, R[aggregate(transform(array_sort(collect_list(struct(period, rel_level))), x -> x.rel_level), 0e0, (u, r) -> 0.8e0 * u + 0.2e0 * r);6] AS state FROM level GROUP BY entity",
    "SELECT entity, R[sum(0.2e0 * power(0.8e0, back) * rel_level);6] AS state FROM (SELECT entity, rel_level, row_number() OVER (PARTITION BY entity ORDER BY period DESC) - 1 AS back FROM level) AS x GROUP BY entity",
)
_FULL = "SELECT entity, period, rel_level AS x FROM level WHERE year(period) BETWEEN 1995 AND 1996 AND entity IN (SELECT entity FROM level WHERE year(period) BETWEEN 1995 AND 1996 GROUP BY entity HAVING count(*) = 8)"
_SERIES = f"SELECT entity, transform(array_sort(collect_list(struct(period, x))), v -> v.x) AS x FROM ({_FULL}) GROUP BY entity"


def standardised(x: np.ndarray) -> np.ndarray:
    """Rows with mean 0 and standard deviation 1 (ddof 0); a constant row becomes zeros."""
    centred = x - x.mean(axis=1, keepdims=True)
    sd = np.sqrt((centred**2).mean(axis=1, keepdims=True))
    return centred / np.where(sd > 1e-12, sd, 1.0)


def pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return standardised(x) @ standardised(y).T / x.shape[1]


def lagged(x: np.ndarray, y: np.ndarray, most: int = 2) -> np.ndarray:
    """The largest correlation over shifts of up to `most` steps either way, each overlap standardised anew."""
    out = np.full((len(x), len(y)), -1.0)
    for lag in range(-most, most + 1):
        a, b = (x[:, : x.shape[1] - lag], y[:, lag:]) if lag >= 0 else (x[:, -lag:], y[:, : x.shape[1] + lag])
        out = np.maximum(out, pearson(a, b))
    return out


def _series_pairs(spark: SparkSession, sf_dir: str, measure: neighbours.Measure) -> DataFrame:
    series = materialise(_on_panel(spark, sf_dir, _SERIES), "series")
    found = neighbours.similar(series, float("-inf"), "entity", "x", None, measure=measure)
    return found.select("i", "j", (F.round("s", 6) + F.lit(0e0)).alias("s"))


@_query(panel.ORACLE_PREFIX + f", f AS ({_FULL}) SELECT a.entity AS i, b.entity AS j, R[corr(a.x, b.x);6] AS s FROM f AS a JOIN f AS b ON a.period = b.period AND a.entity < b.entity GROUP BY a.entity, b.entity")
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the levels of every two entities."""
    return _series_pairs(spark, sf_dir, pearson)


@_query(panel.ORACLE_PREFIX + f""", f AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period) AS t FROM ({_FULL}) AS x), c AS (
 SELECT a.entity AS i, b.entity AS j, b.t - a.t AS lag, corr(a.x, b.x) AS r FROM f AS a JOIN f AS b ON abs(b.t - a.t) <= 2 AND a.entity < b.entity GROUP BY a.entity, b.entity, b.t - a.t) SELECT i, j, R[greatest(max(r), -1e0);6] AS s FROM c GROUP BY i, j""")
def corr_lag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest correlation of the levels of every two entities over shifts of up to two periods."""
    return _series_pairs(spark, sf_dir, lagged)


BUCKETS = 4096


def exact_median(values: DataFrame, column: str, buckets: int = BUCKETS) -> float | None:
    """The median of a column of numbers, by counts of buckets that grow finer around it; neither rows nor distinct values are held.

    Every pass takes the bucket with the wanted rank, from its least to its largest value, as the next range.
    """
    x = F.col(column)
    n, low, high = values.agg(F.count(x), F.min(x), F.max(x)).first()
    rank, found = (n - 1) // 2, values.filter(x.isNotNull())
    while n and low < high:
        inside = found.filter((x >= low) & (x <= high))
        at = F.least(F.floor((x - F.lit(low)) / F.lit(high - low) * F.lit(float(buckets))), F.lit(buckets - 1))
        for r in sorted(inside.groupBy(at.alias("at")).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect()):
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    if not n or n % 2:
        return low
    upto, after = found.agg(F.count(F.when(x <= low, 1)), F.min(F.when(x > low, x))).first()
    return low if upto > n // 2 else (low + after) / 2


def _warped_similarity(pairs: DataFrame) -> DataFrame:
    pairs = materialise(pairs.withColumn("d", -F.col("s")), "warped")
    scale = exact_median(pairs, "d") or 1.0
    return pairs.select("i", "j", (F.round("d", 6) + F.lit(0e0)).alias("d"), (F.round(F.exp(-F.col("d") / F.lit(scale)), 6) + F.lit(0e0)).alias("s"))


@_query()
def dtw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warping distance of every two entities' standardised levels, and exp(-d / median d)."""
    return _warped_similarity(_series_pairs(spark, sf_dir, lambda x, y: warping.warped(standardised(x), standardised(y))))


@_query()
def dtw_pairs_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warping distance of every two entities' paths of (level, economy share), and exp(-d / median d)."""
    both = _FULL.replace("rel_level AS x", "rel_level AS x, s_economy AS z")
    text = f"SELECT entity, flatten(transform(array_sort(collect_list(struct(period, x, z))), v -> array(v.x, v.z))) AS x FROM ({both}) GROUP BY entity"
    series = materialise(_on_panel(spark, sf_dir, text), "paths")
    return _warped_similarity(neighbours.similar(series, float("-inf"), "entity", "x", None, measure=lambda x, y: warping.warped(x, y, dims=2)))


# regression with dummies
@_query()
def ols_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth on level, economy share and type dummies (the first type is the base), with HC1 errors and normal p values; from sums of products."""
    rows = materialise(_on_panel(spark, sf_dir, "SELECT growth AS y, rel_mean, m_economy, label FROM profile JOIN modal USING (entity) WHERE growth IS NOT NULL"), "ols")
    kinds = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]
    design = {"const": F.lit(1.0), "rel_mean": F.col("rel_mean"), "m_economy": F.col("m_economy")} | {f"type_{k}": (F.col("label") == k).cast("double") for k in kinds[1:]}
    names = list(design)
    wide = rows.select("y", *[c.alias(n) for n, c in design.items()])

    def cross(table: DataFrame, weight: Column) -> np.ndarray:
        sums = table.agg(*[F.sum(F.col(a) * F.col(b) * weight).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
        out = np.zeros((len(names), len(names)))
        for i in range(len(names)):
            for j in range(i, len(names)):
                out[i, j] = out[j, i] = sums[f"{i}_{j}"]
        return out

    xx = cross(wide, F.lit(1.0))
    sums = wide.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"), *[F.sum(F.col("y") * F.col(a)).alias(f"xy_{a}") for a in names]).first()
    beta, r2 = agreement.least_squares(xx, np.array([sums[f"xy_{a}"] for a in names]), sums["yy"], sums["y"], sums["n"])
    fitted = sum((F.col(a) * F.lit(float(b)) for a, b in zip(names, beta, strict=True)), F.lit(0.0))
    meat = cross(wide, F.pow(F.col("y") - fitted, 2))
    inverse, n = np.linalg.inv(xx), sums["n"]
    errors = np.sqrt(np.diag(inverse @ meat @ inverse) * n / (n - len(names)))
    out = [(a, round(float(b), 6) + 0.0, round(float(e), 6), round(math.erfc(abs(b / e) / math.sqrt(2)) if e else 1.0, 6), n, round(float(r2), 6)) for a, b, e in zip(names, beta, errors, strict=True)]
    return spark.createDataFrame(out, "name string, coefficient double, error double, p double, n long, r2 double")


# profiles over all shares
_LONG = " UNION ALL ".join(f"SELECT entity, '{c}' AS name, m_{c} AS x FROM profile" for c in panel._ALL)
PANEL.add("mirkin_profile_all", f", v AS ({_LONG}) SELECT t.label, t.name, t.n, R[(c - g) / nullif(g, 0e0);6] AS rule FROM (SELECT label, name, count(*) AS n, avg(x) AS c FROM v JOIN modal USING (entity) GROUP BY label, name) AS t JOIN (SELECT name, avg(x) AS g FROM v GROUP BY name) AS a USING (name)")
PANEL.add("interval_patterns_all", f""", v AS (SELECT entity, label, name, x FROM ({_LONG}) AS l JOIN modal USING (entity)), b AS (SELECT label, name, PCT[x;0.1] AS lo, PCT[x;0.9] AS hi, median(x) AS mid, avg(x) AS m, count(*) AS n FROM v GROUP BY label, name),
 kinds AS (SELECT DISTINCT label AS kind FROM modal), o AS (SELECT k.kind, v.name, v.x FROM v JOIN kinds AS k ON k.kind <> v.label)
 SELECT b.label, b.name, b.n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mid, 6) AS mid, R[avg(CASE WHEN o.x BETWEEN lo AND hi THEN 1e0 ELSE 0e0 END);6] AS others_inside, R[1 - avg(CASE WHEN o.x BETWEEN lo AND hi THEN 1e0 ELSE 0e0 END);6] AS separation
 FROM b JOIN o ON o.kind = b.label AND o.name = b.name GROUP BY b.label, b.name, b.n, lo, hi, mid""")
PANEL.add("external_validation", """, v AS (SELECT label, 'balance' AS name, s_acctbal AS x FROM modal JOIN {supplier} ON s_suppkey = entity UNION ALL SELECT label, 'growth', growth FROM profile JOIN modal USING (entity) UNION ALL SELECT label, 'level', rel_mean FROM profile JOIN modal USING (entity))
 SELECT t.name, CAST(sum(t.n) AS BIGINT) AS n, R[sum(t.n * (t.m - g.g) * (t.m - g.g)) / max(g.t);6] AS eta2 FROM (SELECT name, label, count(*) AS n, avg(x) AS m FROM v WHERE x IS NOT NULL GROUP BY name, label) AS t
 JOIN (SELECT name, avg(x) AS g, var_pop(x) * count(*) AS t FROM v WHERE x IS NOT NULL GROUP BY name) AS g ON g.name = t.name GROUP BY t.name""")
PANEL.add("wave_by_type", "SELECT period, label, count(*) AS n, R[avg(s_economy);6] AS mean_share, round(median(s_economy), 6) + 0e0 AS median_share, R[sum(s_economy * total) / sum(total);6] AS weighted_share, R[stddev_samp(s_economy);6] AS sd FROM labels_at GROUP BY period, label")
PANEL.add("yoy_by_quintile", """, d AS (SELECT a.entity, (b.s - a.s) * 100 AS change FROM (SELECT entity, avg(s_economy) AS s FROM labels_at WHERE year(period) = 1996 GROUP BY entity) AS a JOIN (SELECT entity, avg(s_economy) AS s FROM labels_at WHERE year(period) = 1997 GROUP BY entity) AS b USING (entity)),
 e AS (SELECT PCT[s_acctbal;0.2] AS e1, PCT[s_acctbal;0.4] AS e2, PCT[s_acctbal;0.6] AS e3, PCT[s_acctbal;0.8] AS e4 FROM {supplier})
 SELECT quintile, count(*) AS n, round(PCT[change;0.25], 6) AS q25, round(median(change), 6) AS q50, round(PCT[change;0.75], 6) AS q75 FROM (SELECT change, CASE WHEN s_acctbal <= e1 THEN 1 WHEN s_acctbal <= e2 THEN 2 WHEN s_acctbal <= e3 THEN 3 WHEN s_acctbal <= e4 THEN 4 ELSE 5 END AS quintile
  FROM d JOIN {supplier} ON s_suppkey = entity CROSS JOIN e) AS x GROUP BY quintile""")

QUERIES |= PANEL.queries | GRAPH.queries
ORACLES |= PANEL.oracles | GRAPH.oracles
