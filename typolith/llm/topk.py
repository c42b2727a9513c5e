"""Exact top-k inner products by a dual-tree search over cover trees.

Queries and candidates are dealt into blocks, and every pair of blocks is one unit of work. Both blocks are indexed by a cover tree. For a
query node Q and a candidate node R no pair scores more than
    q.r + |q| radius(R) + |r| radius(Q) + radius(Q) radius(R).
First every group of queries scores a small node that its centre leads to. Then both trees are descended together, and a node pair is pruned
when its bound is below the worst k-th score that any query of the group has so far. The results of the blocks are merged per query. How much is
pruned depends on the vectors: in clusters most pairs are, in noise of many dimensions few.

Vectors are turned into integers floor(scale * x), so scores are exact: sums stay under 2^53 in double precision, or else Python integers
are used.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; shorter vectors count as padded with
zeros; equal scores go to the smaller id; a query with fewer than k candidates gets all; rows with the query's own id are no
candidates of it; repeated rows are candidates each, and repeated query rows count once (of rows with one id and different vectors, the
smallest vector asks); scores beyond 64 bits are cut to that range;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

LEAF, ASK_LEAF, ASK_GROUP, MOST, FEW, BATCH, BASE = 64, 8, 256, 64, 8, 4096, 1.5
CANDIDATE_BLOCK, QUERY_BLOCK = 16_384, 4_096
_NO_ID = np.iinfo(np.int64).max


class Cover:
    """A node of a cover tree over rows of points.

    A node of level l covers its points within BASE ** l. Its children, of the largest lower level that tells points apart, are centres taken
    farthest-first until all points are within BASE ** of that level of one; so centres are farther than that from each other, and the first child
    keeps the centre. Where that takes more than MOST centres there are no clusters of that level, and the first FEW share the points, with the radius that covers them.
    """

    __slots__ = ("rows", "centre", "norm", "radius", "parts")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: int, leaf: int) -> None:
        self.rows, self.centre = rows, points[centre]
        self.norm = float(np.sqrt((self.centre**2).sum()))
        away = np.sqrt(((points[rows] - self.centre) ** 2).sum(axis=1))
        self.radius = float(away.max())
        self.parts: list[Cover] = []
        if len(rows) > leaf and self.radius > 0:
            below = BASE ** (math.ceil(math.log(self.radius, BASE)) - 1)
            heads, owner, near = [centre], np.zeros(len(rows), np.int64), away
            while len(heads) < MOST and near.max() > below:
                head = int(rows[np.argmax(near)])
                far = np.sqrt(((points[rows] - points[head]) ** 2).sum(axis=1))
                owner[far < near] = len(heads)
                near = np.minimum(near, far)
                heads.append(head)
            if near.max() > below:
                heads = heads[:FEW]
                gaps = np.stack([((points[rows] - points[h]) ** 2).sum(axis=1) for h in heads])
                owner = gaps.argmin(axis=0)
            if len(heads) > 1:
                self.parts = [Cover(points, rows[owner == k], h, leaf) for k, h in enumerate(heads) if (owner == k).any()]


    def leaves(self) -> Iterator[Cover]:
        if not self.parts:
            yield self
        for part in self.parts:
            yield from part.leaves()


class Flat:
    """The nodes of a tree as arrays, so that many bounds are one product. Each node's points are a stretch of `order`."""

    def __init__(self, root: Cover) -> None:
        self.nodes: list[Cover] = []
        self.kids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        low: list[int] = []
        at = 0

        def add(node: Cover) -> int:
            nonlocal at
            place = len(self.nodes)
            self.nodes.append(node)
            self.kids.append(np.zeros(0, np.int64))
            low.append(at)
            if not node.parts:
                rows.append(node.rows)
                at += len(node.rows)
            self.kids[place] = np.array([add(p) for p in node.parts], np.int64)
            return place

        add(root)
        self.order = np.concatenate(rows)
        self.low = np.array(low)
        self.size = np.array([len(n.rows) for n in self.nodes])
        self.leaf = np.array([not n.parts for n in self.nodes])
        self.centre = np.stack([n.centre for n in self.nodes])
        self.norm, self.radius = np.array([n.norm for n in self.nodes]), np.array([n.radius for n in self.nodes])

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.low[node] : self.low[node] + self.size[node]]

    def bounds(self, group: Cover, nodes: np.ndarray) -> np.ndarray:
        """The most that a query of a group and a point of each node can score."""
        norm, radius = self.norm[nodes], self.radius[nodes]
        bound = self.centre[nodes] @ group.centre + group.norm * radius + norm * group.radius + radius * group.radius
        return bound + 1e-9 * (np.abs(bound) + 1)

    def opened(self, nodes: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The nodes, those of `which` replaced by their children."""
        return np.concatenate([nodes[~which], *(self.kids[n] for n in nodes[which])])


class Search:
    """The k best candidates of each query of a block; pruned counts node pairs that were left out, opened those that were not."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> None:
        self.queries, self.query_ids, self.points, self.ids, self.k = queries, query_ids, points, ids, k
        self.best = np.full((len(queries), k), -np.inf)
        self.best_at = np.full((len(queries), k), -1)
        self.pruned = self.opened = self.scored = 0
        if len(queries) and len(points):
            asks = Cover(queries, np.arange(len(queries)), 0, ASK_LEAF)
            self.tree = Flat(Cover(points, np.arange(len(points)), 0, LEAF))
            self._seed(asks)
            self._visit(asks, np.zeros(1, np.int64))

    def _seed(self, group: Cover) -> None:
        """Scores for every group of queries the smallest node of 2 k candidates that its centre leads to, so that worst k-th scores prune from the root on."""
        if group.parts:
            for part in group.parts:
                self._seed(part)
            return
        tree, node = self.tree, 0
        while not tree.leaf[node]:
            kids = tree.kids[node]
            best = int(kids[np.argmax(tree.centre[kids] @ group.centre)])
            if tree.size[best] < 2 * self.k:
                break
            node = best
        self._score(group.rows, tree.rows(node))

    def _divides(self, group: Cover, nodes: np.ndarray) -> bool:
        parts = 0
        for part in group.leaves():
            parts += len(part.rows) * self.tree.size[nodes[self.tree.bounds(part, nodes) >= self.best[part.rows, -1].min()]].sum()
        return 2 * parts < len(group.rows) * self.tree.size[nodes].sum()

    def _visit(self, group: Cover, nodes: np.ndarray) -> None:
        """Descends in both trees at once; nodes: what of the candidates' tree is left for this group.

        A small group is divided further only if its leaves leave out half of what it would score.
        """
        tree = self.tree
        while len(nodes):
            worst = self.best[group.rows, -1].min()
            kept = nodes[tree.bounds(group, nodes) >= worst]
            self.pruned, self.opened = self.pruned + len(nodes) - len(kept), self.opened + len(kept)
            inner = ~tree.leaf[kept]
            if group.parts and (len(group.rows) > ASK_GROUP or not inner.any() and self._divides(group, kept)):
                down = tree.opened(kept, inner & (tree.radius[kept] >= group.radius))
                for part in group.parts:
                    self._visit(part, down)
                return
            nodes = kept
            if not inner.any():
                break
            nodes = tree.opened(kept, inner)
        if not len(nodes):
            return
        bounds = tree.bounds(group, nodes)
        order, at = np.argsort(-bounds, kind="stable"), 0
        while at < len(order) and bounds[order[at]] >= self.best[group.rows, -1].min():
            rows, size = [], 0
            while at < len(order) and size < BATCH:
                rows.append(tree.rows(int(nodes[order[at]])))
                size, at = size + len(rows[-1]), at + 1
            self._score(group.rows, np.concatenate(rows))

    def _score(self, asks: np.ndarray, rows: np.ndarray) -> None:
        """Holds candidate rows against the queries of a leaf and keeps the k best of each."""
        self.scored += len(asks) * len(rows)
        scores, ids, k = self.queries[asks] @ self.points[rows].T, self.ids[rows], self.k
        scores[self.query_ids[asks][:, None] == ids[None, :]] = -np.inf
        least = self.best[asks, -1]
        if len(rows) > k:
            least = np.maximum(least, np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k])
        row, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(row):
            return
        touched = np.unique(row)
        all_row = np.concatenate([row, np.repeat(touched, k)])
        all_score = np.concatenate([scores[row, at], self.best[asks[touched]].ravel()])
        all_at = np.concatenate([rows[at], self.best_at[asks[touched]].ravel()])
        all_id = np.where(all_at >= 0, self.ids[all_at], _NO_ID)
        order = np.lexsort((all_at, all_id, -all_score, all_row))
        # a candidate that was scored before stands beside itself
        again = (all_row[order][1:] == all_row[order][:-1]) & (all_at[order][1:] == all_at[order][:-1]) & (all_at[order][1:] >= 0)
        order = order[np.concatenate([[True], ~again])]
        starts = np.searchsorted(all_row[order], touched)
        take = order[starts[:, None] + np.arange(k)[None, :]]
        self.best[asks[touched]], self.best_at[asks[touched]] = all_score[take], all_at[take]

    @property
    def best_ids(self) -> np.ndarray:
        return np.where(self.best_at >= 0, self.ids[self.best_at], _NO_ID)


def _plain(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """For components too large for exact doubles: Python integers."""
    out: tuple[list, list, list] = ([], [], [])
    big = points.astype(object)
    for name, q in zip(query_ids.tolist(), queries.astype(object), strict=True):
        scored = sorted((-int(s), i) for s, i in zip(big @ q, ids.tolist(), strict=True) if i != name)[:k]
        for s, i in scored:
            out[0].append(name)
            out[1].append(i)
            out[2].append(max(-(1 << 63), min((1 << 63) - 1, -s)))
    return out


def _block(table: pa.Table, k: int) -> pa.Table:
    def matrix(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rows = part.column("x").combine_chunks()
        sizes = np.diff(rows.offsets.to_numpy())
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(rows), width), np.int64)
        out[np.arange(width)[None, :] < sizes[:, None]] = flat
        return out, part.column("vec_id").to_numpy()

    width = max(len(v) for v in table.column("x").combine_chunks())
    asks = table.column("ask").to_numpy(zero_copy_only=False)
    (queries, query_ids), (points, ids) = matrix(table.filter(pa.array(asks))), matrix(table.filter(pa.array(~asks)))
    order = np.lexsort([*queries.T, query_ids])
    first = np.concatenate([[True], query_ids[order][1:] != query_ids[order][:-1]]) if len(order) else order
    query_ids, queries = query_ids[order][first], queries[order][first]
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * width
    if largest < 2.0**52 and np.abs(points).max(initial=0) < 2**25 and np.abs(queries).max(initial=0) < 2**25:
        found = Search(queries.astype(float), query_ids, points.astype(float), ids, k)
        row, at = np.nonzero(np.isfinite(found.best))
        columns = [query_ids[row], ids[found.best_at[row, at]], found.best[row, at].astype(np.int64)]
    else:
        columns = _plain(queries, query_ids, points, ids, k)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query row, over all other rows."""
    ship(vectors.sparkSession)
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("ask"), doubles.alias("x")).filter(F.col("vec_id").isNotNull() & usable(F.col("x")))
    whole = lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-9.2e18)), F.lit(9.2e18)))
    rows = rows.select("vec_id", "ask", F.transform("x", whole).alias("x"))
    total, asked = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_query.cast("long")), F.lit(0))).first()
    blocks, query_blocks = max(1, -(-total // CANDIDATE_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    hashed = F.xxhash64("vec_id")
    others = F.sequence(F.lit(0), F.lit(query_blocks - 1)), F.sequence(F.lit(0), F.lit(blocks - 1))
    candidates = rows.select(F.pmod(hashed, F.lit(blocks)).cast("int").alias("r"), F.explode(others[0]).alias("q"), F.lit(False).alias("ask"), "vec_id", "x")
    queries = rows.filter("ask").select(F.explode(others[1]).alias("r"), F.pmod(hashed, F.lit(query_blocks)).cast("int").alias("q"), "ask", "vec_id", "x")
    found = candidates.union(queries).groupBy("r", "q").applyInArrow(lambda t: _block(t, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 20
"""
