"""Exact pairs of vectors in blocks, by cosine or another measure: a matrix product for each pair of blocks.

Rows are dealt into blocks by a hash of their id; each pair of blocks is one unit of work, which returns only what can still be among the
answer (the k best of each row, pairs over a threshold, or the m best pairs), so no task holds more than two blocks and nothing is collected.
The work is quadratic in rows, as all pairs are what these operators ask for; memory and results are not.

Rows with a null id, or a vector that is null or of norm zero, take no part; equal similarities go to the smaller id; similarities are rounded to
nine digits, so that their order does not hang on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, ship

BLOCK = 2048
CELLS = 1 << 18  # pairs that are held at once where each is chosen by itself
_SCHEMA = "i long, j long, li long, lj long, s double"


def _dealt(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, block: int, halves: bool) -> DataFrame:
    label = F.col(label_col).cast("long") if label_col else F.lit(0).cast("long")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("x")).filter("id IS NOT NULL AND x IS NOT NULL")
    blocks = max(1, -(-rows.count() // block))
    rows = rows.withColumn("_at", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if halves:
        return rows.select(F.least("_at", "_other").alias("p"), F.greatest("_at", "_other").alias("q"), (F.col("_at") <= F.col("_other")).alias("left"), "id", "label", "x")
    own = F.array(F.struct(F.col("_at").alias("p"), F.col("_other").alias("q"), F.lit(True).alias("left")), F.struct(F.col("_other").alias("p"), F.col("_at").alias("q"), F.lit(False).alias("left")))
    return rows.select(F.inline(own), "id", "label", "x")


Choice = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ (y / np.sqrt((y * y).sum(axis=1))[:, None]).T


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances with a minus sign, so that the nearest are the most similar."""
    return -np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0))


def _pairs(dealt: DataFrame, halves: bool, choose: Choice, measure: Measure = cosine, cells: int | None = None) -> DataFrame:
    """Pairs that choose(similarities, row ids, column ids) takes from each unit; with cells, from some rows of it at a time."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))

        def side(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = np.array(part.column("x").to_pylist(), float).reshape(part.num_rows, -1)
            order = np.argsort(part.column("id").to_numpy(), kind="stable")
            order = order[(x[order] != 0).any(axis=1)] if measure is cosine else order
            return x[order], part.column("id").to_numpy()[order], part.column("label").to_numpy()[order]

        first = table.column("left")
        x, ids, labels = side(table.filter(first))
        same = halves and table.column("p")[0] == table.column("q")[0]
        y, others, classes = (x, ids, labels) if same else side(table.filter(pa.compute.invert(first)))
        if not len(ids) or not len(others):
            return
        rows = len(ids) if cells is None else max(1, cells // len(others))
        for low in range(0, len(ids), rows):
            part = slice(low, low + rows)
            s = np.round(measure(x[part], y), 9) + 0.0
            s[ids[part, None] == others[None, :]] = -np.inf
            if same:
                s[np.arange(low, low + len(s))[:, None] >= np.arange(len(others))[None, :]] = -np.inf
            r, c = choose(s, ids[part], others)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[part][r], others[c], labels[part][r], classes[c], s[r, c])], names=["i", "j", "li", "lj", "s"])

    return dealt.groupBy("p", "q").applyInArrow(unit, _SCHEMA)


def nearest(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", block: int = BLOCK) -> DataFrame:
    """(i, j, li, lj, s): the k most similar rows j of every row i."""
    ship(vectors.sparkSession)

    def choose(s: np.ndarray, ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
        r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        order = np.lexsort((others[c], -s[r, c], r))
        r, c = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, "left")
        return r[place < k], c[place < k]

    found = _pairs(_dealt(vectors, id_col, vector_col, label_col, block, False), False, choose)
    best = Window.partitionBy("i").orderBy(F.desc("s"), "j")
    return found.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= k).drop("_k")


def similar(vectors: DataFrame, above: float, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", block: int = BLOCK, measure: Measure = cosine) -> DataFrame:
    """(i, j, li, lj, s) with i < j of all pairs whose similarity is above a threshold."""
    ship(vectors.sparkSession)
    found = _pairs(_dealt(vectors, id_col, vector_col, label_col, block, True), True, lambda s, ids, others: np.nonzero(s > above), measure, CELLS)
    return _ordered(found)


def label_distances(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, block: int = BLOCK) -> DataFrame:
    """(id, own, label, total, n): for each row the sum of its distances to the other rows of every label, and their number."""
    ship(vectors.sparkSession)

    def unit(table: pa.Table) -> pa.Table:
        first = table.column("left")
        a, b = table.filter(first), table.filter(pa.compute.invert(first))
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())], names=["id", "own", "label", "total", "n"])
        x, y = (np.array(t.column("x").to_pylist(), float) for t in (a, b))
        ids, labels = a.column("id").to_numpy(), b.column("label").to_numpy()
        far = -euclidean(x, y)
        far[ids[:, None] == b.column("id").to_numpy()[None, :]] = 0.0
        kinds, of = np.unique(labels, return_inverse=True)
        total = np.stack([far[:, of == k].sum(axis=1) for k in range(len(kinds))], axis=1)
        n = np.stack([(ids[:, None] != b.column("id").to_numpy()[None, of == k]).sum(axis=1) for k in range(len(kinds))], axis=1)
        shape = (len(ids), len(kinds))
        columns = [np.repeat(ids, shape[1]), np.repeat(a.column("label").to_numpy(), shape[1]), np.tile(kinds, shape[0]), total.ravel(), n.ravel()]
        return pa.table([pa.array(c) for c in columns], names=["id", "own", "label", "total", "n"])

    found = _dealt(vectors, id_col, vector_col, label_col, block, False).groupBy("p", "q").applyInArrow(unit, "id long, own long, label long, total double, n long")
    return found.groupBy("id", "own", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def best_pairs(vectors: DataFrame, m: int, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", block: int = BLOCK) -> DataFrame:
    """(i, j, li, lj, s) with i < j: the m most similar pairs of all (the epsilon graph of m edges)."""
    ship(vectors.sparkSession)

    def choose(s: np.ndarray, ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = s.ravel()
        least = np.partition(flat, len(flat) - m)[len(flat) - m] if len(flat) > m else -np.inf
        return np.nonzero((s >= least) & (s > -np.inf))

    found = _ordered(_pairs(_dealt(vectors, id_col, vector_col, label_col, block, True), True, choose))
    return found.orderBy(F.desc("s"), "i", "j").limit(m)


def _ordered(pairs: DataFrame) -> DataFrame:
    swap = F.col("i") > F.col("j")
    turned = [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("i", "j"), ("j", "i"), ("li", "lj"), ("lj", "li"))]
    return pairs.select(*turned, "s")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of edges (i, j).

    Every round takes the least label among a node's neighbours and then the label of that label, so a chain of length n takes about
    log n rounds. Each round is written to the shared scratch folder.
    """
    both = materialise(edges.select("i", "j").union(edges.select("j", "i")).distinct(), "edges")
    labels = materialise(both.groupBy("i").agg(F.least(F.col("i"), F.min("j")).alias("label")).select(F.col("i").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels, both["j"] == labels["node"]).groupBy("i").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("i")).select("node", "label", F.least("label", "near").alias("hook"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        least = F.least("hook", F.coalesce("_l", "hook"))
        fresh = materialise(hooked.join(jump, F.col("hook") == F.col("_n"), "left").select("node", least.alias("label"), (least < F.col("label")).alias("moved")), "labels")
        labels = fresh.select("node", "label")
        if not fresh.filter("moved").limit(1).count():
            return labels
