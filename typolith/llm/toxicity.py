"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and of their first letters (three to six). For every labelled text with
identity terms a counterfactual is made by swapping each term for the next of its group, and the squared change of the
logit between both is part of the loss, so a neutral mention of a group moves the score little.

The classifier is fitted on at most MAX_TRAIN labelled rows (smallest hashes of the id, evenly random). Features are counted
by class over that sample in a distributed aggregate; those that tell the classes apart are kept, MAX_FEATURES at most, so what
is broadcast has a fixed bound. Whole texts are scored; a word's features are looked up once per worker and cached.

Edge cases: null and empty texts get the score of a text without features; repeated rows and ids are scored alike; rows with
a null label are not learned from; without labels, or with one class only, every score is the smoothed share of label 1; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._words import releasing

MAX_TRAIN = 20_000
MAX_FEATURES = 20_000
PENALTY = 2.0
RIDGE = 2e-4
#: Terms that may stand for each other.
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, t in enumerate(g)}
_LETTERS = re.compile(r"[^\W\d_]+")
_LEET = str.maketrans("013457@$", "oieastas")
_CACHE = 400_000


def features_of(token: str) -> tuple[str, ...]:
    """Features of one lower-case token of a text."""
    words = _LETTERS.findall(token)
    out = []
    if any(c in "013457@$" for c in token) and words:
        words = [*words, *_LETTERS.findall(token.translate(_LEET))]
    for word in words:
        out.append("w" + word)
        out += [f"{k}{word[:k]}" for k in (3, 4, 5, 6) if len(word) > k]
    return tuple(out)


def tokens_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def counterfactual(tokens: set[str]) -> set[str] | None:
    """The tokens with identity terms swapped, or None if there are none."""
    if SWAP.keys().isdisjoint(tokens) and not any(_bare(t) in SWAP for t in tokens if not t.isalpha()):
        return None
    return {SWAP.get(_bare(t), t) for t in tokens}


def _bare(token: str) -> str:
    return token.strip(".,;:!?\"'()[]*#%&$|-")


def _class(label: int) -> int:
    return min(max(label, 0), 1)


def train(rows: list[tuple[int, list[int], list[int]]], n: int, penalty: float = PENALTY, ridge: float = RIDGE, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, features, features of the counterfactual) rows, by full-batch Adam."""
    labels = np.array([r[0] for r in rows], float)
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    column = np.array([c for r in rows for c in r[1]], np.int64)
    signs = [(i, c, s) for i, r in enumerate(rows) if r[2] is not None for s, group in ((1.0, set(r[1]) - set(r[2])), (-1.0, set(r[2]) - set(r[1]))) for c in group]
    swap_owner, swap_column, swap_sign = (np.array(v) for v in zip(*signs, strict=True)) if signs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    weight, bias = np.zeros(n + 1), math.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    weight[n] = bias
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        logit = np.bincount(owner, weight[column], len(rows)) + weight[n]
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels) / len(rows)
        change = np.bincount(swap_owner, swap_sign * weight[swap_column], len(rows)) if signs else np.zeros(len(rows))
        slope = np.zeros(n + 1)
        slope[:n] = np.bincount(column, error[owner], n) + ridge * weight[:n]
        if signs:
            slope[:n] += np.bincount(swap_column, 2 * penalty * change[swap_owner] * swap_sign / len(rows), n)
        slope[n] = error.sum()
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weight -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return weight[:n], float(weight[n])


class Model:
    """Weights by feature name; at most MAX_FEATURES of them."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = dict(zip(names, weights.tolist(), strict=True)), bias

    def scorer(self) -> Callable[[str | None], float]:
        """A function from text to score, with a bounded cache of tokens."""
        weights, cache = self.weights, {}

        def score(text: str | None) -> float:
            if len(cache) > _CACHE:
                cache.clear()
            found: set[str] = set()
            for token in tokens_of(text):
                known = cache.get(token)
                if known is None:
                    known = tuple(f for f in features_of(token) if f in weights)
                    if len(token) <= 64:
                        cache[token] = known
                if known:
                    found.update(known)
            logit = self.bias + sum(weights[f] for f in sorted(found))
            return 1 / (1 + math.exp(-min(40.0, max(-40.0, logit))))

        return score


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> Model:
    """The model of documents (doc_id, text) and labels (doc_id, label)."""
    ship(docs.sparkSession)
    rows = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("_y"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("_y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], pa.int64())], names=["f", "n0", "n1"])
            counts.clear()
            return out

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for t in tokens_of(text) for f in features_of(t)}:
                    counts.setdefault(f, [0, 0])[_class(y)] += 1
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    total = {0: 0, 1: 0}
    for r in texts.groupBy("_y").count().collect():
        total[_class(r["_y"])] += r["count"]
    if not total[0] or not total[1]:
        return Model([], np.zeros(0), math.log((total[1] + 1.0) / (total[0] + 1.0)))
    counts = texts.mapInArrow(releasing(count), "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p0, p1 = (F.col("n0") + 0.5) / (total[0] + 1.0), (F.col("n1") + 0.5) / (total[1] + 1.0)
    z = (p1 - p0) / F.sqrt(p0 * (1 - p0) / total[0] + p1 * (1 - p1) / total[1])
    useful = counts.filter((F.col("n0") + F.col("n1") >= 3) & (F.abs(F.log(p1 / p0)) >= 0.7)).select("f", F.abs(z).alias("z")).filter("z >= 3")
    names = sorted(r["f"] for r in useful.orderBy(F.desc("z"), "f").limit(MAX_FEATURES).collect())
    index = {f: i for i, f in enumerate(names)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda tokens: sorted({index[f] for t in tokens for f in features_of(t) if f in index})
        for batch in batches:
            tokens = [tokens_of(t) for t in batch.column(1).to_pylist()]
            other = [counterfactual(t) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([of(t) for t in tokens], pa.list_(pa.int32())), pa.array([None if t is None else of(t) for t in other], pa.list_(pa.int32()))],
                names=["y", "x", "swapped"],
            )

    found = texts.mapInArrow(releasing(sparse), "y long, x array<int>, swapped array<int>").collect()
    data = [(_class(r["y"]), list(r["x"]), None if r["swapped"] is None else list(r["swapped"])) for r in found]
    weights, bias = train(data, len(names))
    return Model(names, weights, bias)


def held_out(id_col: str, parts: int = 5, part: int = 0):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    ship(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(releasing(step), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose score is under the threshold."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(releasing(step), docs.schema)


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return fit(docs, labels.filter(~held_out("doc_id")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, learned(spark, docs, sf_dir))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
