"""Operators that SQL cannot express, against plain NumPy forms."""

import itertools
import math

import numpy as np
import pytest

from typolith import catalog
from typolith.operators import agreement, clustering, neighbours, warping
from typolith.plans import quality

SF = "/root/testdata/sf0.01"


def test_kmeans_is_a_fixed_point_and_finds_planted_groups(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 6)) * 20
    truth = np.arange(200) % 4
    x = centres[truth] + rng.normal(size=(200, 6))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 6), (900, None)], "id long, x array<double>")
    got = {r.id: r.label for r in clustering.kmeans(table, 4, n_init=3).collect()}
    assert len(got) == 200 and len({(got[i], truth[i]) for i in got}) == 4
    means = np.array([x[[i for i in got if got[i] == k]].mean(axis=0) for k in range(4)])
    assert all(np.argmin(((x[i] - means) ** 2).sum(axis=1)) == got[i] for i in got)
    assert clustering.kmeans(table.limit(0), 4).count() == 0


def test_kmeans_takes_few_jobs_and_is_the_same_by_jobs(spark):
    rng = np.random.default_rng(9)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 5)))], "id long, x array<double>")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("kmeans", "")
    got = {r.id: r.label for r in clustering.kmeans(table, 4, n_init=3).collect()}
    spark.sparkContext.setJobGroup("other", "")
    assert len(tracker.getJobIdsForGroup("kmeans")) < 20
    assert got == {r.id: r.label for r in clustering.kmeans(table, 4, n_init=3, task_values=0).collect()}


def test_joint_lloyd_against_numpy(spark):
    rng = np.random.default_rng(10)
    x, p = rng.normal(size=(40, 3)), np.where(rng.random((40, 40)) < 0.15, rng.random((40, 40)), 0.0)
    features = spark.createDataFrame([(i, d, float(x[i, d])) for i in range(40) for d in range(3)], "id long, dim int, x double")
    edges = spark.createDataFrame([(int(i), int(j), float(p[i, j])) for i, j in zip(*np.nonzero(p), strict=True)], "i long, j long, p double")
    label = np.arange(40) % 4
    got = {r.id: r.label for r in clustering.joint_lloyd(features, edges, spark.createDataFrame(list(enumerate(label.tolist())), "id long, label long"), xi=2.0).collect()}
    for _ in range(100):
        kinds = np.unique(label)
        far = sum(w * ((v[:, None] - np.stack([v[label == k].mean(axis=0) for k in kinds])[None]) ** 2).sum(axis=2) for w, v in ((1.0, x), (2.0, p)))
        fresh = kinds[far.argmin(axis=1)]
        if (fresh == label).all():
            break
        label = fresh
    assert got == dict(enumerate(label.tolist()))


def test_joint_lloyd_stops_at_a_fixed_point(spark):
    x = [(0, 0.0), (1, 0.1), (2, 5.0), (3, 5.1)]
    features = spark.createDataFrame([(i, 0, v) for i, v in x], "id long, dim int, x double")
    start = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1)], "id long, label long")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "i long, j long, p double")
    start = start.withColumn("label", (start.id == 3).cast("long"))
    got = {r.id: r.label for r in clustering.joint_lloyd(features, edges, start, xi=0.0).collect()}
    assert got[0] == got[1] != got[2] == got[3]


def _plain_warping(x, y, window, dims):
    a, b = x.reshape(-1, dims), y.reshape(-1, dims)
    cost = {(-1, -1): 0.0}
    for i in range(len(a)):
        for j in range(len(b)):
            if abs(i - j) <= window:
                cost[i, j] = ((a[i] - b[j]) ** 2).sum() + min(cost.get(k, math.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return math.sqrt(cost[len(a) - 1, len(b) - 1])


@pytest.mark.parametrize("dims", [1, 2])
def test_warping(dims):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(5, 12 * dims)), rng.normal(size=(4, 12 * dims))
    got = warping.warped(x, y, 3, dims)
    assert np.allclose(-got, [[_plain_warping(a, b, 3, dims) for b in y] for a in x])


def test_warped_pairs_cover_all_pairs(spark):
    for name in ("dtw_pairs", "dtw_pairs_of_two"):
        rows = catalog.queries()[name](spark, SF).collect()
        entities = {r.i for r in rows} | {r.j for r in rows}
        assert len(rows) == len(entities) * (len(entities) - 1) // 2 > 0 and all(0 < r.s <= 1 for r in rows)


def test_warping_of_blocks_holds_few_pairs_at_once():
    import tracemalloc

    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(1024, 16)), rng.normal(size=(1024, 16))
    tracemalloc.start()
    got = warping.warped(x, y, 3, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5 * got.nbytes
    assert -got[1000, 30] == pytest.approx(_plain_warping(x[1000], y[30], 3, 2))


def test_exact_median(spark):
    rng = np.random.default_rng(8)
    for values in (rng.normal(size=301), rng.normal(size=300), np.repeat([1.0, 2.0], 50), np.repeat([1.0, 2.0, 9.0], [50, 60, 2]), np.array([3.0]), np.zeros(4)):
        table = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "d double")
        assert quality.exact_median(table, "d", 8) == np.median(values)
    assert quality.exact_median(table.filter("d > 5"), "d") is None


def test_lagged_correlation():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(3, 9)), rng.normal(size=(2, 9))
    for i, j in itertools.product(range(3), range(2)):
        want = max(np.corrcoef(x[i][max(0, -s) : 9 - max(0, s)], y[j][max(0, s) : 9 - max(0, -s)])[0, 1] for s in range(-2, 3))
        assert quality.lagged(x, y)[i, j] == pytest.approx(want)


def test_matching_is_the_best_of_all():
    rng = np.random.default_rng(5)
    for rows, columns in ((4, 4), (3, 5), (5, 3)):
        counts = rng.integers(0, 20, (rows, columns))
        got = agreement.matching(counts)
        used = [c for c in got if c >= 0]
        assert len(set(used)) == len(used) == min(rows, columns)
        wide = np.pad(counts, ((0, 0), (0, max(0, rows - columns))))
        best = max(sum(wide[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), rows))
        assert sum(counts[r, c] for r, c in enumerate(got) if c >= 0) == best


def test_regression_with_dummies(spark):
    rows = {r.name: r for r in catalog.queries()["ols_dummies"](spark, SF).collect()}
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    from typolith.plans import panel
    from typolith.plans.sqlpair import duck_text

    data = con.execute(duck_text(panel.ORACLE_PREFIX + " SELECT growth, rel_mean, m_economy, label FROM profile JOIN modal USING (entity) WHERE growth IS NOT NULL")).fetchnumpy()
    kinds = sorted(set(data["label"].tolist()))
    x = np.column_stack([np.ones(len(data["growth"])), data["rel_mean"], data["m_economy"], *[data["label"] == k for k in kinds[1:]]]).astype(float)
    beta, *_ = np.linalg.lstsq(x, data["growth"], rcond=None)
    residual = data["growth"] - x @ beta
    inverse = np.linalg.inv(x.T @ x)
    errors = np.sqrt(np.diag(inverse @ (x.T * residual**2) @ x @ inverse) * len(x) / (len(x) - x.shape[1]))
    for k, name in enumerate(["const", "rel_mean", "m_economy", *[f"type_{k}" for k in kinds[1:]]]):
        assert rows[name].coefficient == pytest.approx(beta[k], abs=1e-5) and rows[name].error == pytest.approx(errors[k], abs=1e-5)


def test_neighbours_in_many_blocks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5))
    table = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(90, [0.0] * 5, 1), (None, [1.0] * 5, 1), (91, None, 1)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    got = {(r.i, r.j) for r in neighbours.nearest(table, 4, block=16).collect()}
    assert got == {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:4]}
    pairs = {(r.i, r.j) for r in neighbours.similar(table, 0.3, block=16).collect()}
    assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] > 0.3}
    best = [(r.i, r.j) for r in neighbours.best_pairs(table, 7, block=16).collect()]
    assert best == sorted(((i, j) for i in range(60) for j in range(i + 1, 60)), key=lambda p: -s[p])[:7]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "i long, j long")
    got = {r.node: r.label for r in neighbours.components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50}
