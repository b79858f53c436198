import math

import numpy as np
import pytest

from histloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, _vec string, n string"


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, 1, "x", "y") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(vectors, components=8):
    """The contract by numpy, in one place: ids, deviations, whitened (up to sign), shares."""
    c = np.array(vectors, dtype=np.float32).astype(np.float64)
    x = np.floor(1024 * c).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    d = n * x - sums
    y = d / n
    v = y.T @ y / n
    values, turn = np.linalg.eigh(v)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    return [sum(int(a) ** 2 for a in row) for row in d], y @ turn / np.sqrt(values), values / np.trace(v)


def random_vectors(n, d, seed=5):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.linspace(0.05, 0.5, d)).astype(np.float32)


@pytest.mark.parametrize("n, d", [(700, 12), (400, 5)])
def test_whole_table(spark, n, d):
    vectors = random_vectors(n, d)
    deviations, whitened, shares = plain(vectors)
    got = whitening.whiten(table(spark, vectors.tolist())).toPandas().sort_values(["component", "vec_id"])
    count = min(8, d)
    assert len(got) == n * count and set(got["n"]) == {n}
    assert (got["deviation"].to_numpy().reshape(count, n) == np.array(deviations)).all()
    found = got["whitened"].to_numpy().reshape(count, n)
    for k in range(count):
        assert min(np.abs(found[k] - s * whitened[:, k]).max() for s in (1, -1)) < 1e-9
    assert np.allclose(got["explained"].to_numpy().reshape(count, n), shares[:count, None], rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10


def test_vectors_that_take_no_part(spark):
    good = random_vectors(50, 4).tolist()
    bad = [None, [], [0.1, None, 0.2, 0.3], [math.nan, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0], [1.0, 2.0]]
    got = whitening.whiten(table(spark, good + bad, [*range(49), None, *range(100, 106)])).toPandas()
    assert set(got["n"]) == {50} and len(got) == 200
    assert got["vec_id"].isna().sum() == 4 and got["vec_id"].max() == 48
    assert got.columns.tolist() == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
    ]


def test_repeated_rows_and_ids_count(spark):
    vectors = random_vectors(30, 3).tolist()
    got = whitening.whiten(table(spark, vectors * 2, [7] * 60)).toPandas()
    assert len(got) == 180 and set(got["n"]) == {60}


def test_without_variance(spark):
    got = whitening.whiten(table(spark, [[0.5, 0.25]] * 4)).toPandas()
    assert len(got) == 8 and (got[["whitened", "deviation", "explained"]] == 0).all().all()
    assert set(got["identity_error"]) == {1.0}
    one = whitening.whiten(table(spark, [[0.5, 0.25]])).toPandas()
    assert len(one) == 2 and set(one["whitened"]) == {0.0}


def test_empty_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [None, []])).count() == 0


def test_entries_that_a_long_cannot_square(spark):
    got = whitening.whiten(table(spark, [[1e12, 0.0], [-1e12, 1.0], [3e38, 2.0]])).toPandas()
    assert got["deviation"].isna().all() and np.isfinite(got["whitened"]).all()


def symmetric(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    q = q.astype(np.longdouble)
    q = q @ (1.5 * np.eye(len(q)) - 0.5 * q.T @ q)
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


CLUSTERED = [5.0] * 10 + [5 + 1e-9] * 10 + [5 + 1e-12] * 4 + np.linspace(1, 2, 24).tolist()


@pytest.mark.parametrize(
    "values", [np.linspace(1, 9, 40).tolist(), CLUSTERED, [1e6] + [1.0] * 30, [3.0] * 20, [0.0] * 12 + [1.0, 1.5]]
)
def test_eigenvectors_to_double_precision(values):
    a = symmetric(values)
    found, x = whitening.eigen(a)
    wide = x.astype(np.longdouble)
    assert np.abs(wide.T @ wide - np.eye(len(a))).max() < 1e-15
    assert np.abs(a @ wide - wide * found).max() < 1e-15 * max(values)
    assert np.allclose(found, sorted(values, reverse=True), rtol=1e-13, atol=1e-13)


def test_single_precision_alone_is_worse_and_steps_mend_it():
    a = symmetric(np.linspace(1, 9, 40).tolist())
    _, x = np.linalg.eigh(a.astype(np.float32))
    defects = []
    x = x.astype(np.longdouble)
    for _ in range(3):
        x, _, _, defect = whitening.refine_step(a, x)
        defects.append(defect)
    assert defects[0] > 1e-8 and defects[1] < 1e-3 * defects[0] and defects[2] < 1e-3 * defects[1]
