import numpy as np
import pytest

from histloom.llm import near_vectors


def plain(rows, threshold=0.9):
    units = {}
    for place, (_, v) in enumerate(rows):
        if v and None not in v and np.all(np.isfinite(v)) and any(v):
            v = np.array(v, dtype=float) / np.abs(v).max()
            units[place] = v / np.linalg.norm(v)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, u in units.items():
        for j, v in units.items():
            if i != j and len(u) == len(v) and u @ v >= threshold:
                links[i] += 1
                root[find(i)] = find(j)
    least = {}
    for i in units:
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((vid, links[i], least.get(find(i), vid) if i in units else vid) for i, (vid, _) in enumerate(rows)), key=str)


def found(docs):
    got = near_vectors.near_vectors(docs).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str)


@pytest.mark.parametrize("groups", [[2] * 40 + [3] * 20 + [1] * 600, [300, 60, 1, 1], [700]])
def test_groups_of_near_vectors(spark, monkeypatch, groups):
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", 64)
    draw = np.random.default_rng(len(groups))
    vectors = []
    for n in groups:
        base = draw.standard_normal(32)
        vectors += [base + draw.standard_normal(32) * draw.choice([0.05, 0.2, 0.3]) for _ in range(n)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), plain(rows)
    assert got == want


def test_odd_rows(spark):
    rows = [
        (5, [1.0, 2.0]), (4, [2.0, 4.0]), (6, [1.0, 2.0]), (7, None), (8, []), (9, [0.0, 0.0]), (10, [1.0, None]),
        (11, [float("nan"), 1.0]), (12, [float("inf"), 1.0]), (13, [1.0, 2.0, 0.0]), (14, [-1.0, -2.0]),
        (15, [3e38, 6e37]), (16, [3e-38, 6e-39]), (None, [1.0, 2.0]), (None, [-2.0, 1.0]), (5, [1.0, 2.0]), (7, None),
    ]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(docs.selectExpr("*", "1 as cls", "2 as unit", "3 as root", "4 as n_links")) == plain(rows)
    assert found(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []


def test_driver_vectors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in docs.select("vec_id", "embedding").collect()]
    assert found(docs) == plain(rows)


def near(draw, base, cosine, dim):
    """A vector at `cosine` to the unit vector `base`."""
    off = draw.standard_normal(dim)
    off -= (off @ base) * base
    return cosine * base + np.sqrt(1 - cosine**2) * off / np.linalg.norm(off)


def joined_groups(draw, pairs, size, dim=64):
    """Twice `size` vectors per pair of dense groups, whose centres have the cosine 0.93."""
    vectors = []
    for _ in range(pairs):
        one = draw.standard_normal(dim)
        one /= np.linalg.norm(one)
        for centre in (one, near(draw, one, 0.93, dim)):
            vectors += [near(draw, centre, 0.99, dim) for _ in range(size)]
    return vectors


def test_dense_groups_are_joined(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "AUDITED", 8)
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", 50)
    vectors = joined_groups(np.random.default_rng(3), 12, 60)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(10_000 + i, [1.0, float(i)]) for i in range(40)]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), plain(rows)
    assert len({w[2] for w in want}) <= 12 + 40  # each pair of groups is one component
    wrong = sum(g != w for g, w in zip(got, want))
    assert wrong == 0, f"{wrong} of {len(want)} rows differ"


@pytest.fixture
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_recall_counts_vectors_not_links(spark):
    """A dense group whose links are all found beside a pair that is not."""
    names = [f"{i:03d}".encode() for i in range(100)]
    truth = [(a, b) for a in names for b in names if a != b] + [(b"x", b"y"), (b"z", b"w")]
    labels = [(n, names[0]) for n in names] + [(n, n) for n in (b"x", b"y")] + [(n, b"w") for n in (b"z", b"w")]
    truth = spark.createDataFrame(truth, "a binary, b binary")
    assert near_vectors.measured_recall(truth, spark.createDataFrame(labels, "id binary, root binary")) == 0.5


def test_recall_that_is_not_reached_is_an_error(spark, few_partitions, monkeypatch):
    monkeypatch.setattr(near_vectors, "FORESTS", 1)
    monkeypatch.setattr(near_vectors, "measured_recall", lambda *_: 0.5)
    with pytest.raises(RuntimeError, match="0.5000"):
        near_vectors.near_vectors(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_many_vectors_without_help_of_the_audit(spark, few_partitions):
    """Isolated pairs and joined dense groups among unrelated vectors, far more than are audited."""
    draw, dim = np.random.default_rng(8), 64
    vectors = joined_groups(draw, 4, 60, dim)
    for _ in range(2_000):
        one = draw.standard_normal(dim)
        one /= np.linalg.norm(one)
        vectors += [one, near(draw, one, 0.92, dim)]
    vectors += list(draw.standard_normal((20_000 - len(vectors), dim)))
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    want, ends = [0] * len(unit), []
    for at in range(0, len(unit), 2_000):
        i, j = np.nonzero(unit[at : at + 2_000] @ unit.T >= 0.9)
        for x, y in zip((i + at).tolist(), j.tolist()):
            want[x] += x != y
            ends += [(x, y)] if x < y else []
    least = list(range(len(unit)))
    moved = True
    while moved:
        moved = False
        for x, y in ends:
            low = min(least[x], least[y])
            moved |= least[x] != low or least[y] != low
            least[x] = least[y] = low
    rows = [(i, v.tolist()) for i, v in enumerate(unit)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)).collect()
    wrong = [r for r in got if (r["n_links"], r["component_id"]) != (want[r["vec_id"]], least[r["vec_id"]])]
    dense = sum(r["vec_id"] < 480 for r in wrong)
    assert dense == 0 and len(wrong) <= 20, f"{len(wrong)} of {len(got)} rows differ, {dense} of dense groups"


def test_audit_only_measures(spark, few_partitions, monkeypatch):
    none = spark.createDataFrame([], "a binary, b binary, sim float")
    monkeypatch.setattr(near_vectors, "forest", lambda *_: none)
    monkeypatch.setattr(near_vectors, "measured_recall", lambda *_: 1.0)
    rows = [(i, [1.0, 0.01 * i]) for i in range(4)]
    assert [n for _, n, _ in found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))] == [0] * 4
