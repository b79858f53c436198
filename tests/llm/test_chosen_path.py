import random
import re
import time
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from histloom import session
from histloom.llm import chosen_path, graph
from histloom.llm.graph import components


def shingles(text, width):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def roots(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for ids in holders.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    links = [(a, b) for (a, b), k in common.items() if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k)]
    return {i: (len(sets[i]), c) for i, c in roots(links, sets).items()}


def found(docs, width):
    got = chosen_path.near_classes(docs, width=width).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


@pytest.mark.parametrize("width", [4, 5])
def test_driver_documents(spark, width):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs, width) == plain(rows, width)


def near_texts(seed, groups, copies, shared):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 7)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(draw.randint(5, 150))] + passage * shared
        for _ in range(draw.choice(copies)):
            text = list(base)
            for _ in range(draw.randint(0, 4)):
                text[draw.randrange(len(text))] = word()
            texts.append(" ".join(text))
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,groups,copies,shared", [(1, 120, [1, 2, 3, 6], 0), (2, 150, [1, 2], 1), (3, 2, [150], 0)])
def test_near_copies_and_shared_passages(spark, monkeypatch, seed, groups, copies, shared):
    monkeypatch.setattr(chosen_path, "EXHAUSTIVE", 8)
    monkeypatch.setattr(chosen_path, "BLOCK_ROWS", 4)
    rows = near_texts(seed, groups, copies, shared)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 4) == plain(rows, 4)


@pytest.mark.parametrize("exhaustive,block", [(2048, 16), (4, 8)])
def test_nodes_that_stay_open_are_compared_in_full(spark, monkeypatch, exhaustive, block):
    monkeypatch.setattr(chosen_path, "EXHAUSTIVE", exhaustive)
    monkeypatch.setattr(chosen_path, "BLOCK_ROWS", block)
    monkeypatch.setattr(chosen_path, "MAX_LEVELS", 1)
    rows = near_texts(4, 3, [40], 0)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 4) == plain(rows, 4)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(40_000))
    rows = [
        (4, None), (3, ""), (2, " \n"), (9, "one"), (8, "ONE"), (7, "one two three"), (6, "One  two\tthree"),
        (5, "three two one"), (20, long), (21, long + " more"), (22, "É b c d e"), (23, "é b c d e"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as cls", "2 as n_shingles", "3 as root")
    assert found(docs, 4) == plain(rows, 4)
    again = spark.createDataFrame([*rows, (9, "one"), (None, "one"), (None, "alone")], "doc_id long, text string")
    got = sorted(((r[0], r[2], r[3]) for r in chosen_path.near_classes(again, width=4).collect()), key=str)
    assert got.count((9, 8, False)) == 2 and (None, 8, False) in got and (None, None, True) in got
    assert found(spark.createDataFrame([], "doc_id long, text string"), 4) == {}


@pytest.mark.parametrize("seed,n,m", [(1, 40, 25), (2, 200, 210)])
def test_components(spark, seed, n, m):
    draw = random.Random(seed)
    pairs = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()}
    ids = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == roots([p for p in pairs if p[0] != p[1]], ids)


def test_components_of_a_path(spark):
    path = spark.range(400).selectExpr("id as a", "id + 1 as b")
    assert {r["root"] for r in components(path).collect()} == {0}


def test_no_table_on_the_way_stays(spark, monkeypatch, tmp_path):
    """Only the labels and the last edges of the components are left, also after several levels,
    and a setting of the session is as before."""
    monkeypatch.setattr(chosen_path, "EXHAUSTIVE", 4)
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    rows = [(i, f"all of these words are shared by every text but one {i % 11}") for i in range(60)]
    rows += [(100 + i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(20)]
    texts = spark.createDataFrame(rows, "_id long, _text string")
    found = session.written(chosen_path.sketches(texts, 2), "sketches")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    labels = chosen_path.link_classes(found, texts, 2, (80, 100))
    assert labels.count() == 11 and spark.conf.get(key, None) == before
    left = sorted(f.name.rpartition("-")[0] for f in tmp_path.iterdir())
    assert set(left) == {"labels", "links", "sketches"} and left.count("labels") == 1


@pytest.mark.parametrize("exhaustive", [2048, 4])
def test_texts_stay_where_they_are_read(spark, monkeypatch, exhaustive):
    """Full sets are made in the scan of the texts, for compared classes alone, and no table on the
    way holds sets, nor minwise values but the first."""
    read, tables = [], {}
    make, write = chosen_path.full_sets, chosen_path.written

    def full_sets(texts, width):
        read.append((texts.count(), texts._jdf.queryExecution().executedPlan().toString()))
        return make(texts, width)

    def written(df, name, **how):
        tables.setdefault(name, set()).update(df.columns)
        return write(df, name, **how)

    monkeypatch.setattr(chosen_path, "EXHAUSTIVE", exhaustive)
    monkeypatch.setattr(chosen_path, "full_sets", full_sets)
    monkeypatch.setattr(chosen_path, "written", written)
    rows = [(i, f"all of these words are shared by every text but one {i % 11}") for i in range(60)]
    rows += [(100 + i, " ".join(f"{c}{i}" for c in "abcdefgh")) for i in range(300)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of any size
    try:
        assert found(spark.createDataFrame(rows, "doc_id long, text string"), 2) == plain(rows, 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert read and all(0 < n <= 20 and "hashpartitioning" not in plan for n, plan in read)
    assert all(not columns & {"shingles", "mins"} for name, columns in tables.items() if name != "sketches")


@pytest.mark.parametrize("filtered", [True, False])
def test_rows_that_the_filter_lets_through_change_nothing(spark, monkeypatch, filtered):
    """A filter that drops too few rows gives the same; classes whose ids are all null are found."""
    if not filtered:
        monkeypatch.setattr(chosen_path, "sifted", lambda rows, kept, on: rows)
    monkeypatch.setattr(chosen_path, "EXHAUSTIVE", 8)
    monkeypatch.setattr(chosen_path, "BLOCK_ROWS", 4)
    rows = near_texts(5, 40, [1, 2, 30], 0)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 4) == plain(rows, 4)
    base = " ".join(f"w{k}" for k in range(100))
    odd = [(None, base + " x"), (5, base), (None, base + " y"), (None, base + " y"), (7, base), (7, "another text")]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    got = Counter((r[0], r[2], r[3]) for r in chosen_path.near_classes(docs, width=4).collect())
    assert got == {(None, 5, False): 3, (5, 5, True): 1, (7, 5, False): 1, (7, 7, True): 1}


@pytest.mark.parametrize("i,j", [(0, 0), (0, 1)])
def test_pairs_of_blocks_against_plain_loops(monkeypatch, i, j):
    """Which pairs are compared in a node, and that their links join what all links would."""
    monkeypatch.setattr(chosen_path, "SKETCH_SHARE", 0.5)
    draw = random.Random(i + j)
    for node in (3, 9):  # among the places where rows met, or not
        for n in (1, 2, 5, 40, 90):
            rows = [
                (node, i, j, draw.choice([i, j]), bytes([k]), bytes([draw.randrange(1 + n)]), bytes(draw.choices([1, 2], k=4)),
                 draw.sample([1, 2, 4, 5, 6, 7, 8], draw.randrange(3)) + [3])
                for k in range(n)
            ]
            sets = [np.unique(np.array(draw.choices(range(12), k=8))) for _ in rows]
            some = chosen_path._pairs(rows)
            wanted = {
                (x, y) for x in range(n) for y in range(x + 1, n)
                if rows[x][5] != rows[y][5] and (i == j or rows[x][3] != rows[y][3])
                and sum(a == b for a, b in zip(rows[x][6], rows[y][6])) >= 2
                and min(set(rows[x][7]) & set(rows[y][7]), default=node) == node
            }
            assert {(x, y) for x, y in zip(*np.nonzero(some)) if x < y} == wanted and (some == some.T).all()
            links = {(x, y) for x, y in wanted if 10 * len(a := np.intersect1d(sets[x], sets[y])) >= 8 * (len(sets[x]) + len(sets[y]) - len(a))}
            got = chosen_path._joining(rows, some, sets, (8, 10))
            same = [(f"l{r[5]}", k) for k, r in enumerate(rows)]
            ids = [*range(n), *{x for x, _ in same}]
            order = {x: k for k, x in enumerate(ids)}
            number = lambda pairs: [(order[a], order[b]) for a, b in pairs]
            assert set(got) <= links and roots(number([*got, *same]), range(len(ids))) == roots(number([*links, *same]), range(len(ids)))


class Frame:
    """Stands for any table; gives what is mapped over it."""

    def __getattr__(self, name):
        return lambda *columns: self

    def mapInArrow(self, run, schema):
        return run


def test_near_copies_of_a_node_are_not_compared_pair_by_pair():
    """One task with a node of 1500 near copies, no two alike: a million pairs, but all are joined once a
    row has been compared with the others."""
    draw = np.random.default_rng(6)
    base = draw.integers(0, 1 << 60, 200)
    sets = [np.unique(np.append(base, draw.integers(0, 1 << 60, 12))) for _ in range(1500)]
    rows = [(7, 0, 0, 0, k.to_bytes(2), k.to_bytes(2), bytes(64), [7, 11, 12]) for k in range(len(sets))]
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), chosen_path._ROW.values())]
    batch = pa.RecordBatch.from_arrays([*columns, chosen_path._lists(sets)], names=[*chosen_path._ROW, "shingles"])
    began = time.process_time()
    found = chosen_path.block_links(Frame(), Frame(), (80, 100))([batch])
    assert sum(links.num_rows for links in found) == len(sets) - 1
    assert time.process_time() - began < 10


def test_stars_need_no_round(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(graph, "written", lambda df, name, **how: tables.append(name) or session.written(df, name, **how))
    stars = spark.range(60).selectExpr("id as a", "id % 3 as b")
    assert {(r["id"], r["root"]) for r in components(stars).collect()} == {(k, k % 3) for k in range(60)}
    assert tables == ["links"]
