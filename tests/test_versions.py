"""Tables in versions, and product knowledge on top of a saved state."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from histloom.operators import knowledge as G
from histloom.plans.communities import corpus
from histloom.session import scratch_path
from histloom.sources import versions as N

SCHEMA = "k long, v string"


def _rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def _read(spark, root, **where):
    return {r.k: r.v for r in N.read_version(spark, root, SCHEMA, ["k"], **where).collect()}


def _files(root):
    return {str(p) for p in Path(root, "data").rglob("*.parquet")}


def test_updates_touch_their_parts_and_readers_keep_their_version(spark):
    root, part = scratch_path(spark, "versions"), F.col("k") % 3
    assert _read(spark, root) == {}
    assert N.upsert(_rows(spark, [(k, "a") for k in range(9)]), root, part) == 1
    before = _files(root)
    reader = N.read_version(spark, root, SCHEMA, ["k"])
    assert N.upsert(_rows(spark, [(1, "b"), (4, None), (10, "b")]), root, part) == 2
    assert before < _files(root) and all("_part=1" in f for f in _files(root) - before)
    assert {r.v for r in reader.collect()} == {"a"} and reader.count() == 9
    want = {k: "a" for k in range(9)} | {1: "b", 4: None, 10: "b"}
    assert _read(spark, root) == want
    assert _read(spark, root, parts=["1"]) == {1: "b", 4: None, 7: "a", 10: "b"}
    assert _read(spark, root, version=1) == {k: "a" for k in range(9)}


def test_compaction_merges_full_parts_only(spark):
    root, part = scratch_path(spark, "versions"), F.col("k") % 2
    N.upsert(_rows(spark, [(k, "0") for k in range(4)]), root, part)
    for i in range(1, 4):
        N.upsert(_rows(spark, [(1, str(i))]), root, part)
    before = _files(root)
    assert N.compact(spark, root, SCHEMA, ["k"], part, most_deltas=3) == 5
    assert all("_part=1" in f for f in _files(root) - before)
    want = {0: "0", 1: "3", 2: "0", 3: "0"}
    assert _read(spark, root) == want and len(N.listed(spark, root, 5)) == 2
    assert N.compact(spark, root, SCHEMA, ["k"], part, most_deltas=3) == 5
    assert N.clean(spark, root, keep=1) == 4 and _read(spark, root) == want
    N.upsert(_rows(spark, [(1, "late")]), root, part)
    assert _read(spark, root) == want | {1: "late"}


def test_a_version_that_another_writer_took_is_tried_again(spark, monkeypatch):
    root, part = scratch_path(spark, "versions"), F.lit("all")
    N.upsert(_rows(spark, [(1, "a")]), root, part)
    write, raced = N._write, []

    def slow(rows, *where):
        done = write(rows, *where)
        if not raced:
            raced.append(1)
            N.upsert(_rows(spark, [(1, "other"), (2, "other")]), root, part)
        return done

    monkeypatch.setattr(N, "_write", slow)
    assert N.upsert(_rows(spark, [(1, "mine")]), root, part) == 3
    assert _read(spark, root) == {1: "mine", 2: "other"}
    assert _read(spark, root, version=2) == {1: "other", 2: "other"}


def test_rows_without_key_and_an_empty_update(spark):
    root = scratch_path(spark, "versions")
    N.upsert(_rows(spark, [(None, "x"), (1, "y")]), root, F.col("k"))
    N.upsert(_rows(spark, []), root, F.col("k"))
    N.upsert(_rows(spark, [(None, "z")]), root, F.col("k"))
    assert _read(spark, root) == {None: "z", 1: "y"}


LOG = "product string, seq long, pos int, op string, list string, value string"


def test_batches_equal_the_whole_log(spark):
    import random

    rng = random.Random(5)
    rows = [
        (rng.choice(["p", "q", None]), seq, pos, rng.choice(["add", "add", "remove", "note"]), "pros", rng.choice(["a", "b", "c", "d", None]))
        for seq in range(60) for pos in range(rng.randint(0, 4))
    ]
    whole = {tuple(r) for r in G.merge(spark.createDataFrame(rows, LOG).filter("product is not null and value is not null")).collect()}
    root = scratch_path(spark, "state")
    for low, high in ((0, 7), (7, 8), (8, 30), (30, 60)):
        batch = spark.createDataFrame([r for r in rows if low <= r[1] < high], LOG)
        N.upsert(G.advance(N.read_version(spark, root, G.STATE, G.ENTRY), batch), root, F.col("product"))
    state = N.read_version(spark, root, G.STATE, G.ENTRY)
    known = G.entries_of(state).filter("product is not null and value is not null")
    assert {tuple(r) for r in known.collect()} == whole
    with pytest.raises(ValueError):
        G.advance(state, spark.createDataFrame([("p", 59, 9, "add", "pros", "z")], LOG))


def test_corpus_reads_the_texts_once_and_cuts_hot_groups_in_parts(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(-1)).alias("u"), "id",
        F.when(F.col("id") % 7 == 0, "").when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.repeat(F.lit("xy"), (F.col("id") % 5).cast("int"))).alias("t"),
    )
    texts: dict[int, list[str]] = {}
    for r in df.orderBy("id").collect():
        texts.setdefault(r.u, []).append(r.t or "")
    got = corpus(df, ["u"], ["id"], "t", 300)
    assert {r.u: r.corpus for r in got.collect()} == {u: " ".join(ts)[:300] for u, ts in texts.items()}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
