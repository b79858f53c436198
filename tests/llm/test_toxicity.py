import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from histloom.llm import hashing, toxicity

SF = "/root/testdata/sf0.1"


def plain_words(text):
    data = text.encode()
    lowered = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in data)
    out, word = [], b""
    for b in lowered + b" ":
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            word += bytes([b])
        elif word:
            out.append(word)
            word = b""
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aBé 0.\n-", max_size=30), max_size=6))
def test_equal_words_have_equal_hashes(texts):
    rows, found = hashing.words(pa.array(texts, pa.string()))
    want = [(i, w) for i, t in enumerate(texts) for w in plain_words(t)]
    assert rows.tolist() == [i for i, _ in want]
    names = {}
    for (_, word), h in zip(want, found.tolist()):
        assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


def test_blocks_do_not_change_hashes(monkeypatch):
    text = pa.array(["some words and " + "x" * 50 + " more, words " * 40, "", "words", "y" * 300])
    want = hashing.words(text)
    monkeypatch.setattr(hashing, "BLOCK", 16)
    got = hashing.words(text)
    assert all(np.array_equal(a, b) for a, b in zip(want, got))


def test_features_stay_within_a_text():
    alone = [toxicity.features(pa.array([t]))[1].tolist() for t in ("a b c", "d e")]
    rows, keys = toxicity.features(pa.array(["a b c", "d e"]))
    assert [sorted(keys[rows == i].tolist()) for i in (0, 1)] == [sorted(k) for k in alone]


def test_held_out_rows(spark):
    got = {r[0]: r[1] for r in spark.range(200).select("id", toxicity.held_out("id")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_finds_toxic_texts_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    weights = toxicity.fit(docs, labels)
    assert 0 < len(weights) < 5_000
    got = toxicity.predictions(toxicity.score(docs, weights)).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.75 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)


def plain_ftrl(rows, labels, model, seed):
    """The same learner with a dictionary per state and one coordinate at a time."""
    seen = {}
    for x in rows:
        for f in x:
            seen[f] = seen.get(f, 0) + 1
    z, n = {}, {}

    def weight(f):
        bound = 0.0 if f == toxicity.BIAS else model.l1
        if abs(z.get(f, 0.0)) <= bound:
            return 0.0
        sign = 1.0 if z[f] > 0 else -1.0
        return -(z[f] - sign * bound) / ((model.beta + n.get(f, 0.0) ** 0.5) / model.alpha + model.l2)

    order = np.random.default_rng(seed)
    for _ in range(model.passes):
        for i in order.permutation(len(rows)):
            x = [f for f in rows[i] if seen[f] >= model.min_rows] + [toxicity.BIAS]
            now = {f: weight(f) for f in x}
            g = 1 / (1 + math.exp(-sum(now.values()))) - labels[i]
            for f in x:
                old = n.get(f, 0.0)
                sigma = ((old + g * g) ** 0.5 - old**0.5) / model.alpha
                z[f] = z.get(f, 0.0) + g - sigma * now[f]
                n[f] = old + g * g
    return {f: w for f in z if (w := weight(f)) != 0.0}


@pytest.mark.parametrize("model", [toxicity.Ftrl(), toxicity.Ftrl(alpha=0.3, l1=0.5, l2=0.2, passes=2, min_rows=1)])
def test_weights_are_those_of_the_plain_learner(model):
    draw = np.random.default_rng(3)
    rows = [np.unique(draw.integers(0, 60, draw.integers(0, 20))).astype(np.int32) for _ in range(400)]
    labels = np.array([float(len(np.intersect1d(x, [3, 7, 11])) > 0) for x in rows])
    keys, weights = model.fit(rows, labels, seed=5)
    want = plain_ftrl([x.tolist() for x in rows], labels, model, seed=5)
    assert set(keys.tolist()) == set(want) and 3 < len(want) <= 61
    assert all(w == pytest.approx(want[k], rel=1e-9) for k, w in zip(keys.tolist(), weights))


def test_scores_are_sums_of_weights(spark):
    weights = {toxicity.BIAS: -0.5} | {k: 0.01 * (i + 1) for i, k in enumerate(np.unique(toxicity.features(pa.array(["a b c a b", "x y"]))[1]).tolist())}
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "x y"), (3, "q"), (4, None)], "doc_id long, text string")
    for r in toxicity.score(docs, weights).join(docs, "doc_id").collect():
        keys = set(toxicity.features(pa.array([r["text"] or ""]))[1].tolist())
        want = -0.5 + sum(weights.get(k, 0.0) for k in keys)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-want)), rel=1e-12)


def test_a_labelled_id_of_many_rows_is_bounded(spark, monkeypatch):
    """Rows of one id, copies among them, do not fill a shard; copies teach as one row does."""
    docs = spark.range(3_000).selectExpr("case when id < 2000 then 1 else id end as doc_id", "concat('bad w', id % 1500) as text")
    labels = docs.selectExpr("doc_id", "case when doc_id = 1 then 1 else 0 end as toxic").distinct()

    class Seen(toxicity.Ftrl):
        def fit(self, rows, labels, seed):
            return np.array([seed]), np.array([float(len(rows))])

    monkeypatch.setattr(toxicity, "ROWS_PER_SHARD", 100)
    got = toxicity.fit(docs, labels, model=Seen(), max_rows=400)
    rows = sum(got.values()) * len(got)  # means over the shards
    assert len(got) >= 3 and 200 < rows < 500
    monkeypatch.setattr(toxicity, "BYTES_PER_SHARD", 400)
    assert len(toxicity.fit(docs, labels, model=Seen(), max_rows=400)) > len(got)
    one = docs.limit(1).selectExpr("1L as doc_id", "text")
    assert toxicity.fit(one.union(one).union(one), labels, model=Seen()) == toxicity.fit(one, labels, model=Seen())


def test_held_out_labels_and_other_columns_change_nothing(spark):
    sf = SF.replace("0.1", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = toxicity.fit(docs, labels)
    other = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert toxicity.fit(docs.withColumn("lang", toxicity.F.lit("xx")), other) == want


@pytest.fixture()
def odd(spark):
    rows = [(1, "an idiot"), (2, None), (3, ""), (None, "no id"), (4, "w " * 100_000), (1, "an idiot"), (5, "clean")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0.5 as score", "1 as _id", "2 as shard")


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (2, 1), (3, None), (9, 1)], "doc_id long, toxic int")
    weights = toxicity.fit(odd, labels)
    got = toxicity.predictions(toxicity.score(odd, weights)).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    scored = toxicity.with_score(odd, weights)
    assert scored.columns == [*odd.columns, "_score"] and scored.count() == 7


def test_no_labels_and_no_rows(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    weights = toxicity.fit(odd, labels)
    assert max(r["score"] for r in toxicity.score(odd, weights).collect()) < 1e-9
    assert {r["score"] for r in toxicity.score(odd, {}).collect()} == {0.5}
    assert toxicity.score(odd.limit(0), {}).count() == 0
