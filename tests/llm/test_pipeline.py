import hashlib
import re
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline as pipeline
from histloom.llm import toxicity
from histloom.session import written
from test_chosen_path import plain as near_components
from test_mixing import plain_budgets, plain_mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in pipeline.STAGES] == [
        "toxicity", "exact dedup", "MinHash near-dedup", "mixing sources to target weights",
        "SentencePiece encoding and decoding",
    ]


def run_stages(spark, docs, sf):
    tables = [docs]
    for name, stage in pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], sf), "t"))
    return tables


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    return run_stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_each_stage_against_plain_python(spark, stages):
    docs, clean, unique, distinct, mixed, tokens = stages
    for table in (clean, unique, distinct, mixed):
        assert table.columns == COLUMNS
    weights = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, weights).collect()}
    assert sorted(ids(clean)) == sorted(i for i, s in scores.items() if s < pipeline.TOXIC_SCORE)

    rows = {r["doc_id"]: (re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["source"]) for r in clean.collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i][0], i)
    assert sorted(ids(unique)) == sorted(first.values())

    components = near_components([(i, rows[i][0]) for i in first.values()], 5)
    kept = [i for i, (n, c) in components.items() if i == c]
    assert sorted(ids(distinct)) == sorted(kept)

    left = [(i, rows[i][1], rows[i][0]) for i in kept]
    total, _ = plain_budgets(left, 1.0)
    import math

    exponent = max(0.0, 1 + math.log(pipeline.MAX_REPEATS) / math.log(min(total.values()) / max(total.values())))
    want = Counter(i for i, _, _ in plain_mix(left, exponent))
    assert Counter(ids(mixed)) == want and set(want) == set(kept)

    library = sentencepiece.SentencePieceProcessor(model_file=pipeline.PIECES)
    texts = {r["doc_id"]: r["text"] for r in distinct.collect()}
    for r in tokens.collect():
        known = library.encode(texts[r["doc_id"]])
        assert r["agrees"] and r["n_tokens"] == len(known)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, known)).encode()).hexdigest()
    assert Counter(ids(tokens)) == want


def test_run_gives_the_last_stage(spark, stages):
    got = pipeline.run(spark, "/root/testdata/sf0.01")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, stages[-1].collect()))


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clean = {r["doc_id"] for r in labels.filter("toxic = 0").collect()}
    kept = set(ids(stages[1]))
    assert len(clean - kept) <= 0.02 * len(clean)


CLASHING = [
    "_id", "score", "cls", "passes", "_score", "_epoch", "_place", "_key", "_mix_source", "_mix_cut", "_drop_id",
    "keep_id", "kept", "ids", "decoded", "n_tokens", "key", "weight", "root", "label", "_source", "_text",
]


def test_odd_rows_and_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    long = " ".join(f"w{i % 3000}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b", "en", "a", 3), (4, "a  b", "en", "b", 4),
        (None, "no id", "en", "b", 5), (5, long, "de", "c", len(long)), (6, long + "x", "de", None, 0), (3, "a b", "en", "a", 3),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", *[f"{i} as `{n}`" for i, n in enumerate(CLASHING)])
    tables = run_stages(spark, docs, sf)
    assert all(t.columns == docs.columns for t in tables[:-1])
    kept = set(ids(tables[-2]))
    assert kept == {1, 3, None, 5}
    assert all(t.count() == 0 for t in run_stages(spark, docs.limit(0), sf))


def test_near_copies_are_named_by_id_and_text(spark):
    """Of two texts with one id only the near copy goes; of two near copies with one id one stays."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text), (2, text + " more"), (2, "another text that nothing else is like at all"), (7, "x " + text[::-1]), (7, "y " + text[::-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as _row", "0 as _drop_id", "0 as _drop_digest")
    got = pipeline.near_stage(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"], r["text"][:7]) for r in got.collect())
    assert kept[:2] == [(1, "w0 w1 w"), (2, "another")] and len(kept) == 3 and kept[2][0] == 7
