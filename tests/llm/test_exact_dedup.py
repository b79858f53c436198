import hashlib
import re

import pytest

from histloom.llm import exact_dedup

ROWS = [
    (5, "a  b"), (3, "a\tb"), (9, "a b"), (4, "a b "), (1, None), (2, ""), (7, " "), (8, "\n\t "),
    (6, "A b"), (10, "é" * 50_000), (11, "é" * 50_000), (12, "a b"), (None, "alone"), (None, "both"), (13, "both"),
    (14, "twice"), (14, "twice"), (15, "twice"), (3, "other text, same id"),
]


def plain(rows):
    groups = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups.setdefault(key, []).append(i)
    out = []
    for key, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(key.encode()).hexdigest()
        out += [(i, least, len(ids), i == least, sha) for i in ids]
    return sorted(out, key=str)


@pytest.fixture()
def docs(spark):
    table = spark.createDataFrame(ROWS, "doc_id long, text string")
    return table.selectExpr("*", "1 as run", "2 as digest", "3 as keep_id", "4 as _id", "5 as group_size").repartition(3)


def test_classes(docs):
    got = exact_dedup.exact_classes(docs).collect()
    assert sorted(map(tuple, got), key=str) == plain(ROWS)


def test_kept_rows(docs):
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    wanted = {(i, t) for i, t in ROWS if i in (3, 4, 1, 7, 6, 10, 12, 13, 14)} | {(None, "alone")}
    assert got == sorted(wanted, key=str)


def test_every_copy_of_a_large_group(spark):
    docs = spark.range(20_000).selectExpr("id + 7 as doc_id", "case when id % 3 = 0 then 'same' else cast(id as string) end as text")
    got = exact_dedup.exact_classes(docs).groupBy("group_size", "kept").count().collect()
    assert {tuple(r) for r in got} == {(6667, True, 1), (6667, False, 6666), (1, True, 13_333)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_classes(docs).count() == 0
    assert exact_dedup.without_copies(docs).count() == 0


def test_merging_never_shuffles_by_digest_alone(docs):
    plan = exact_dedup.merge_runs(exact_dedup.leaf_runs(exact_dedup.digest_rows(docs)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(run") == 1 + exact_dedup.RUN_BITS // exact_dedup.ROUND_BITS


def test_every_round_merges_in_sorted_order(docs):
    merged = exact_dedup.merge_runs(exact_dedup.leaf_runs(exact_dedup.digest_rows(docs)))
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    rounds = exact_dedup.RUN_BITS // exact_dedup.ROUND_BITS
    sorts = re.findall(r"Sort \[run#\d+ ASC[^,]*, slice#\d+ ASC[^,]*, digest#\d+ ASC[^,]*, proof#\d+ ASC[^,]*, keep_id#", plan)
    assert len(sorts) == rounds and len(re.findall(r"[-+ ]Window \[", plan)) == rounds


def test_runs_grow_with_the_table_and_answers_do_not_change(docs, monkeypatch):
    assert [exact_dedup.run_bits(n) for n in (0, 1 << 24, (1 << 24) + 256, 1 << 28, 10**10)] == [8, 8, 12, 12, 20]
    monkeypatch.setattr(exact_dedup, "run_bits", lambda rows: 16)
    assert sorted(map(tuple, exact_dedup.exact_classes(docs).collect()), key=str) == plain(ROWS)
