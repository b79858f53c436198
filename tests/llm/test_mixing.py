import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from histloom.llm import mixing


def tokens(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def md5(epoch, doc_id):
    return hashlib.md5(f"mix|{epoch}|{'' if doc_id is None else doc_id}".encode()).hexdigest()


def plain_budgets(rows, exponent, budget=None):
    total = {}
    for _, source, text in rows:
        total[source] = total.get(source, 0) + tokens(text)
    everything = sum(total.values())
    power = {s: (t / everything) ** exponent for s, t in total.items() if t}
    norm = sum(power.values())
    budget = budget or max(total[s] / p for s, p in power.items()) * norm
    return total, {s: math.floor(budget * p / norm + 0.5) for s, p in power.items()}


def plain_mix(rows, exponent, budget=None):
    total, budgets = plain_budgets(rows, exponent, budget)
    out = []
    for source in total:
        own = [r for r in rows if r[1] == source]
        passes, room = divmod(budgets[source], total[source]) if total[source] else (1, 0)
        out += [(i, source, e) for e in range(passes) for i, _, _ in own]
        used = 0
        for i, _, text in sorted(own, key=lambda r: (md5(passes, r[0]), tokens(r[2]))) if room else []:
            used += tokens(text)
            if used > room:
                break
            out.append((i, source, passes))
    return sorted(out, key=str)


ROWS = [(i, f"s{i % 7 % 4}", "w " * (i * 37 % 90)) for i in range(400)]
ROWS += [(400 + i, None, "a b c") for i in range(5)] + [(500, "empty", None), (501, "empty", ""), (502, "", "x " * 9)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def found(docs, **how):
    got = mixing.mix(docs, **how)
    assert got.columns == [*docs.columns, "_epoch", "_place"]
    rows = got.collect()
    assert all(r["_place"] == md5(r["_epoch"], r["doc_id"]) for r in rows)
    return sorted(((r["doc_id"], r["source"], r["_epoch"]) for r in rows), key=str)


@pytest.mark.parametrize("repeats", [1.0, 1.5, 2.0, 3.7])
def test_limit_of_repetition(spark, repeats):
    total, _ = plain_budgets(ROWS, 1.0)
    shares = [t for t in total.values() if t]
    exponent = max(0.0, 1 + math.log(repeats) / math.log(min(shares) / max(shares)))
    assert found(table(spark, ROWS), max_repeats=repeats) == plain_mix(ROWS, exponent)


@pytest.mark.parametrize("budget,repeats", [(3000, 1.0), (9000, 2.5)])
def test_given_budget(spark, budget, repeats):
    sources = table(spark, ROWS).groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("tokens"))
    everything = sum(tokens(t) for _, _, t in ROWS)
    sources = sources.withColumn("share", F.when(F.col("tokens") > 0, F.col("tokens") / everything))
    exponent = mixing.exponent(sources, max_repeats=repeats, budget=budget)
    total, budgets = plain_budgets(ROWS, exponent, budget)
    assert max(b / total[s] for s, b in budgets.items()) <= repeats + 0.2
    got = found(table(spark, ROWS), max_repeats=repeats, budget=budget)
    assert got == plain_mix(ROWS, exponent, budget)


@pytest.mark.parametrize("bits", [0.5, 1.9, 2.0, 2.3, 9.0])
def test_target_entropy(spark, bits):
    def entropy(a):
        p = [t**a for t in plain_budgets(ROWS, 1.0)[0].values() if t]
        return -sum(x / sum(p) * math.log2(x / sum(p)) for x in p)

    rows = table(spark, ROWS).groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("tokens"))
    everything = sum(tokens(t) for _, _, t in ROWS)
    rows = rows.withColumn("share", F.when(F.col("tokens") > 0, F.col("tokens") / everything))
    if entropy(mixing.MOST_EXPONENT) > bits:
        with pytest.raises(ValueError, match="no exponent"):
            mixing.exponent(rows, target_entropy=bits)
        return
    a = mixing.exponent(rows, target_entropy=bits)
    if entropy(0.0) <= bits:
        assert a == 0.0
    else:
        assert abs(entropy(a) - bits) < 1e-9
        assert (a > 1) == (entropy(1.0) > bits)


def test_targets_that_nothing_meets(spark):
    equal = spark.createDataFrame([("a", 5, 0.5), ("b", 5, 0.5)], "source string, tokens long, share double")
    with pytest.raises(ValueError, match="no exponent"):
        mixing.exponent(equal, target_entropy=0.5)
    with pytest.raises(ValueError, match="no exponent"):
        mixing.exponent(equal, max_repeats=2.0, budget=21)
    assert mixing.exponent(equal, max_repeats=2.0, budget=20) == 0.0


def test_odd_tables(spark):
    docs = table(spark, ROWS).selectExpr("*", "1 as _source", "2 as passes", "3 as weight", "4 as n_tokens")
    with pytest.raises(ValueError):
        mixing.mix(docs)
    assert mixing.mix(table(spark, []), max_repeats=2.0).count() == 0
    assert found(table(spark, [(1, "a", None), (2, None, "")]), max_repeats=2.0) == [(1, "a", 0), (2, None, 0)]
    twice = [(1, "a", "x y"), (1, "a", "x y"), (None, "b", "x"), (3, "b", "z " * 50_000)]
    assert {r[0] for r in found(table(spark, twice), max_repeats=2.0)} == {1, None, 3}


def test_one_source_has_nearly_all_rows(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "case when id % 100 = 0 then concat('s', id % 700) else 'hot' end as source", "'a b' as text")
    counts = {r["source"]: r["count"] for r in mixing.mix(docs, max_repeats=4.0).groupBy("source").count().collect()}
    assert counts["hot"] == 29_700 and all(150 <= n <= 176 for s, n in counts.items() if s != "hot")
