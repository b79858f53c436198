"""Hot keys, large groups and numbering: the same results however the rows are spread."""

import random

from pyspark.sql import functions as F

from histloom.operators import ordering as O
from histloom.operators import skew as S


def rows(spark, n=3000, seed=1):
    """A third of the rows belong to one key, some have no key."""
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else None if i % 31 == 0 else f"k{rnd.randrange(200)}"
        data.append((key, i, rnd.randrange(50)))
    return spark.createDataFrame(data, "k string, id long, v long")


def test_hot_keys_are_few(spark):
    df = rows(spark)
    assert [tuple(r) for r in S.hot_keys(df, ["k"], min_rows=300).collect()] == [("hot", 4)]
    assert S.hot_keys(df, ["k"], min_rows=10_000).count() == 0


def test_lookup_join_equals_plain_join(spark):
    left = rows(spark)
    right = left.select("k").distinct().filter("k <> 'k7'").withColumn("name", F.upper("k"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = left.join(right, ["k"], how)
        for salted in (
            S.lookup_join(left, right, ["k"], how, spread_by=["id"], min_rows=10),
            S.lookup_join(left, right, ["k"], how, min_rows=100),
        ):
            assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))


def test_hot_key_is_spread(spark):
    """With salts, no shuffle partition of the join holds the hot key alone."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = rows(spark)
        right = left.select("k").distinct().withColumn("name", F.upper("k"))

        def places(df):
            found = df.filter("k = 'hot'").withColumn("p", F.spark_partition_id())
            return found.groupBy("p").count().count()

        assert places(left.join(right, ["k"])) == 1
        assert places(S.lookup_join(left, right, ["k"], "inner", spread_by=["id"], min_rows=50)) > 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_first_per_group_large_n(spark):
    df = rows(spark)
    got = S.first_per_group(df, ["k"], [F.col("v"), F.col("id")], 120)
    want = {}
    for r in df.collect():
        want.setdefault(r.k, []).append((r.v, r.id))
    expected = sorted((str(k), *x) for k, xs in want.items() for x in sorted(xs)[:120])
    assert sorted((str(r.k), r.v, r.id) for r in got.collect()) == expected


def test_nest_pages_are_dense_and_in_order(spark):
    df = rows(spark).filter("k is not null")
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append((r.v, r.id))
    want = {}
    for k, items in groups.items():
        ids = [i for _, i in sorted(items)]
        want.update({(k, n // 7): ids[n : n + 7] for n in range(0, len(ids), 7)})
    got = S.nest(df, ["k"], ["v", "id"], ["id"], "items", max_rows=7).collect()
    assert {(r.k, r.part): [x.id for x in r["items"]] for r in got} == want and len(got) == len(want)


def uneven(spark, n=4_000):
    """One group with an outlier, missing times and a time that a third of its rows share; a
    group without key; small groups."""
    data = [("hot", 10**15, 0), ("hot", None, 1), ("hot", None, 2)]
    data += [("hot", 7 if i % 3 == 0 else i, i) for i in range(3, n)]
    data += [(None, i % 5, i) for i in range(n, n + 90)] + [(f"k{i % 20}", i, i) for i in range(n + 90, n + 150)]
    random.Random(2).shuffle(data)
    return spark.createDataFrame(data, "k string, t long, id long"), data


def test_pages_with_an_outlier_ties_and_missing_values(spark):
    df, data = uneven(spark)
    groups = {}
    for k, t, i in data:
        groups.setdefault(k, []).append((t is not None, t, i))
    want = {}
    for k, items in groups.items():
        ids = [x[-1] for x in sorted(items, key=lambda x: (x[0], x[1] or 0, x[2]))]
        want |= {(k, i): n // 40 for n, i in enumerate(ids)}
    got = S.paged(df.repartition(7), ["k"], ["t", "id"], 40)
    assert got.columns == ["k", "t", "id", "part"]
    assert {(r.k, r.id): r.part for r in got.collect()} == want


def test_ranges_of_an_uneven_group_are_even(spark):
    df, _ = uneven(spark)
    hot = df.filter("k = 'hot'").repartition(7)
    sizes = [r["count"] for r in S.ranged(hot, ["k", "t", "id"], 100, "slot").groupBy("slot").count().collect()]
    assert len(sizes) > 80 and max(sizes) < 3 * 40


def test_row_index_over_many_stretches(spark):
    df = spark.range(0, 5000).filter("id % 3 <> 1").withColumn("id", F.col("id") * 7)
    got = {r.id: r.row_index for r in O.row_index(df, "id", parts=50).collect()}
    assert got == {x: n for n, x in enumerate(sorted(got))}


def test_leave_last_out_ties_and_single_rows(spark):
    data = [("a", 5, 1), ("a", 5, 2), ("a", None, 3), ("b", 1, 4), ("c", None, 5), ("c", None, 6)]
    df = spark.createDataFrame(data, "u string, t long, s long")
    got = {r.s: r.role for r in O.leave_last_out(df, "u", "t", "s").collect()}
    assert got == {1: "history", 2: "heldout", 3: "history", 5: "history", 6: "heldout"}


def test_leave_last_out_random(spark):
    rnd = random.Random(3)
    data = [(rnd.randrange(40), rnd.randrange(5), i) for i in range(500)]
    df = spark.createDataFrame(data, "u long, t long, s long")
    users = {}
    for u, t, s in data:
        users.setdefault(u, []).append((t, s))
    want = {s: "heldout" if (t, s) == max(xs) else "history" for xs in users.values() if len(xs) > 1 for t, s in xs}
    assert {r.s: r.role for r in O.leave_last_out(df, "u", "t", "s").collect()} == want


def test_share_split_sizes(spark):
    for n in (1, 9, 10, 11, 1000):
        got = O.share_split(spark.range(n), "id", 42, 0.1).groupBy("split").count().collect()
        sizes = {r.split: r["count"] for r in got}
        assert sizes.get("val", 0) == -(-n // 10) and sum(sizes.values()) == n


def test_sized_split_sizes(spark):
    def sizes(n):
        return {r.split: r["count"] for r in O.sized_split(spark.range(n), "id", 1).groupBy("split").count().collect()}

    assert sizes(500) == {"train": 50, "val": 20, "test": 10}
    assert sizes(79) == {"train": 55, "val": 16, "test": 8}
    assert sizes(10) == {"train": 7, "val": 2, "test": 1}


def test_stratified_sample_levels(spark):
    data = [(i, lvl) for i, lvl in enumerate(["1"] * 30 + [" 2"] * 4 + ["x"] * 5 + [None] + ["3"] * 9)]
    df = spark.createDataFrame(data, "id long, level string")
    got = O.stratified_sample(df, "level", "id", {1: 10, 2: 10, 3: 5}, 42).collect()
    levels = [r.level.strip() for r in got]
    assert {x: levels.count(x) for x in set(levels)} == {"1": 10, "2": 4, "3": 5}


def test_keep_first_and_last(spark):
    rnd = random.Random(5)
    data = [(f"s{rnd.randrange(6)}", f"a{rnd.randrange(4)}", i) for i in range(200)]
    df = spark.createDataFrame(data, "s string, a string, seq long")
    first, last = {}, {}
    for s, a, i in data:
        first.setdefault((s, a), i)
        last[(s, a)] = i
    assert {(r.s, r.a): r.seq for r in O.keep_first(df, ["s", "a"], ["seq"]).collect()} == first
    assert {(r.s, r.a): r.seq for r in O.keep_last(df, ["s", "a"], ["seq"]).collect()} == last
