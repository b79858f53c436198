"""Joins, group limits and nested records that hold up when one key has a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histloom.session import written

HOT_ROWS = 1_000_000
KEYLESS_SALTS = 4_096
PAGE_ROWS = 100_000
MOST_RANGES, LEAST_RANGE = 20_000, 10_000


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """The keys with more than `min_rows` rows, and how often that is (`salts`).

    There are at most rows / `min_rows` of them, so the table is small beside `df`; whether it
    is small enough to broadcast is left to Spark's measurement.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_rows)
    return counts.select(*keys, F.ceil(F.col("_n") / min_rows).cast("int").alias("salts"))


def _salt(columns: Sequence[Column], salts: int | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] | None = None,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a large `left` with a `right` that has few rows per key, spreading hot left keys.

    A hot key gets one salt per `min_rows` rows: its rows take a salt by a hash of `spread_by`
    (a unique row id where there is one), and the matching right rows are repeated once per
    salt, which adds no more than left rows / `min_rows` copies in all. Other keys have the one
    salt 0, so their rows move as in a plain join. Rows without a key, which match nothing, are
    spread as well. Spark still turns this into a broadcast join when it measures `right` to be
    small. The salt is a hash of the row, so a task that runs again after a lost executor sends
    every row to the same place.
    """
    on = list(on)
    hot = hot_keys(left, on, min_rows).withColumnRenamed("salts", "_salts")
    spread = [F.col(c) for c in (spread_by or _hashable(left))]
    keyless = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    salt = (
        F.when(F.col("_salts").isNotNull(), _salt(spread, F.col("_salts")))
        .when(keyless, _salt(spread, KEYLESS_SALTS))
        .otherwise(F.lit(0))
    )
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_left = left.join(hot, on, "left").withColumn("_salt", salt).drop("_salts")
    salted_right = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def first_per_group(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int, rank: str = "rn"
) -> DataFrame:
    """The first `n` rows of every group, with their 1-based rank.

    Spark drops rows past rank `n` before the shuffle, up to n = 1000. For a larger `n`, or many
    map tasks with n rows each, the one task of a hot group would still get too much: the groups
    are first cut into hashed parts, each limited on its own, and what reaches the final task is
    n rows per part.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    if n > 50:
        part = _salt([F.col(c) for c in _hashable(df)], 128)
        pre = Window.partitionBy(*keys, part).orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(pre)).filter(F.col(rank) <= n).drop(rank)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def ranged(df: DataFrame, order: Sequence[str], parts: int, into: str) -> DataFrame:
    """`df` as a written table, cut into about `parts` ranges of `order` that hold about as many
    rows each; `into` numbers the ranges in order. Parts beyond MOST_RANGES make ranges larger."""
    spread = df.repartitionByRange(max(1, min(parts, MOST_RANGES)), *order)
    return written(spread.withColumn(into, F.spark_partition_id()), "ranges")


def paged(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], page_rows: int = PAGE_ROWS, into: str = "part"
) -> DataFrame:
    """Number the pages of every group: page p holds its rows p * `page_rows` up to the next
    page in `order`, so pages are dense, in order, and full but for the last.

    `order` is unique within a group; nulls come first, as Spark sorts them. A group of one page
    needs no rank. The rows of larger groups are cut by a range partitioning over keys and order:
    Spark draws its splitters from a sample of the rows, so a group takes as many tasks as it has
    pages wherever its values lie, with outliers, repeated or missing first values. Ranks inside
    a range are shifted by the counts of the ranges before. The rows of large groups are written
    once; `df` is read three times: hand in a table rather than the end of a long plan.
    """
    keys = list(keys)
    names = [f"_k{i}" for i in range(len(keys))]
    sizes = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("_n"))
    sizes = written(sizes.filter(F.col("_n") > page_rows), "page-sizes")
    rows = sizes.agg(F.sum("_n")).first()[0]
    if rows is None:
        return df.withColumn(into, F.lit(0))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    one = df.join(sizes, same, "left_anti").withColumn(into, F.lit(0))
    parts = min(-(-rows // page_rows), max(64, rows // LEAST_RANGE))  # pages of few rows share a range
    large = ranged(df.join(sizes, same, "left_semi"), [*keys, *order], parts, "_slot")
    before = Window.partitionBy(*names).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        large.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_slot").alias("_at"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*names, "_at", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(*order))
    pages = (
        large.withColumn("_rn", inside)
        .join(starts, same & (F.col("_slot") == F.col("_at")))
        .withColumn(into, F.floor((F.col("_start") + F.col("_rn") - 1) / page_rows).cast("int"))
    )
    return one.unionByName(pages.select(*one.columns))


def nest(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str | Column],
    into: str,
    max_rows: int = PAGE_ROWS,
) -> DataFrame:
    """Collect rows to ordered arrays, one record per group and page (see `paged`): `part` 0 has
    the first `max_rows` rows of the group, and so on. No record holds an unbounded group, and
    the arrays of a group in the order of `part` are the whole group in order."""
    keys = list(keys)
    item = F.struct(F.struct(*order).alias("_o"), F.struct(*fields).alias("_v"))
    return (
        paged(df, keys, order, max_rows)
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(item)).alias(into))
        .withColumn(into, F.transform(into, lambda x: x["_v"]))
    )
