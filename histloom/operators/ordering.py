"""Ordered logic per group, sampling and splits.

File order has no meaning in Spark, so every operator takes explicit order columns. Only ranks
up to a small bound are ever computed inside a group; what lies beyond the bound is told apart
by a join on a unique row id, never by sorting the whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histloom import constants as K
from histloom.operators.skew import first_per_group

HASH_DIGITS = 4  # 16**4 buckets: the bound of every bucket table below


def leave_last_out(df: DataFrame, user: str, time: str, seq: str) -> DataFrame:
    """Mark each row `heldout` (the user's last by time, then by `seq`) or `history`.

    Users with a single row are dropped. A missing epoch time counts as 0. The last row of each user
    comes from a partially aggregated maximum and is joined back on the unique (user, seq), so
    a user with a third of all rows is spread like any other.
    """
    numeric = isinstance(df.schema[time].dataType, T.NumericType)
    when = F.coalesce(F.col(time), F.lit(0)) if numeric else F.col(time)
    last = (
        df.groupBy(user)
        .agg(F.max(F.struct(when.alias("t"), F.col(seq).alias("s"))).alias("m"), F.count(F.lit(1)).alias("_n"))
        .select(user, F.col("m.s").alias(seq), "_n")
    )
    return (
        df.join(last, [user, seq], "left")
        .filter(F.col("_n").isNull() | (F.col("_n") >= 2))
        .withColumn("role", F.when(F.col("_n").isNull(), "history").otherwise("heldout"))
        .drop("_n")
    )


def split_name(index: Column, cuts: tuple[int, int] = K.SPLIT_CUTS) -> Column:
    """The split of a user by rank (from 0) among the users of the category."""
    return (
        F.when(index < cuts[0], "training").when(index < cuts[1], "validation").otherwise("test")
    )


def rank_split(
    users: DataFrame, category: str, user: str, cuts: tuple[int, int] = K.SPLIT_CUTS
) -> DataFrame:
    """Split the users of each category by their rank in id order: train, validation, test.

    Only ranks below the last cut are computed; every other user is test.
    """
    ranked = first_per_group(users.select(category, user), [category], [F.col(user)], cuts[1], "_rn")
    named = ranked.withColumn("split", split_name(F.col("_rn") - 1, cuts)).drop("_rn")
    return users.join(named, [category, user], "left").withColumn(
        "split", F.coalesce("split", F.lit("test"))
    )


def full_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first `n` rows of each group that has at least `n` rows, with their rank `rn`."""
    w = Window.partitionBy(*keys)
    return (
        first_per_group(df, keys, order, n)
        .withColumn("_n", F.count(F.lit(1)).over(w))
        .filter(F.col("_n") == n)
        .drop("_n")
    )


def first_distinct(df: DataFrame, category: str, user: str, seq: str, n: int) -> DataFrame:
    """The first `n` distinct users of each category in scan order, with the row they appear in."""
    firsts = (
        df.filter(F.col(user).cast("string") != "")
        .groupBy(category, user)
        .agg(F.min(seq).alias("first_seq"))
    )
    return first_per_group(firsts, [category], [F.col("first_seq"), F.col(user)], n)


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in `order`. `order` must be unique within a key."""
    return _keep(df, keys, [F.col(o).asc() for o in order])


def keep_last(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in `order`: a later row overwrites an earlier one."""
    return _keep(df, keys, [F.col(o).desc() for o in order])


def _keep(df: DataFrame, keys, order) -> DataFrame:
    """The row of rank 1 per key. Spark drops other rows before the shuffle, so a hot key sends
    one row per map task."""
    w = Window.partitionBy(*[F.col(k) if isinstance(k, str) else k for k in keys]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _stretches(df: DataFrame, seq: str, parts: int) -> DataFrame:
    """`df` with `_b`, the number of the stretch of about equal size that `seq` lies in. The
    bounds are quantiles of the column, so they follow its values however sparse these are."""
    cuts = sorted(set(df.approxQuantile(seq, [i / parts for i in range(1, parts)], 0.25 / parts)))
    if not cuts:
        return df.withColumn("_b", F.lit(0))
    bounds = [float("-inf"), *cuts, float("inf")]
    placed = df.withColumn("_x", F.col(seq).cast("double"))
    return Bucketizer(splits=bounds, inputCol="_x", outputCol="_b").transform(placed).drop("_x")


def row_index(df: DataFrame, seq: str, into: str = "row_index", parts: int = 1024) -> DataFrame:
    """A dense index from 0 in the order of a unique numeric column.

    Rows are numbered inside `parts` stretches of about equal size and shifted by the count of
    the rows before; there is no sort of the whole table in one task. `df` is read once more, for
    the quantiles that bound the stretches.
    """
    cut = _stretches(df, seq, parts)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per stretch
    offsets = (
        cut.groupBy("_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("_b", "_start")
    )
    inside = Window.partitionBy("_b").orderBy(seq)
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, "_b")
        .withColumn(into, F.col("_start") + F.col("_rn") - 1)
        .drop("_b", "_rn", "_start")
    )


def row_range(df: DataFrame, seq: str, start: int, end: int = -1) -> DataFrame:
    """Rows with index `start` <= i < `end` in the order of `seq`; `end` = -1 is no end."""
    indexed = row_index(df, seq)
    keep = F.col("row_index") >= start
    return indexed.filter(keep if end == -1 else keep & (F.col("row_index") < end))


def draw_key(seed: int, row_id: Column) -> Column:
    """A uniform, repeatable order of rows: the md5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def _key_of_rank(keyed: DataFrame, rank: Column) -> DataFrame:
    """One row, `_h`: the key that stands at `rank` (an expression of `_all`, the number of rows)
    in the order of the column `_h` of `keyed`; no row if there is none.

    It is found by counting rows per leading digits (at most 16**HASH_DIGITS buckets) and ranking
    the rows of the single bucket in which the rank falls; the table is not sorted.
    """
    heads = keyed.select("_h", F.left("_h", F.lit(HASH_DIGITS)).alias("_b"))
    running = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    upto, size = F.col("_upto"), F.col("_n")
    bucket = (
        heads.groupBy("_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_all", F.sum("_n").over(Window.partitionBy()))
        .withColumn("_want", rank)
        .filter((upto >= F.col("_want")) & (upto - size < F.col("_want")))
        .select("_b", (F.col("_want") - upto + size).alias("_need"))
    )
    inside = Window.partitionBy("_b").orderBy("_h")
    ranked = heads.join(F.broadcast(bucket), "_b").withColumn("_rn", F.row_number().over(inside))  # one bucket
    return ranked.filter(F.col("_rn") == F.col("_need")).select("_h")


def uniform_sample(
    df: DataFrame, row_id: str, k: int, seed: int, seq: str | None = None, max_rows: int | None = None
) -> DataFrame:
    """`k` rows drawn without replacement, from the first `max_rows` rows by `seq` if given.

    The rows up to the k-th key of the random order are taken where they are; `row_id` is unique.
    """
    if max_rows is not None:
        df = df.orderBy(seq).limit(max_rows)
    keyed = df.withColumn("_h", draw_key(seed, F.col(row_id)))
    last = _key_of_rank(keyed, F.least(F.col("_all"), F.lit(k)))
    return keyed.filter(F.col("_h") <= last.scalar()).drop("_h")


def stratified_sample(
    df: DataFrame, level: str, row_id: str, sizes: dict[int, int], seed: int
) -> DataFrame:
    """Up to `sizes[level]` rows of each level; levels as text count, unknown levels are left out."""
    wanted = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    known = df.withColumn("_level", F.expr(f"try_cast(trim(`{level}`) as int)")).filter(
        F.col("_level").isin(list(sizes))
    )
    order = [draw_key(seed, F.col(row_id)), F.col(row_id)]
    ranked = first_per_group(known, ["_level"], order, max(sizes.values()), "_rn")
    return ranked.filter(F.col("_rn") <= wanted[F.col("_level")]).drop("_rn", "_level")


def share_split(
    df: DataFrame, row_id: str, seed: int, share: float, names: tuple[str, str] = ("train", "val")
) -> DataFrame:
    """Split at random with exact sizes: ceil(share x rows) rows are `names[1]`, the rest `names[0]`.

    The cut is one md5 value, so the table is read a few times but never shuffled or sorted.
    """
    keyed = df.withColumn("_h", draw_key(seed, F.col(row_id)))
    last = _key_of_rank(keyed, F.ceil(F.col("_all") * share))
    held = F.coalesce(F.col("_h") <= last.scalar(), F.lit(False))
    return keyed.withColumn("split", F.when(held, names[1]).otherwise(names[0])).drop("_h")


def sized_split(
    users: DataFrame,
    user: str,
    seed: int,
    sizes: tuple[int, int, int] = K.COMMUNITY_SPLIT,
    shares: tuple[float, float] = K.COMMUNITY_SPLIT_SHARES,
) -> DataFrame:
    """Draw train, val and test users of fixed sizes; with too few users, by shares of them.

    Only the first sum(sizes) users of the random order matter, which also tells whether there
    are enough of them.
    """
    train, val, test = sizes
    drawn = users.orderBy(draw_key(seed, F.col(user)), user).limit(sum(sizes))
    w = Window.orderBy(draw_key(seed, F.col(user)), user)
    everyone = Window.partitionBy()
    ranked = drawn.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_n", F.count(F.lit(1)).over(everyone)
    )
    enough = F.col("_n") >= sum(sizes)
    train_end = F.when(enough, train).otherwise(F.floor(F.col("_n") * shares[0]))
    val_end = F.when(enough, train + val).otherwise(F.floor(F.col("_n") * shares[1]))
    return (
        ranked.withColumn(
            "split",
            F.when(F.col("_rn") <= train_end, "train")
            .when(F.col("_rn") <= val_end, "val")
            .when(F.col("_rn") <= val_end + test, "test"),
        )
        .filter(F.col("split").isNotNull())
        .drop("_rn", "_n")
    )


def bottom_k(df: DataFrame, score: str, seq: str, k: int) -> DataFrame:
    """The `k` rows with the lowest score, earlier rows first on ties."""
    return df.orderBy(F.col(score).asc(), F.col(seq).asc()).limit(k)


def first_date_in_month(
    reviews: DataFrame, users: DataFrame, user: str, day: str, selection: str
) -> DataFrame:
    """Replace each user's selection date by their first review date in that month, if any."""
    firsts = (
        reviews.filter(F.col(day).isNotNull())
        .groupBy(user, F.trunc(day, "month").alias("_month"))
        .agg(F.min(day).alias("_first"))
    )
    return (
        users.withColumn("_month", F.trunc(selection, "month"))
        .join(firsts, [user, "_month"], "left")
        .withColumn(selection, F.coalesce("_first", selection))
        .drop("_month", "_first")
    )
