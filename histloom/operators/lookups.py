"""Semi, left, inner and anti lookups, unions, differences and tallies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.operators.skew import lookup_join

#: Bits and hashes of a Bloom filter: 1 MB; about one row in 100 too many at 800,000 keys.
BLOOM_BITS, BLOOM_HASHES = 1 << 23, 3
#: Bitmaps of 4 KB of a filter that is a table: 4 MB at most; about one row in 300 too many at 1,800,000 keys.
SIEVE_BITMAPS, BITMAP_BITS = 1 << 10, 1 << 15


def each(
    df: DataFrame, listed: str | Column, keep: Sequence[str | Column], pos: str = "pos", item: str = "item"
) -> DataFrame:
    """One row per list element, with its position from 0.

    For a plain explode Spark adds a filter on the size of the list and pushes it to the scan,
    which computes the list twice; the outer explode does not.
    """
    rows = df.select(*keep, F.posexplode_outer(listed).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())


def bloom_filter(keys: DataFrame, on: Sequence[str]) -> Column:
    """A condition that holds for every row whose key is among `keys`, and for few others.

    Spark builds the bits: the places of all keys by hash, put together per bucket map-side. What
    comes to the driver and goes into the plan is at most BLOOM_BITS / 8 bytes, whatever the
    number of keys; with more keys than it is made for, the filter lets more rows through."""
    places = F.array(*[_place(on, i) for i in range(BLOOM_HASHES)])
    each_place = keys.select(F.explode(places).alias("_p"))
    next_ = F.col("_p") + 1  # these functions count from 1
    maps = each_place.groupBy((F.bitmap_bucket_number(next_) - 1).alias("_b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(next_)).alias("_m")
    )
    bits = bytearray(BLOOM_BITS // 8)
    for row in maps.collect():  # BLOOM_BITS / 32768 rows of 4 KB
        bits[row["_b"] * 4096 : row["_b"] * 4096 + 4096] = row["_m"]
    size, table = BLOOM_BITS, int.from_bytes(bits, "little")
    while size > 64 and table.bit_count() * 16 < size:  # few keys need few bits: fold the halves
        size //= 2
        table = (table >> size) | (table & ((1 << size) - 1))
    whole = F.lit(table.to_bytes(size // 8, "little"))

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(whole, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (place % 8).cast("int")) == 1

    return reduce(lambda a, b: a & b, [is_set(_place(on, i, size)) for i in range(BLOOM_HASHES)])


def _place(on: Sequence[str], i: int, size: int = BLOOM_BITS) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), *on), F.lit(size))


def reduced(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """`rows` without most of those that have no partner in `keys`, dropped where they are read:
    a join that follows shuffles little more than its result. Keys of another type than the rows'
    have other hashes: then all rows are left to the join."""
    if any(rows.schema[c].dataType != keys.schema[c].dataType for c in on):
        return rows
    return rows.filter(bloom_filter(keys.select(*on).distinct(), on))


def sieve(keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The Bloom filter of `keys` as a table of SIEVE_BITMAPS rows at most, for `sifted`.

    A key has its bits in one bitmap, whose number is a hash of it. Nothing comes to the plan, so
    a job can have many of them; write the table if `keys` is the end of a long plan."""
    places = F.array(*[_place(on, i, BITMAP_BITS) for i in range(BLOOM_HASHES)])
    each_place = keys.select(_place(on, -1, SIEVE_BITMAPS).alias("_bitmap"), F.explode(places).alias("_p"))
    return each_place.groupBy("_bitmap").agg(F.bitmap_construct_agg("_p").alias("_bits"))


def sifted(rows: DataFrame, kept: DataFrame, on: Sequence[str]) -> DataFrame:
    """`rows` whose key is among those of the `sieve` table `kept`, and few others. The table is broadcast, so rows
    are dropped where they are read and do not move. The keys' types are those of the rows."""

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (place % 8).cast("int")) == 1

    hit = reduce(lambda a, b: a & b, [is_set(_place(on, i, BITMAP_BITS)) for i in range(BLOOM_HASHES)])
    named = rows.withColumn("_bitmap", _place(on, -1, SIEVE_BITMAPS))
    return named.join(F.broadcast(kept), "_bitmap").filter(hit).select(*rows.columns)


def of_targets(rows: DataFrame, targets: DataFrame, on: Sequence[str], row_id: Sequence[str]) -> DataFrame:
    """Rows whose key is among the targets. Most others are dropped in the scan, before the rows
    are joined; a key with very many rows is spread."""
    return lookup_join(reduced(rows, targets, on), targets.select(*on), on, "left_semi", spread_by=row_id)


def needed(items: DataFrame, used: DataFrame, on: Sequence[str]) -> DataFrame:
    """Items that are used. The ids in use are made distinct first, so neither side is skewed, and
    most items that are not used are dropped in the scan."""
    return reduced(items, used, on).join(used.select(*on).distinct(), list(on), "left_semi")


def with_product(rows: DataFrame, products: DataFrame, on: str) -> DataFrame:
    """Rows with the product of their id; rows without one stay, with a null product.

    `products` has one row per id.
    """
    return lookup_join(rows, products, [on], "left")


def with_persona(users: DataFrame, personas: DataFrame) -> DataFrame:
    """Users with their persona; those with a missing or empty one drop out. A user may have
    very many rows, but only one persona."""
    return lookup_join(users, personas.filter(F.col("persona") != ""), ["user_id"], "inner")


def not_done(rows: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return lookup_join(rows, done.select(*on).distinct(), on, "left_anti")


def merged(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of several tables, matched by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Each id of two snapshots as `added`, `removed` or `same`."""
    old = before.select(key).distinct().withColumn("_old", F.lit(True))
    new = after.select(key).distinct().withColumn("_new", F.lit(True))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("same")
    return old.join(new, key, "full").select(key, state.alias("state"))


def frequent(rows: DataFrame, key: str, more_than: int) -> DataFrame:
    """Keys with more than so many rows, and their count."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)


def tally(rows: DataFrame, by: str) -> DataFrame:
    """Rows per value."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def accuracy_mae(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Share of equal values and mean absolute difference, in one row."""
    hit = (F.col(truth) == F.col(predicted)).cast("double")
    gap = F.abs(F.col(truth) - F.col(predicted)).cast("double")
    return rows.agg(F.avg(hit).alias("accuracy"), F.avg(gap).alias("mae"))
