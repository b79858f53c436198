"""Product knowledge from a log of updates: add and remove entries of lists, prune products.

Log columns: product, seq (update number), pos (place in the update), op (`add` / `remove`),
list, value. Within one update removals come before additions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histloom.operators.skew import PAGE_ROWS, lookup_join, nest

ENTRY = ["product", "list", "value"]


def merge(log: DataFrame) -> DataFrame:
    """The entries that are there after all updates, with the place where they came in.

    An entry stays if it was added in or after the last update that removed it; it keeps the
    place of the first such addition. This is a maximum, a join and a minimum, so an entry or
    product with very many updates is aggregated in parts and never replayed in one task.
    """
    removed = (
        log.filter(F.col("op") == "remove").groupBy(*ENTRY).agg(F.max("seq").alias("_removed"))
    )
    added = log.filter(F.col("op") == "add").select(*ENTRY, "seq", "pos")
    alive = lookup_join(added, removed, ENTRY, "left", spread_by=["seq", "pos"]).filter(
        F.col("_removed").isNull() | (F.col("seq") >= F.col("_removed"))
    )
    first = alive.groupBy(*ENTRY).agg(F.min(F.struct("seq", "pos")).alias("_at"))
    return first.select(*ENTRY, "_at.seq", "_at.pos")


STATE = "product string, list string, value string, removed long, seq long, pos int, seen long"


def advance(state: DataFrame, log: DataFrame) -> DataFrame:
    """The rows of a saved state that a new log changes or adds; only these need to be written.

    The state has one row per entry that any update named: its last removal (`removed`), the place
    of its first addition since then (`seq`, `pos`, null while it is gone) and the last update that
    named it (`seen`). The updates of `log` come after all that the state has seen, and no update
    is split between two logs; else this is an error, since additions past the first are not kept.
    """
    told = log.filter(F.col("op").isin("add", "remove"))
    if not told.join(state.agg(F.max("seen").alias("_last")), F.col("seq") <= F.col("_last")).isEmpty():
        raise ValueError("the log holds updates that the state has already seen")
    removal = F.when(F.col("op") == "remove", F.col("seq"))
    named = told.groupBy(*ENTRY).agg(F.max(removal).alias("_removed"), F.max("seq").alias("_seen"))
    came = merge(told).select(*ENTRY, F.col("seq").alias("_seq"), F.col("pos").alias("_pos"))
    new, old, again = named.alias("n"), state.alias("s"), came.alias("a")

    def same(left: str, right: str):
        return reduce(lambda x, y: x & y, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in ENTRY])

    stays = F.col("_removed").isNull() & F.col("s.seq").isNotNull()
    return new.join(old, same("n", "s"), "left").join(again, same("n", "a"), "left").select(
        *[F.col(f"n.{c}") for c in ENTRY],
        F.coalesce("_removed", "removed").cast("long").alias("removed"),
        F.when(stays, F.col("s.seq")).otherwise(F.col("_seq")).cast("long").alias("seq"),
        F.when(stays, F.col("s.pos")).otherwise(F.col("_pos")).cast("int").alias("pos"),
        F.col("_seen").cast("long").alias("seen"),
    )


def entries_of(state: DataFrame) -> DataFrame:
    """The entries that are there, as `merge` over the whole log gives them."""
    return state.filter(F.col("seq").isNotNull()).select(*ENTRY, "seq", "pos")


def with_new_products(products: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Known products as they are, and mentioned ones that are new, as `researching`."""
    fresh = mentioned.select("product").distinct().join(products, "product", "left_anti")
    return products.select("product", "status").unionByName(
        fresh.withColumn("status", F.lit("researching"))
    )


def prune(products: DataFrame, named: DataFrame) -> DataFrame:
    """Mark the named products as `pruned`; unknown names have no effect."""
    marks = named.select("product").distinct().withColumn("_pruned", F.lit(True))
    return (
        products.join(marks, "product", "left")
        .withColumn("status", F.when(F.col("_pruned"), "pruned").otherwise(F.col("status")))
        .drop("_pruned")
    )


def active(products: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of the products that are still being researched."""
    live = products.filter(F.col("status") == "researching").select("product")
    return lookup_join(entries, live, ["product"], "left_semi", spread_by=["list", "value"])


def entry_lists(entries: DataFrame, max_rows: int = PAGE_ROWS) -> DataFrame:
    """The ordered values of every product and list, in pages of `max_rows`."""
    return nest(entries, ["product", "list"], ["seq", "pos", "value"], ["value"], "entries", max_rows).withColumn(
        "entries", F.transform("entries", lambda e: e["value"])
    )


def thought_history(thoughts: DataFrame, run: str, order: str, text: str, max_rows: int = PAGE_ROWS) -> DataFrame:
    """The thoughts of each run in order, as a list of lines, in pages of `max_rows` lines."""
    nested = nest(thoughts, [run], [order], [text], "thoughts", max_rows)
    lines = F.transform("thoughts", lambda t: F.concat(F.lit("- "), t[text]))
    return nested.select(run, "part", F.concat_ws("\n", lines).alias("history"))
