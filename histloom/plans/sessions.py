"""Shopping sessions: item ids parsed from text, looked up in order in the product table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histloom.functions.text import bullet, item_ids
from histloom.operators.lookups import each
from histloom.operators.ordering import keep_first, keep_last, row_index
from histloom.operators.skew import lookup_join

PRODUCT_FIELDS = ["id", "title", "price", "brand", "color", "size", "model"]


def latest_products(products: DataFrame) -> DataFrame:
    """One product per id; the later row wins, whatever its locale."""
    return keep_last(products, ["id"], ["seq"])


def session_items(sessions: DataFrame) -> DataFrame:
    """One row per item id of a session, with its position."""
    return each(sessions, item_ids(F.col("prev_items")), ["session_id"], item="id")


def found_items(sessions: DataFrame, products: DataFrame) -> DataFrame:
    """Session items that are in the product table, in order, repeats kept, unknown ids left out.

    A best-seller may be in a third of all sessions, so the lookup spreads hot ids.
    """
    return lookup_join(
        session_items(sessions), latest_products(products), ["id"], "inner", spread_by=["session_id", "pos"]
    )


def session_details(sessions: DataFrame, products: DataFrame) -> DataFrame:
    """Each session with the bullet lines of its items; '' if none is known.

    A session is one input row, so its item list is bounded by that row.
    """
    none = F.lit("None")
    line = bullet(F.coalesce("title", none), F.coalesce("brand", none))
    items = found_items(sessions, products).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("_lines")
    )
    text = F.concat_ws("\n", F.transform("_lines", lambda x: x["line"]))
    return sessions.join(items, "session_id", "left").select(
        "session_id",
        F.col("prev_items").alias("prev_items_asin"),
        F.coalesce(text, F.lit("")).alias("prev_items_details"),
        F.lit("").alias("persona"),
    )


def numbered_sessions(rows: DataFrame) -> DataFrame:
    """Session rows with their row number, from 0, as `session_id`."""
    return row_index(rows, "seq", "session_id").drop("seq")


def available(df: DataFrame, wanted: Sequence[str] = tuple(PRODUCT_FIELDS)) -> DataFrame:
    """Those of the wanted columns that the table has."""
    return df.select(*[c for c in wanted if c in df.columns])


def local_products(found: DataFrame, locales: Sequence[str] = ("UK", "GB")) -> DataFrame:
    """Found products of some locales, one row per id, the first one found."""
    here = found.filter(F.col("locale").isin(list(locales)))
    return available(keep_first(here, ["id"], ["session_id", "pos"]))
