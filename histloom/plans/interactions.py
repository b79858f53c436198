"""Clickstream to interactions: sessions, actions, products, duplicates, nested users, texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom import constants as K
from histloom.functions import nested as N
from histloom.functions.text import bullet, first_nonempty, section_line, usable_text
from histloom.operators.lookups import each
from histloom.operators.ordering import keep_first
from histloom.operators.skew import PAGE_ROWS, lookup_join, nest


def interaction_actions(actions: DataFrame) -> DataFrame:
    """Clicks that buy, that concern the cart, or that open a product."""
    return actions.filter(
        (F.col("action_type") == "click") & F.col("click_type").isin(list(K.INTERACTION_TYPES))
    )


def browse_actions(actions: DataFrame, user_and_year: str) -> DataFrame:
    """Actions of the sessions whose id starts with `{user}_{year}`, with element and products."""
    return actions.filter(
        F.col("session_id").startswith(user_and_year)
        & F.col("action_type").isin(K.BROWSE_ACTIONS)
        & F.col("element_meta").isNotNull()
        & F.col("products").isNotNull()
    )


def actions_of_users(sessions: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions with the user of their session. A session has one user."""
    users = sessions.select("session_id", "user_id").distinct()
    return lookup_join(actions, users, ["session_id"], "inner", spread_by=["seq"])


def interactions(sessions: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per product of an interaction, duplicates removed.

    A product counts once per session, id and type; the first one stays. Products without an
    id share one id, so within a session and type they count once as well.
    """
    kinds = F.create_map(*[F.lit(x) for pair in K.INTERACTION_TYPES.items() for x in pair])
    slim = interaction_actions(actions).select(
        "session_id", "seq", "click_type", "products", "page_meta"
    )
    listed = N.with_products(slim, "listed").drop("products", "page_meta")
    rows = (
        actions_of_users(sessions, listed)
        .withColumn("type", kinds[F.col("click_type")])
    )
    rows = each(rows, "listed", ["user_id", "session_id", "seq", "type"], item="product").select(
        "user_id", "session_id", "seq", "pos", "type", *N.product_fields(F.col("product"))
    )
    return keep_first(rows, ["user_id", "session_id", "asin", "type"], ["seq", "pos"])


def purchases(sessions: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per purchased product; absent fields are null."""
    bought = actions.filter((F.col("action_type") == "click") & (F.col("click_type") == "purchase"))
    slim = bought.select("session_id", "seq", "products")
    listed = N.json_objects(F.col("products"))
    rows = each(actions_of_users(sessions, slim), listed, ["user_id", "session_id", "seq"], item="p")
    fields = [N.get(F.col("p"), k).alias(k) for k in ("asin", "title", "price", "options")]
    return rows.select("user_id", "session_id", "seq", "pos", *fields)


def browsed_products(actions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct viewed products per `by`: the first one by time for each id, or title without id."""
    found = actions.withColumn("_d", N.product_details(F.col("page_meta"))).select(
        *by,
        "timestamp",
        "seq",
        *[F.coalesce(N.get(F.col("_d"), k), F.lit("")).alias(k) for k in ("title", "price", "asin")],
    )
    key = first_nonempty(F.col("asin"), F.col("title"))
    return keep_first(found, [*by, key], ["timestamp", "seq"])


def interaction_counts(rows: DataFrame) -> DataFrame:
    """Interactions per user, in total and by type."""
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("interactions"),
        *[
            F.count_if(F.col("type") == kind).alias(name)
            for kind, name in [("purchase", "purchases"), ("cart", "cart"), ("click", "clicks")]
        ],
    )


def interview_personas(users: DataFrame) -> DataFrame:
    """Users with a usable interview and its shopping section, or all of it without one."""
    text = F.col("interview_transcript_processed")
    return users.filter(usable_text(text)).select(
        "user_id", section_line(text, "### Shopping Preference").alias("gold_persona")
    )


def user_records(users: DataFrame, rows: DataFrame, max_rows: int = PAGE_ROWS) -> DataFrame:
    """Nested users: persona and ordered interactions, in pages of `max_rows` numbered by `part`.
    Users without interactions drop out."""
    fields = ["session_id", "asin", "title", "price", "options", "type"]
    nested = nest(rows, ["user_id"], ["seq", "pos"], fields, "interactions", max_rows)
    return nested.join(interview_personas(users), "user_id")


def section_pages(
    users: DataFrame, rows: DataFrame, kinds: list[str] | None = None, max_rows: int = PAGE_ROWS
) -> DataFrame:
    """Interactions as text under fixed headings, by type: user_id, section (its number), part, text.

    A section is written in pages of `max_rows` lines, and its heading is on the first page only.
    All pages of a user in order, joined by a line end within a section and an empty line
    between sections, are the user's text. Types without interactions have no section.
    """
    wanted = [k for k in K.SECTION_HEADINGS if kinds is None or k in kinds]
    number = F.array_position(F.array(*[F.lit(k) for k in K.SECTION_HEADINGS]), F.col("type")).cast("int")
    chosen = rows.filter(F.col("type").isin(wanted)).withColumn("section", number - 1)
    nested = nest(chosen, ["user_id", "section"], ["seq", "pos"], ["title", "price"], "items", max_rows)

    def shown(c: Column) -> Column:
        return F.coalesce(c, F.lit("None"))

    lines = F.concat_ws("\n", F.transform("items", lambda i: bullet(shown(i["title"]), shown(i["price"]))))
    headings = F.array(*[F.lit(h + "\n") for h in K.SECTION_HEADINGS.values()])
    heading = F.when(F.col("part") == 0, headings[F.col("section")]).otherwise(F.lit(""))
    text = nested.select("user_id", "section", "part", F.concat(heading, lines).alias("text"))
    return text.join(interview_personas(users).select("user_id"), "user_id", "left_semi")


def purchase_lines(items: Column) -> Column:
    """A line with title and price for each item that has an id and a title."""
    named = F.filter(items, lambda i: (i["asin"] != "") & (i["title"] != ""))
    price = lambda i: F.concat(F.lit("$"), F.coalesce(i["price"], F.lit("None")))
    return F.concat_ws("\n", F.transform(named, lambda i: bullet(i["title"], price(i))))


def user_json(personas: DataFrame, sessions: DataFrame, bought: DataFrame, max_rows: int = PAGE_ROWS) -> DataFrame:
    """A JSON document for each page of `max_rows` purchases of each user. The counts are those
    of the whole user on every page; a user without purchases has one page."""
    counts = sessions.select("user_id", "session_id").distinct().groupBy("user_id").agg(
        F.count(F.lit(1)).alias("num_sessions")
    )
    totals = bought.groupBy("user_id").agg(F.count(F.lit(1)).alias("num_purchases"))
    fields = ["session_id", "asin", "title", "price", "options"]
    nested = nest(bought, ["user_id"], ["seq", "pos"], fields, "purchases", max_rows)
    zero = F.lit(0).cast("long")
    document = F.struct(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("gold_persona").alias("persona"),
        F.coalesce("num_sessions", zero).alias("num_sessions"),
        F.coalesce("num_purchases", zero).alias("num_purchases"),
        F.coalesce("purchases", F.array().cast(nested.schema["purchases"].dataType)).alias("purchases"),
    )
    return (
        personas.join(counts, "user_id", "left")
        .join(totals, "user_id", "left")
        .join(nested, "user_id", "left")
        .select("user_id", F.coalesce("part", F.lit(0)).alias("part"), F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))
    )
