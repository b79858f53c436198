"""Queries on clickstreams. Events stand in for actions; JSON columns are built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from histloom.functions import nested as N
from histloom.functions.text import first_nonempty, usable_text
from histloom.operators.lookups import each
from histloom.operators.skew import nest
from histloom.plans import interactions as P
from histloom.queries.registry import query, table, texts
from histloom.session import written


def actions(spark, sf):
    """Actions from events, with every shape of product data that the operators handle."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.col("event_type")

    def obj(n, *keys):
        parts = {
            "asin": F.concat(F.lit('"asin": "A'), F.lpad(n.cast("string"), 9, "0"), F.lit('"')),
            "title": F.concat(F.lit('"title": "item '), n.cast("string"), F.lit('"')),
            "price": F.concat(F.lit('"price": '), F.col("value").cast("string")),
        }
        return F.concat(F.lit("{"), F.concat_ws(", ", *[parts[x] for x in keys]), F.lit("}"))

    every = ("asin", "title", "price")

    def arr(*objects):
        return F.concat(F.lit("["), F.concat_ws(", ", *objects), F.lit("]"))

    bought = (
        F.when(k % 7 == 0, obj(k, *every))
        .when(k % 6 == 0, arr(obj(k, *every), obj(k + 1, *every)))
        .when(k % 10 == 0, arr(obj(k, "title", "price"), F.lit('"odd"')))
        .otherwise(arr(obj(k, *every)))
    )
    cart = F.when(k % 4 == 0, F.lit('{"cart_items": "none"}')).otherwise(
        F.concat(F.lit('{"cart_items": '), arr(obj(k, *every)), F.lit("}"))
    )
    escaped = F.replace(obj(k, *every), F.lit('"'), F.lit('\\"'))
    linked = (
        F.when(k % 3 == 0, F.concat(F.lit('{"cart_items": '), arr(obj(k, *every), obj(k + 2, *every)), F.lit("}")))
        .when(k % 3 == 1, F.concat(F.lit('{"name": "search_results", "data": "'), escaped, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"search_results": '), arr(obj(k, "asin"), obj(k, "title")), F.lit("}")))
    )
    details = F.when(k % 2 == 0, obj(k, *every)).otherwise(arr(obj(k, "title"), obj(k + 1, "title", "price")))
    viewed = F.concat(F.lit('{"product_details": '), details, F.lit("}"))
    return texts(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value", "props").select(
        F.concat(F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.col("ts").alias("timestamp"),
        F.when(kind.isin("click", "purchase", "view"), "click").otherwise(kind).alias("action_type"),
        F.when(kind == "purchase", "purchase")
        .when(kind == "click", "cart_side_bar")
        .when(kind == "view", "product_link")
        .alias("click_type"),
        F.when(kind == "purchase", bought).when(kind == "error", "not json").alias("products"),
        F.when(kind == "click", cart).when(kind == "view", linked).otherwise(viewed).alias("page_meta"),
        F.when(k % 5 != 0, "{}").alias("element_meta"),
        F.col("event_id").alias("seq"),
        "user_id",
        k.alias("k"),
    )


def sessions(spark, sf):
    return actions(spark, sf).select("session_id", "user_id").distinct()


def users(spark, sf):
    """Users with an interview: some blank, some with a section on shopping."""
    key = F.col("c_custkey")
    section = F.concat(F.lit("Intro.\n### Shopping Preference \nlikes "), F.col("c_mktsegment"), F.lit("\nmore"))
    return table(spark, sf, "customer").select(
        key.alias("user_id"),
        F.when(key % 5 == 0, " NaN ")
        .when(key % 5 == 1, section)
        .when(key % 5 == 2, F.lit(None))
        .otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")))
        .alias("interview_transcript_processed"),
    )


def rows(spark, sf):
    return P.interactions(sessions(spark, sf), actions(spark, sf).drop("user_id"))


ACTIONS_SQL = r"""
ev as (
  select *, user_id || '_' || strftime(ts, '%Y%m%d') session_id, regexp_extract(props, '(\d+)', 1)::INT k,
         "value"::VARCHAR price from events
), listed as (
  select *, 0 pos, 0 plus, true has_id, true has_title, true has_price from ev
  where event_type = 'purchase' and k % 7 <> 0 and (k % 6 = 0 or k % 10 <> 0)
  union all select *, 1, 1, true, true, true from ev where event_type = 'purchase' and k % 7 <> 0 and k % 6 = 0
  union all select *, 0, 0, false, true, true from ev
  where event_type = 'purchase' and k % 7 <> 0 and k % 6 <> 0 and k % 10 = 0
  union all select *, 0, 0, true, true, true from ev where event_type = 'click' and k % 4 <> 0
  union all select *, 0, 0, true, true, true from ev where event_type = 'view' and k % 3 <> 2
  union all select *, 1, 2, true, true, true from ev where event_type = 'view' and k % 3 = 0
  union all select *, 0, 0, true, false, false from ev where event_type = 'view' and k % 3 = 2
), items as (
  select user_id, session_id, event_id seq, pos,
         case event_type when 'purchase' then 'purchase' when 'click' then 'cart' else 'click' end as type,
         case when has_id then 'A' || lpad((k + plus)::VARCHAR, 9, '0') else '0000000000' end asin,
         case when has_title then 'item ' || (k + plus) else 'Unknown Title' end title,
         case when has_price then price else 'Unknown Price' end price
  from listed
), kept as (
  select * from items
  qualify row_number() over (partition by user_id, session_id, asin, type order by seq, pos) = 1
), personas as (
  select c_custkey user_id, case when c_custkey % 5 = 1 then 'likes ' || c_mktsegment else c_name end gold_persona
  from customer where c_custkey % 5 not in (0, 2)
)"""


@query(
    "interaction_filter",
    "select event_id seq, case event_type when 'purchase' then 'purchase' when 'click' then 'cart_side_bar' else 'product_link' end click_type from events where event_type in ('click', 'purchase', 'view')",
)
def interaction_filter(spark, sf):
    return P.interaction_actions(actions(spark, sf)).select("seq", "click_type")


@query(
    "prefix_filter",
    r"""select event_id seq from events where starts_with(user_id::VARCHAR, '1') and user_id = 1
    and event_type = 'purchase' and regexp_extract(props, '(\d+)', 1)::INT % 5 <> 0""",
)
def prefix_filter(spark, sf):
    return P.browse_actions(actions(spark, sf), "1_2024").select("seq")


@query(
    "usable_text_filter",
    "select c_custkey user_id from customer where c_custkey % 5 not in (0, 2)",
)
def usable_text_filter(spark, sf):
    return users(spark, sf).filter(usable_text(F.col("interview_transcript_processed"))).select("user_id")


@query("section_extract", f"with {ACTIONS_SQL} select * from personas")
def section_extract(spark, sf):
    return P.interview_personas(users(spark, sf))


@query(
    "user_session_actions",
    f"with {ACTIONS_SQL} select user_id, session_id, event_id seq, event_type from ev",
)
def user_session_actions(spark, sf):
    acts = actions(spark, sf).drop("user_id")
    out = P.actions_of_users(sessions(spark, sf), acts)
    kind = F.coalesce(
        F.when(F.col("click_type") == "cart_side_bar", "click")
        .when(F.col("click_type") == "product_link", "view")
        .otherwise(F.col("click_type")),
        F.col("action_type"),
    )
    return out.select("user_id", "session_id", "seq", kind.alias("event_type"))


@query(
    "user_purchases",
    f"""with {ACTIONS_SQL} select user_id, session_id, seq, pos, nullif(asin, '0000000000') asin, title, price,
    null::VARCHAR as options from items where type = 'purchase'""",
)
def user_purchases(spark, sf):
    return P.purchases(sessions(spark, sf), actions(spark, sf).drop("user_id"))


@query(
    "explode_json_products",
    f"with {ACTIONS_SQL} select seq, pos, nullif(asin, '0000000000') asin, title from items where type = 'purchase'",
)
def explode_json_products(spark, sf):
    listed = each(actions(spark, sf), N.json_objects(F.col("products")), ["seq"], item="p")
    return listed.select("seq", "pos", N.get(F.col("p"), "asin").alias("asin"), N.get(F.col("p"), "title").alias("title"))


@query(
    "product_sources",
    f"with {ACTIONS_SQL} select seq, pos, type, nullif(asin, '0000000000') asin from items",
)
def product_sources(spark, sf):
    kind = F.when(F.col("click_type") == "product_link", "click").when(F.col("click_type") == "cart_side_bar", "cart")
    found = N.with_products(P.interaction_actions(actions(spark, sf)), "listed")
    found = each(found, "listed", ["seq", F.coalesce(kind, F.lit("purchase")).alias("type")], item="p")
    return found.select("seq", "pos", "type", N.get(F.col("p"), "asin").alias("asin"))


@query("default_fill", f"with {ACTIONS_SQL} select seq, pos, asin, title, price from items")
def default_fill(spark, sf):
    listed = N.with_products(P.interaction_actions(actions(spark, sf)), "listed")
    found = each(listed, "listed", ["seq"], item="p")
    return found.select("seq", "pos", *N.product_fields(F.col("p"))[:3])


@query("dedup_keep_first", f"with {ACTIONS_SQL} select user_id, session_id, seq, pos, asin, type, title, price from kept")
def dedup_keep_first(spark, sf):
    return rows(spark, sf).drop("options")


@query(
    "interaction_counts",
    f"""with {ACTIONS_SQL} select user_id, count(*) interactions, count(*) filter (where type = 'purchase') purchases,
    count(*) filter (where type = 'cart') cart, count(*) filter (where type = 'click') clicks from kept group by user_id""",
)
def interaction_counts(spark, sf):
    return P.interaction_counts(rows(spark, sf))


def _page(by: str, rows_per_page: int | None) -> str:
    if rows_per_page is None:
        return "0"
    return f"((row_number() over (partition by {by} order by seq, pos) - 1) // {rows_per_page})::INT"


def _user_interactions_sql(rows_per_page=None):
    return f"""with {ACTIONS_SQL} select user_id, part, gold_persona,
    string_agg(session_id || '|' || asin || '|' || title || '|' || price || '|' || type, ';' order by seq, pos) items
    from (select *, {_page('user_id', rows_per_page)} part from kept) join personas using (user_id) group by user_id, part, gold_persona"""


def _user_interactions(spark, sf, **pages):
    item = lambda i: F.concat_ws("|", i["session_id"], i["asin"], i["title"], i["price"], i["type"])
    records = P.user_records(users(spark, sf), written(rows(spark, sf), "interactions"), **pages)
    return records.select(
        "user_id", "part", "gold_persona", F.concat_ws(";", F.transform("interactions", item)).alias("items")
    )


@query("user_interactions", _user_interactions_sql())
def user_interactions(spark, sf):
    return _user_interactions(spark, sf)


@query("user_interactions_paged", _user_interactions_sql(3))
def user_interactions_paged(spark, sf):
    return _user_interactions(spark, sf, max_rows=3)


def _sections_sql(kinds, rows_per_page=None):
    heads = {"purchase": "**Purchased Products:**", "cart": "**Items Added to Cart (but not bought):**", "click": "**Clicked / Viewed Items:**"}
    number = " ".join(f"when '{k}' then {i}" for i, k in enumerate(heads))
    head = " ".join(f"when '{k}' then '{h}' || chr(10)" for k, h in heads.items())
    wanted = ", ".join(f"'{k}'" for k in kinds)
    return f"""with {ACTIONS_SQL} select user_id, (case type {number} end)::INT section, part,
    (case when part = 0 then case type {head} end else '' end)
    || string_agg('- ' || title || ' (' || price || ')', chr(10) order by seq, pos) as text
    from (select *, {_page('user_id, type', rows_per_page)} part from kept where type in ({wanted}))
    join personas using (user_id) group by user_id, type, part"""


def _sections(spark, sf, **how):
    return P.section_pages(users(spark, sf), written(rows(spark, sf), "interactions"), **how)


@query("interaction_sections", _sections_sql(["purchase", "cart", "click"]))
def interaction_sections(spark, sf):
    return _sections(spark, sf)


@query("interaction_sections_some", _sections_sql(["purchase", "click"]))
def interaction_sections_some(spark, sf):
    return _sections(spark, sf, kinds=["purchase", "click"])


@query("interaction_sections_paged", _sections_sql(["purchase", "cart", "click"], 2))
def interaction_sections_paged(spark, sf):
    return _sections(spark, sf, max_rows=2)


def _purchase_lines_sql(rows_per_page=None):
    return f"""with {ACTIONS_SQL} select user_id, part, coalesce(string_agg('- ' || title || ' ($' || price || ')', chr(10) order by seq, pos)
    filter (where asin <> '0000000000'), '') as text
    from (select *, {_page('user_id', rows_per_page)} part from items where type = 'purchase') group by user_id, part"""


def _purchase_lines(spark, sf, **pages):
    bought = written(P.purchases(sessions(spark, sf), actions(spark, sf).drop("user_id")), "purchases")
    nested = nest(bought, ["user_id"], ["seq", "pos"], ["asin", "title", "price"], "items", **pages)
    return nested.select("user_id", "part", P.purchase_lines(F.col("items")).alias("text"))


@query("purchase_lines", _purchase_lines_sql())
def purchase_lines(spark, sf):
    return _purchase_lines(spark, sf)


@query("purchase_lines_paged", _purchase_lines_sql(3))
def purchase_lines_paged(spark, sf):
    return _purchase_lines(spark, sf, max_rows=3)


@query(
    "product_details",
    r"""select event_id seq, case when k % 2 = 0 then 'A' || lpad(k::VARCHAR, 9, '0') else '' end asin,
    'item ' || (case when k % 2 = 0 then k else k + 1 end) title, "value"::VARCHAR price
    from (select *, regexp_extract(props, '(\d+)', 1)::INT k from events) where event_type not in ('click', 'view')""",
)
def product_details(spark, sf):
    found = actions(spark, sf).filter("click_type is null or click_type = 'purchase'")
    details = found.withColumn("d", N.product_details(F.col("page_meta")))
    keys = ("asin", "title", "price")
    return details.select("seq", *[F.coalesce(N.get(F.col("d"), k), F.lit("")).alias(k) for k in keys])


@query(
    "dedup_asin_or_title",
    r"""select user_id, event_id seq, title, price, asin from (
  select *, case when k % 2 = 0 then 'A' || lpad(k::VARCHAR, 9, '0') else '' end asin,
         'item ' || (case when k % 2 = 0 then k else k + 1 end) title, "value"::VARCHAR price
  from (select *, regexp_extract(props, '(\d+)', 1)::INT k from events) where event_type not in ('click', 'view'))
qualify row_number() over (partition by user_id, case when asin = '' then title else asin end order by ts, event_id) = 1""",
)
def dedup_asin_or_title(spark, sf):
    found = actions(spark, sf).filter("click_type is null or click_type = 'purchase'")
    return P.browsed_products(found, ["user_id"]).drop("timestamp")


@query(
    "first_nonempty",
    "select p_partkey, coalesce(case when p_partkey % 3 = 0 then null when p_partkey % 3 = 1 then null else p_brand end, p_type) as value from part",
)
def first_nonempty_field(spark, sf):
    key = F.col("p_partkey")
    blank = F.when(key % 3 == 0, "").when(key % 3 == 1, F.lit(None)).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", first_nonempty(blank, F.col("p_type")).alias("value"))


@query(
    "price_cast",
    "select p_partkey, case when p_partkey % 5 = 0 or p_partkey % 7 = 0 then null else p_retailprice end price from part",
)
def price_cast(spark, sf):
    from histloom.queries.histories import product_meta

    return product_meta(spark, sf).select(F.col("seq").alias("p_partkey"), F.col("price").try_cast("double").alias("price"))
