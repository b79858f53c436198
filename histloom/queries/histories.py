"""Queries on user histories: choosing users, first and last rows, held-out rows, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histloom.functions.text import history_text, product_text
from histloom.functions.times import epoch_millis
from histloom.operators import ordering as O
from histloom.operators.skew import first_per_group
from histloom.plans.reviews import nested_histories, qualifying_reviews, review_histories
from histloom.queries import sql as S
from histloom.queries.registry import query, table


def orders_by_user(spark, sf):
    """Orders as reviews: the customer is the user, the customer's nation the category. Both sides
    are plain scans, so Spark's adaptive skew join splits a customer with very many orders."""
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("category")
    )
    return table(spark, sf, "orders").join(customer, "o_custkey")


def reviews(spark, sf):
    """Reviews from orders; the text is the document with the order's number, if there is one."""
    text = table(spark, sf, "documents").select(F.col("doc_id").alias("o_orderkey"), "text")
    return orders_by_user(spark, sf).join(text, "o_orderkey", "left").select(
        F.col("o_custkey").alias("user_id"),
        "category",
        F.concat(F.lit("P"), (F.col("o_orderkey") * 7 % 2500).cast("string")).alias("parent_asin"),
        epoch_millis(F.col("o_orderdate")).alias("timestamp"),
        ((F.col("o_orderkey") % 5) + 1).cast("double").alias("rating"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("o_orderkey").alias("seq"),
    )


def product_meta(spark, sf):
    """Product metadata from parts: some ids only in the second field, some prices no number."""
    key = F.col("p_partkey")
    pid = F.concat(F.lit("P"), key.cast("string"))
    return table(spark, sf, "part").select(
        F.when(key % 3 == 0, "").otherwise(pid).alias("parent_asin"),
        pid.alias("asin"),
        F.col("p_name").alias("title"),
        F.when(key % 4 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("brand"),
        F.when(key % 5 == 0, F.concat(F.lit("$"), F.col("p_retailprice").cast("string")))
        .when(key % 7 == 0, F.lit(None))
        .otherwise(F.col("p_retailprice").cast("string"))
        .alias("price"),
        F.col("p_type").alias("main_category"),
        key.alias("seq"),
    )


MS = "epoch_ms(o_orderdate)"
REVIEWS_SQL = f"""
reviews as (
  select o_custkey user_id, c_nationkey category, 'P' || (o_orderkey * 7 % 2500) parent_asin,
         {MS} "timestamp", (o_orderkey % 5 + 1)::DOUBLE rating, 'order ' || o_orderkey title,
         coalesce(d.text, '') "text", o_orderkey seq
  from orders join customer on c_custkey = o_custkey left join documents d on d.doc_id = o_orderkey
), products as (
  select 'P' || p_partkey parent_asin, p_name title,
         case when p_partkey % 4 = 0 then null else p_brand end brand,
         case when p_partkey % 5 = 0 or p_partkey % 7 = 0 then null else p_retailprice end price,
         p_type main_category
  from part
)"""
HISTORIES_SQL = f"""
{REVIEWS_SQL}, firsts as (
  select category, user_id, min(seq) first_seq from reviews group by all
), chosen as (
  select * from firsts
  qualify row_number() over (partition by category order by first_seq, user_id) <= 30
), kept as (
  select r.*, count(*) over (partition by category, user_id) n from (
    select r.*, row_number() over (partition by category, user_id order by seq) rn
    from reviews r semi join chosen c on c.category = r.category and c.user_id = r.user_id) r
  where rn <= 5
), full_users as (select * from kept where n = 5),
splits as (
  select category, user_id, row_number() over (partition by category order by user_id) - 1 idx
  from (select distinct category, user_id from full_users)
), hist as (
  select f.category, f.user_id, f.parent_asin, f.rating, f."timestamp", f.seq, f.title, f."text",
         case when idx < 26 then 'training' when idx < 29 then 'validation' else 'test' end split,
         case when row_number() over (partition by f.category, f.user_id order by f."timestamp" desc, seq desc) = 1
              then 'heldout' else 'history' end as role,
         p.title product_title, p.brand, p.price, p.main_category
  from full_users f join splits s on s.category = f.category and s.user_id = f.user_id
  left join products p on p.parent_asin = f.parent_asin
)"""


@query(
    "order_histories",
    f"""
with ranked as (
  select o_custkey, o_orderkey, o_totalprice, c_nationkey category,
         row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn,
         count(*) over (partition by o_custkey) n
  from orders join customer on c_custkey = o_custkey
), splits as (
  select c_custkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 idx from customer
)
select o_custkey, category, o_orderkey, o_totalprice,
       case when rn = 1 then 'heldout' else 'history' end as role,
       case when idx < 26 then 'training' when idx < 29 then 'validation' else 'test' end split
from ranked join splits on c_custkey = o_custkey where rn <= 6 and n >= 2""",
)
def order_histories(spark: SparkSession, sf: str) -> DataFrame:
    """For each customer the last order, held out, the five before it, and the split."""
    latest = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    last = first_per_group(orders_by_user(spark, sf), ["o_custkey"], latest, 6)
    several = F.count(F.lit(1)).over(Window.partitionBy("o_custkey")) >= 2
    roles = last.withColumn("role", F.when(F.col("rn") == 1, "heldout").otherwise("history")).withColumn(
        "several", several
    )
    users = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("category"), F.col("c_custkey").alias("o_custkey")
    )
    split = O.rank_split(users, "category", "o_custkey")
    return roles.filter("several").join(split, ["category", "o_custkey"]).select(
        "o_custkey", "category", "o_orderkey", "o_totalprice", "role", "split"
    )


@query(
    "review_histories",
    f"""with {HISTORIES_SQL}, {S.with_excerpt("hist", '"text"')}
select category, user_id, split, role, seq, parent_asin, rating, "timestamp", product_title, brand, price,
       main_category, review_excerpt
from cut""",
)
def histories(spark, sf):
    rows = review_histories(reviews(spark, sf), product_meta(spark, sf), reviews(spark, sf))
    return rows.select(
        "category", "user_id", "split", "role", "seq", "parent_asin", "rating", "timestamp",
        F.col("product.title").alias("product_title"), "product.brand", "product.price",
        "product.main_category", "review_excerpt",
    )


@query(
    "history_text",
    f"""with {HISTORIES_SQL}, {S.with_excerpt("hist", '"text"')},
lines as (
  select category, user_id, role, "timestamp", seq,
         '- ' || coalesce(product_title, 'None') || ' | Rating: ' || rating || '/5 | Review: ' ||
         case when review_excerpt = '' then '(No review provided)' else {S.strip('review_excerpt')} end line
  from cut
)
select category, user_id, string_agg(line, chr(10) order by "timestamp", seq) filter (where role = 'history') history_text,
       max(line) filter (where role = 'heldout') heldout_text
from lines group by all""",
)
def history_texts(spark, sf):
    rows = review_histories(reviews(spark, sf), product_meta(spark, sf), reviews(spark, sf))
    nested = nested_histories(rows)
    return nested.select(
        "category",
        "user_id",
        history_text(F.col("history")).alias("history_text"),
        history_text(F.array("heldout")).alias("heldout_text"),
    )


@query(
    "qualifying_reviews",
    f"""with {REVIEWS_SQL} select seq, user_id from reviews
    where user_id in (select user_id from reviews group by user_id having count(*) > 12) order by seq limit 30""",
)
def qualifying(spark, sf):
    return qualifying_reviews(reviews(spark, sf), 12, 30).select("seq", "user_id")


@query(
    "leave_last_out",
    """
select o_custkey, o_orderkey,
       case when row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1
            then 'heldout' else 'history' end as role
from (select *, count(*) over (partition by o_custkey) n from orders) where n >= 2""",
)
def leave_last_out(spark, sf):
    rows = O.leave_last_out(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return rows.select("o_custkey", "o_orderkey", "role")


@query(
    "rank_split",
    """
select c_nationkey, c_custkey,
       case when idx < 26 then 'training' when idx < 29 then 'validation' else 'test' end split
from (select c_nationkey, c_custkey,
             row_number() over (partition by c_nationkey order by c_custkey) - 1 idx from customer)""",
)
def rank_split(spark, sf):
    users = table(spark, sf, "customer").select("c_nationkey", "c_custkey")
    return O.rank_split(users, "c_nationkey", "c_custkey")


@query(
    "first_n_per_group",
    """
select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey)::INT rn
from orders qualify rn <= 5""",
)
def first_n_per_group(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return first_per_group(rows, ["o_custkey"], [F.col("o_orderkey")], 5)


@query(
    "min_group_size",
    """
select o_custkey, o_orderkey, rn::INT rn
from (select *, count(*) over (partition by o_custkey) n
      from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) rn
            from orders) where rn <= 5)
where n = 5""",
)
def min_group_size(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return O.full_groups(rows, ["o_custkey"], [F.col("o_orderkey")], 5)


@query(
    "first_distinct_users",
    """
select category, o_custkey, first_seq, rn::INT rn
from (select *, row_number() over (partition by category order by first_seq, o_custkey) rn
      from (select c_nationkey category, o_custkey, min(o_orderkey) first_seq
            from orders join customer on c_custkey = o_custkey group by all))
where rn <= 30""",
)
def first_distinct_users(spark, sf):
    return O.first_distinct(orders_by_user(spark, sf), "category", "o_custkey", "o_orderkey", 30)


@query(
    "dedup_by_id",
    "select o_custkey, min(o_orderkey) o_orderkey from orders group by o_custkey",
)
def dedup_by_id(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return O.keep_first(rows, ["o_custkey"], ["o_orderkey"])


@query(
    "dedup_keep_last",
    """
select o_custkey, o_orderkey, o_totalprice from orders
qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1""",
)
def dedup_keep_last(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return O.keep_last(rows, ["o_custkey"], ["o_orderkey"])


@query(
    "first_date_in_month",
    """
with users as (
  select o_custkey, (date_trunc('month', max(o_orderdate)) + interval 14 day)::DATE selection
  from orders group by all
), firsts as (
  select u.o_custkey, min(o_orderdate::DATE) d from users u join orders o on o.o_custkey = u.o_custkey
  and date_trunc('month', o.o_orderdate) = date_trunc('month', u.selection) group by all
)
select o_custkey, coalesce(d, selection) selection from users left join firsts using (o_custkey)
union all
select c_custkey, date '1990-01-15' from customer where c_custkey not in (select o_custkey from orders)""",
)
def first_date_in_month(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    mid = F.date_add(F.trunc(F.max("day"), "month"), 14)
    chosen = orders.groupBy("o_custkey").agg(mid.alias("selection"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    users = customers.join(chosen, "o_custkey", "left").withColumn(
        "selection", F.coalesce("selection", F.lit("1990-01-15").cast("date"))
    )
    return O.first_date_in_month(orders, users, "o_custkey", "day", "selection")


@query(
    "row_index",
    "select o_orderkey, row_number() over (order by o_orderkey) - 1 row_index from orders",
)
def row_index(spark, sf):
    return O.row_index(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "row_range",
    """
select o_orderkey, row_index from (
  select o_orderkey, row_number() over (order by o_orderkey) - 1 row_index from orders)
where row_index >= 500 and row_index < 2500""",
)
def row_range(spark, sf):
    return O.row_range(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 500, 2500)


@query(
    "limit_n",
    "select o_orderkey, o_totalprice from orders order by o_orderkey limit 10",
)
def limit_n(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)


@query(
    "ordered_limit",
    "select event_id, ts, event_type from events where event_type = 'click' or props is not null order by ts, event_id limit 100",
)
def ordered_limit(spark, sf):
    rows = table(spark, sf, "events").filter("event_type = 'click' or props is not null")
    return rows.select("event_id", "ts", "event_type").orderBy("ts", "event_id").limit(100)


@query(
    "bottom_k",
    "select event_id, value from events order by value, event_id limit 8",
)
def bottom_k(spark, sf):
    return O.bottom_k(table(spark, sf, "events").select("event_id", "value"), "value", "event_id", 8)


@query(
    "uniform_sample_k",
    f"select o_orderkey from orders order by {S.draw_key(42, 'o_orderkey')} limit 5000",
)
def uniform_sample_k(spark, sf):
    return O.uniform_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5000, 42)


@query(
    "sample_of_first_rows",
    f"""
select o_orderkey from (select o_orderkey from orders order by o_orderkey limit 200)
order by {S.draw_key(7, 'o_orderkey')} limit 50""",
)
def sample_of_first_rows(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey")
    return O.uniform_sample(rows, "o_orderkey", 50, 7, seq="o_orderkey", max_rows=200)


@query(
    "stratified_sample",
    f"""
select o_orderkey, level from (
  select o_orderkey, left(o_orderpriority, 1) as level,
         row_number() over (partition by left(o_orderpriority, 1) order by {S.draw_key(42, 'o_orderkey')}) rn
  from orders)
where (level in ('1', '2') and rn <= 10) or (level = '3' and rn <= 5)""",
)
def stratified_sample(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.left("o_orderpriority", F.lit(1)).alias("level"))
    return O.stratified_sample(rows, "level", "o_orderkey", {1: 10, 2: 10, 3: 5}, 42)


@query(
    "seeded_split",
    f"""
select c_custkey, case when row_number() over (order by {S.draw_key(42, 'c_custkey')}) <= ceil(0.1 * count(*) over ())
                       then 'val' else 'train' end split from customer""",
)
def seeded_split(spark, sf):
    return O.share_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 42, 0.1)


SIZED_SQL = """
with users as (select {user} u, row_number() over (order by {key}) rn, count(*) over () n from {source}),
cuts as (select u, rn, case when n < 80 then floor(n * 0.7) else 50 end a,
                case when n < 80 then floor(n * 0.9) else 70 end b from users)
select u as {user}, case when rn <= a then 'train' when rn <= b then 'val' else 'test' end split
from cuts where rn <= b + 10"""


@query("sized_split", SIZED_SQL.format(user="c_custkey", source="customer", key=S.draw_key(42, "c_custkey")))
def sized_split(spark, sf):
    return O.sized_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 42)


@query("sized_split_few", SIZED_SQL.format(user="n_nationkey", source="nation", key=S.draw_key(42, "n_nationkey")))
def sized_split_few(spark, sf):
    return O.sized_split(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey", 42)


@query(
    "product_text",
    """
select p_partkey, 'Title: ' || trim(p_name) || ' | Category: ' || trim(p_type) || ' | Brand: ' ||
       case when p_partkey % 4 = 0 then 'unknown' else p_brand end || ' | Price: ' ||
       case when p_partkey % 7 = 0 then 'unknown' else p_retailprice::VARCHAR end product_text
from part""",
)
def product_texts(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey",
        product_text(
            F.col("p_name"),
            F.col("p_type"),
            F.when(key % 4 == 0, "").otherwise(F.col("p_brand")),
            F.when(key % 7 != 0, F.col("p_retailprice")),
        ).alias("product_text"),
    )
