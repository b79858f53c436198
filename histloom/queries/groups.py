"""Queries on communities, sessions, runs, and the relational operators they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from histloom import constants as K
from histloom.functions import vectors as V
from histloom.functions.text import contains_reward, item_ids
from histloom.operators import lookups as L
from histloom.operators.ordering import stratified_sample
from histloom.operators.skew import lookup_join
from histloom.plans import communities as C
from histloom.plans import runs as R
from histloom.plans import sessions as Z
from histloom.queries.registry import query, table


# --- communities -----------------------------------------------------------------------------
def posts(spark, sf):
    """Posts from events: users are authors, event types are communities."""
    e = F.col("event_id")
    text = F.concat(F.lit("post "), e.cast("string"), F.repeat(F.lit(" ab"), (e % 31).cast("int")))
    return table(spark, sf, "events").select(
        F.when(F.col("user_id") % 50 == 0, K.DELETED_AUTHOR)
        .when(F.col("user_id") % 50 == 1, "")
        .otherwise(F.col("user_id").cast("string"))
        .alias("author"),
        F.concat(F.lit("r/"), F.col("event_type")).alias("subreddit"),
        F.when(e % 5 == 0, "").otherwise(text).alias("content"),
        F.when(e % 5 == 0, text).alias("body"),
        e.alias("seq"),
    )


POSTS_SQL = """
posts as (
  select case when user_id % 50 = 0 then '[deleted]' when user_id % 50 = 1 then '' else user_id::VARCHAR end author,
         'r/' || event_type subreddit, 'post ' || event_id || repeat(' ab', (event_id % 31)::INT) post, event_id seq
  from events
), named as (select * from posts where author not in ('', '[deleted]')),
ranked as (
  select *, row_number() over (partition by author, subreddit order by seq) rn from named where length(post) > 50
), full_subs as (select author, subreddit from ranked where rn <= 5 group by all having count(*) >= 5),
chosen as (select author from full_subs group by all having count(*) >= 3)"""


@query("count_having", "select user_id, count(*) n from events group by user_id having count(*) > 6")
def count_having(spark, sf):
    return L.frequent(table(spark, sf, "events"), "user_id", 6)


@query(
    "distinct_having",
    f"with {POSTS_SQL} select author, count(distinct subreddit) communities from named group by author having count(distinct subreddit) >= 3",
)
def distinct_having(spark, sf):
    return C.active_in(C.named_posts(posts(spark, sf)), "author", "subreddit", 3)


@query(
    "semi_gold_authors",
    f"""with {POSTS_SQL} select seq, author from named where author in
    (select author from named group by author having count(distinct subreddit) >= 4)""",
)
def semi_gold_authors(spark, sf):
    rows = C.named_posts(posts(spark, sf))
    return C.posts_of(rows, C.active_in(rows, "author", "subreddit", 4)).select("seq", "author")


@query(
    "chameleon_users",
    f"""with {POSTS_SQL} select r.author, r.subreddit, (rn - 1)::INT pos, post from ranked r
    join full_subs f on f.author = r.author and f.subreddit = r.subreddit
    where rn <= 5 and r.author in (select author from chosen)""",
)
def chameleon_users(spark, sf):
    rows = C.community_posts(posts(spark, sf))
    return rows.select("author", "subreddit", F.posexplode("posts").alias("pos", "post"))


def _community_users_sql(rows_per_page=None):
    page = "0" if rows_per_page is None else f"((row_number() over (partition by author order by first_seq) - 1) // {rows_per_page})::INT"
    return f"""with {POSTS_SQL}, seen as (select author, subreddit, min(seq) first_seq from named group by all),
    mine as (select f.*, first_seq, string_agg(post, '|' order by rn) posts from full_subs f join seen using (author, subreddit)
      join ranked r using (author, subreddit) where rn <= 5 and author in (select author from chosen) group by all)
    select author user_id, part, string_agg(subreddit || '=' || posts, ',' order by first_seq) history
    from (select *, {page} part from mine) group by all"""


def _community_users(spark, sf, **pages):
    nested = C.community_users(C.community_posts(posts(spark, sf)), **pages)
    entry = lambda h: F.concat(h["subreddit"], F.lit("="), F.concat_ws("|", h["posts"]))
    return nested.select("user_id", "part", F.concat_ws(",", F.transform("history", entry)).alias("history"))


@query(
    "community_users",
    _community_users_sql(),
)
def community_users(spark, sf):
    return _community_users(spark, sf)


@query("community_users_paged", _community_users_sql(2))
def community_users_paged(spark, sf):
    return _community_users(spark, sf, max_rows=2)


@query(
    "user_corpus",
    "select conv_id, left(string_agg(\"text\", ' ' order by turn), 4000) corpus from conversations group by conv_id",
)
def user_corpus(spark, sf):
    return C.corpus(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "text", K.CORPUS_CHARS)


@query(
    "community_corpus",
    "select conv_id, role, left(string_agg(\"text\", ' ' order by turn), 2000) corpus from conversations group by conv_id, role",
)
def community_corpus(spark, sf):
    rows = table(spark, sf, "conversations")
    return C.corpus(rows, ["conv_id", "role"], ["turn"], "text", K.COMMUNITY_CORPUS_CHARS)


# --- sessions --------------------------------------------------------------------------------
def item_key(c):
    return F.concat(F.lit("B"), F.lpad(c.cast("string"), 9, "0"))


def session_rows(spark, sf):
    """Sessions from orders: the items as text, sorted by line, some ids unknown, some too short."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    shown = lambda x: F.when(x["l_suppkey"] % 4 == 0, x["l_partkey"] + 500_000_000).otherwise(x["l_partkey"])
    quoted = lambda x: F.concat(F.lit("'"), item_key(shown(x)), F.lit("'"))
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("a"))
    text = F.concat(F.lit("["), F.concat_ws(" ", F.transform("a", quoted)), F.lit(" 'B12']"))
    return items.select(F.col("l_orderkey").alias("session_id"), text.alias("prev_items"))


def session_products(spark, sf):
    """Products from parts; every third is there twice."""
    key = F.col("p_partkey")
    rows = table(spark, sf, "part")

    def version(df, n):
        return df.select(
            item_key(key).alias("id"),
            F.concat(F.col("p_name"), F.lit(f" v{n}")).alias("title"),
            F.when(key % 5 != 0, F.col("p_brand")).alias("brand"),
            F.col("p_retailprice").alias("price"),
            F.when(key % 2 == 0, "UK").when(key % 7 == 0, "GB").otherwise("DE").alias("locale"),
            (key + n * 10_000_000_000).alias("seq"),
        )

    return version(rows, 0).unionByName(version(rows.filter(key % 3 == 0), 1))


SESSIONS_SQL = """
lines as (
  select l_orderkey session_id, l_partkey, l_suppkey % 4 = 0 as unknown,
         l_partkey + case when l_suppkey % 4 = 0 then 500000000 else 0 end shown,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 pos
  from lineitem
), found as (
  select session_id, pos, 'B' || lpad(l_partkey::VARCHAR, 9, '0') id,
         p_name || case when l_partkey % 3 = 0 then ' v1' else ' v0' end title,
         case when l_partkey % 5 <> 0 then p_brand end brand, p_retailprice price,
         case when l_partkey % 2 = 0 then 'UK' when l_partkey % 7 = 0 then 'GB' else 'DE' end locale
  from lines join part on p_partkey = l_partkey where not unknown
)"""


@query(
    "parse_items",
    f"with {SESSIONS_SQL} select session_id, string_agg('B' || lpad(shown::VARCHAR, 9, '0'), ',' order by pos) items from lines group by session_id",
)
def parse_items(spark, sf):
    rows = session_rows(spark, sf)
    return rows.select("session_id", F.concat_ws(",", item_ids(F.col("prev_items"))).alias("items"))


@query(
    "session_item_lookup",
    f"""with {SESSIONS_SQL}, texts as (
  select session_id, string_agg('- ' || title || ' (' || coalesce(brand, 'None') || ')', chr(10) order by pos) details
  from found group by session_id)
select session_id, coalesce(details, '') prev_items_details from (select distinct session_id from lines) left join texts using (session_id)""",
)
def session_item_lookup(spark, sf):
    rows = Z.session_details(session_rows(spark, sf), session_products(spark, sf))
    return rows.select("session_id", "prev_items_details")


@query(
    "locale_filter",
    "select doc_id, lang from documents where lang in ('en', 'de')",
)
def locale_filter(spark, sf):
    return table(spark, sf, "documents").filter(F.col("lang").isin("en", "de")).select("doc_id", "lang")


@query(
    "available_columns",
    f"with {SESSIONS_SQL} select distinct id, title, price, brand from found where locale in ('UK', 'GB')",
)
def available_columns(spark, sf):
    found = Z.found_items(session_rows(spark, sf), session_products(spark, sf))
    return Z.local_products(found)


@query(
    "numbered_sessions",
    "select row_number() over (order by o_orderkey) - 1 session_id, o_orderstatus from orders",
)
def numbered_sessions(spark, sf):
    rows = table(spark, sf, "orders")
    return Z.numbered_sessions(rows.select(F.col("o_orderkey").alias("seq"), "o_orderstatus"))


# --- joins, sets, tallies --------------------------------------------------------------------
@query(
    "semi_target_users",
    "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')",
)
def semi_target_users(spark, sf):
    users = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return L.of_targets(orders, users.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"], ["o_orderkey"])


@query(
    "semi_needed_items",
    "select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_quantity > 49)",
)
def semi_needed_items(spark, sf):
    needed = table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return L.needed(table(spark, sf, "part").select("p_partkey", "p_name"), needed, ["p_partkey"])


@query(
    "left_enrich_product",
    """with l as (select *, case when l_linenumber = 3 then -l_partkey else l_partkey end item from lineitem)
    select l_orderkey, l_linenumber, item l_partkey, l_extendedprice, p_name title, p_brand brand
    from l left join part on p_partkey = item""",
)
def left_enrich_product(spark, sf):
    """Third lines name an item that no product has."""
    item = F.when(F.col("l_linenumber") == 3, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", item.alias("l_partkey"), "l_extendedprice")
    products = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("brand")).alias("product")
    )
    return L.with_product(lines, products, "l_partkey").select("*", "product.title", "product.brand").drop("product")


@query(
    "spread_lookup",
    """select event_id, user_id, event_type, c_name, c_mktsegment from events left join customer on c_custkey = user_id % 50""",
)
def spread_lookup(spark, sf):
    """A lookup in which every key counts as hot, so all of them are spread over salts."""
    key = F.col("user_id") % 50
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", key.alias("c_custkey"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return lookup_join(events, customers, ["c_custkey"], "left", spread_by=["event_id"], min_rows=5).drop("c_custkey")


@query(
    "inner_persona",
    """select d.doc_id, case when d.doc_id % 4 = 1 then 'None' else "text" end persona, quality
    from labels l join documents d on d.doc_id = l.doc_id where d.doc_id % 4 not in (0, 2) and "text" <> ''""",
)
def inner_persona(spark, sf):
    """A quarter of the personas is empty, a quarter missing, and a quarter is the word None."""
    kind = F.col("doc_id") % 4
    persona = F.when(kind == 0, "").when(kind == 1, "None").when(kind == 3, F.col("text"))
    personas = table(spark, sf, "documents").select(F.col("doc_id").alias("user_id"), persona.alias("persona"))
    users = table(spark, sf, "labels").select(F.col("doc_id").alias("user_id"), "quality")
    return L.with_persona(users, personas).withColumnRenamed("user_id", "doc_id")


@query(
    "resume_rows",
    "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')",
)
def resume_rows(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return L.not_done(table(spark, sf, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query(
    "union_batches",
    """select c_custkey id, c_name name, c_acctbal balance, null::VARCHAR note from customer union all
    select s_suppkey, s_name, s_acctbal, 'supplier' from supplier""",
)
def union_batches(spark, sf):
    first = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )
    second = table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("note")
    )
    return L.merged([first, second])


@query(
    "snapshot_diff",
    """with a as (select distinct user_id id from events where ts < timestamp '2024-01-03'),
    b as (select distinct user_id id from events where ts >= timestamp '2024-01-29')
    select coalesce(a.id, b.id) id, case when a.id is null then 'added' when b.id is null then 'removed' else 'same' end state
    from a full join b on a.id = b.id""",
)
def snapshot_diff(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("id"), "ts")
    before = events.filter("ts < timestamp_ntz'2024-01-03 00:00:00'")
    after = events.filter("ts >= timestamp_ntz'2024-01-29 00:00:00'")
    return L.snapshot_diff(before, after, "id")


@query("class_distribution", "select quality, count(*) n from labels group by quality")
def class_distribution(spark, sf):
    return L.tally(table(spark, sf, "labels"), "quality")


@query("accuracy_mae", "select avg((quality = toxic)::INT::DOUBLE) accuracy, avg(abs(quality - toxic)::DOUBLE) mae from labels")
def accuracy_mae(spark, sf):
    return L.accuracy_mae(table(spark, sf, "labels"), "quality", "toxic")


@query(
    "rating_class",
    "select event_id, (least(5, greatest(1, round_even(\"value\" / 10, 0))) - 1)::INT class from events",
)
def rating_class(spark, sf):
    return table(spark, sf, "events").select("event_id", V.rating_class(F.col("value") / 10).alias("class"))


# --- runs ------------------------------------------------------------------------------------
def tasks(spark, sf):
    """Tasks from benchmark items; every third has a file."""
    key = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("t"), key.cast("string")).alias("task_id"),
        F.col("text").alias("question"),
        F.split("text", " ")[0].alias("expected_answer"),
        (key % 4 + 1).cast("string").alias("level"),
        F.when(key % 3 == 0, "a.pdf").alias("file_name"),
        F.lit("").alias("file_path"),
    )


def outcomes(spark, sf):
    """Outcomes from events: one run per event, of the task its number points to."""
    key = F.col("event_id")
    answer = F.when(key % 2 == 0, F.upper(F.concat(F.lit(" "), F.split("text", " ")[0], F.lit(" ")))).otherwise("other")
    error = F.when(key % 7 == 0, "Task Timed Out after 300 s").when(key % 11 == 0, "no module")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("_item"), "text")
    runs = table(spark, sf, "events").withColumn("_item", key % 40)
    return runs.join(items, "_item").select(
        F.concat(F.lit("t"), F.col("_item").cast("string")).alias("task_id"),
        answer.alias("system_answer"),
        F.col("value").alias("execution_time"),
        error.alias("error"),
        key.alias("run_id"),
    )


RUNS_SQL = """
runs as (
  select event_id run_id, 't' || item_id task_id, event_id % 2 = 0 as answer_match, "value" execution_time,
         event_id % 7 = 0 or event_id % 11 = 0 as failed, event_id % 7 = 0 as timed_out
  from events join benchmark on item_id = event_id % 40
)"""


@query("answer_match", f"with {RUNS_SQL} select task_id, count(*) filter (where answer_match) n from runs group by task_id")
def answer_match(spark, sf):
    records = R.result_records(tasks(spark, sf), outcomes(spark, sf))
    return records.groupBy("task_id").agg(F.count_if("answer_match").alias("n"))


@query(
    "run_summary",
    f"""with {RUNS_SQL} select count(*) total_tasks, count(*) filter (where not failed) successful_tasks,
    count(*) filter (where failed) failed_tasks, count(*) filter (where timed_out) timed_out_tasks,
    count(*) filter (where answer_match) correct_answers, round(sum(execution_time), 2) total_execution_time,
    round(avg(execution_time), 6) average_execution_time, round(count(*) filter (where answer_match) / count(*) * 100, 6) accuracy,
    round(count(*) filter (where not failed) / count(*) * 100, 6) success_rate from runs""",
)
def run_summary(spark, sf):
    summary = R.run_summary(R.result_records(tasks(spark, sf), outcomes(spark, sf)))
    digits = {"total_execution_time": 2, "average_execution_time": 6, "accuracy": 6, "success_rate": 6}
    return summary.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "run_summary_text",
    f"""with {RUNS_SQL} select concat_ws(chr(10), 'BENCHMARK SUMMARY', repeat('=', 50), '', 'Total Tasks: ' || count(*),
    'Successful Tasks: ' || count(*) filter (where not failed), 'Failed Tasks: ' || count(*) filter (where failed),
    'Timed Out Tasks: ' || count(*) filter (where timed_out), 'Correct Answers: ' || count(*) filter (where answer_match),
    printf('Accuracy: %.1f%%', round(count(*) filter (where answer_match) / count(*) * 100, 1)),
    printf('Success Rate: %.1f%%', round(count(*) filter (where not failed) / count(*) * 100, 1)),
    printf('Total Execution Time: %.2f seconds', round(sum(execution_time), 2)),
    printf('Average Execution Time: %.2f seconds', round(avg(execution_time), 2))) as text from runs""",
)
def run_summary_text(spark, sf):
    return R.summary_text(R.run_summary(R.result_records(tasks(spark, sf), outcomes(spark, sf))))


@query(
    "result_lines",
    f"""with {RUNS_SQL} select run_id, 'Task ' || task_id || ': Success=' || case when failed then 'False' else 'True' end ||
    ', Match=' || case when answer_match then 'True' else 'False' end || printf(', Time=%.2fs', execution_time) ||
    case when timed_out then ', TIMED OUT' || chr(10) || '  Error: Task Timed Out after 300 s...'
    when failed then chr(10) || '  Error: no module...' else '' end line from runs""",
)
def result_lines(spark, sf):
    records = R.result_records(tasks(spark, sf), outcomes(spark, sf))
    return R.result_line(records).select("run_id", "line")


@query(
    "task_filter",
    "select 't' || item_id task_id from benchmark where item_id % 3 <> 0",
)
def task_filter(spark, sf):
    return R.without_attachments(tasks(spark, sf)).select("task_id")


@query(
    "tasks_per_level",
    """select 't' || item_id task_id, (item_id % 4 + 1)::VARCHAR as level from (
      select *, row_number() over (partition by item_id % 4 order by md5('42:t' || item_id)) rn from benchmark)
    where (item_id % 4 in (0, 1) and rn <= 10) or (item_id % 4 = 2 and rn <= 5)""",
)
def tasks_per_level(spark, sf):
    return stratified_sample(tasks(spark, sf), "level", "task_id", K.TASKS_PER_LEVEL, 42).select("task_id", "level")


@query(
    "contains_reward",
    """select doc_id, case when contains(lower("text"), left(lower("text"), 6)) and doc_id % 2 = 0 and "text" <> '' then 1.0
    when doc_id % 5 = 0 and contains(lower("text"), 'the') then 1.0 else 0.0 end::DOUBLE reward from documents""",
)
def contains_rewards(spark, sf):
    docs = table(spark, sf, "documents")
    item = F.when(F.col("doc_id") % 2 == 0, F.left("text", F.lit(6))).otherwise("")
    title = F.when(F.col("doc_id") % 5 == 0, "THE")
    return docs.select("doc_id", contains_reward(F.col("text"), item, title).alias("reward"))
