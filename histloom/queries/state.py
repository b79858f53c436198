"""Queries on product knowledge, enrichment, the rating model, readers and writers."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import functions as F

from histloom import constants as K
from histloom.functions import vectors as V
from histloom.operators import enrich as E
from histloom.operators import knowledge as G
from histloom.operators import progress as S
from histloom.operators.lookups import merged, tally
from histloom.operators.ordering import draw_key, row_range
from histloom.plans import rating as R
from histloom.plans import interactions as P
from histloom.plans.communities import community_posts, community_users
from histloom.plans.signals import upsert_cache
from histloom.queries import groups
from histloom.queries import interactions as Q
from histloom.queries.interactions import ACTIONS_SQL
from histloom.queries.registry import query, table, texts
from histloom.session import scratch_path, written
from histloom.sources import readers as I
from histloom.sources import versions as N
from histloom.sources import writers as O


# --- knowledge -------------------------------------------------------------------------------
def log(spark, sf):
    """An update log from events, four to an update and all on one value; the event type picks the
    list, the number the operation. Many updates remove and add the same entry."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return table(spark, sf, "events").select(
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("product"),
        F.floor(F.col("event_id") / 4).alias("seq"),
        (F.col("event_id") % 4).cast("int").alias("pos"),
        F.when(k % 4 == 0, "remove").otherwise("add").alias("op"),
        F.when(F.col("event_type") == "click", "pros").when(F.col("event_type") == "view", "cons").otherwise("info").alias("list"),
        F.concat(F.lit("v"), (F.floor(F.col("event_id") / 4) % 12).cast("string")).alias("value"),
    )


LOG_SQL = r"""
log as (select 'p' || (user_id % 5) product, event_id // 4 seq, (event_id % 4)::INT pos,
  case when regexp_extract(props, '(\d+)', 1)::INT % 4 = 0 then 'remove' else 'add' end op,
  case event_type when 'click' then 'pros' when 'view' then 'cons' else 'info' end as list,
  'v' || (event_id // 4 % 12) as value from events),
gone as (select product, list, value, max(seq) r from log where op = 'remove' group by all),
merged as (select a.product, a.list, a.value, min(a.seq) seq, (min(a.seq * 4 + a.pos) % 4)::INT pos from log a left join gone g
  on g.product = a.product and g.list = a.list and g.value = a.value
  where a.op = 'add' and (r is null or a.seq >= r) group by a.product, a.list, a.value)"""


@query("knowledge_merge", f"with {LOG_SQL} select product, list, value, seq, pos from merged")
def knowledge_merge(spark, sf):
    return G.merge(log(spark, sf))


@query("knowledge_batches", f"with {LOG_SQL} select product, list, value, seq, pos from merged")
def knowledge_batches(spark, sf):
    """The log in three runs of updates, each on top of the saved state of the runs before."""
    updates = written(log(spark, sf), "log")
    last = updates.agg(F.max("seq")).first()[0] or 0
    root = scratch_path(spark, "knowledge")
    for i in range(3):
        low, high = last * i // 3, last * (i + 1) // 3
        batch = updates.filter((F.col("seq") > low if i else F.lit(True)) & (F.col("seq") <= high))
        state = N.read_version(spark, root, G.STATE, G.ENTRY)
        N.upsert(G.advance(state, batch), root, F.col("product"))
    return G.entries_of(N.read_version(spark, root, G.STATE, G.ENTRY))


@query(
    "knowledge_lists",
    f"with {LOG_SQL} select product, list, string_agg(value, ',' order by seq, pos) as \"values\" from merged group by product, list",
)
def knowledge_lists(spark, sf):
    lists = G.entry_lists(written(G.merge(log(spark, sf)), "entries"))
    return lists.select("product", "list", F.concat_ws(",", "entries").alias("values"))


def products(spark, sf):
    known = table(spark, sf, "nation").select(
        F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("product"), F.lit("researching").alias("status")
    ).filter("product in ('p1', 'p2', 'p3', 'p24')")
    return G.prune(G.with_new_products(known, log(spark, sf)), named(spark, sf))


def named(spark, sf):
    return table(spark, sf, "region").select(
        F.concat(F.lit("p"), (F.col("r_regionkey") * 9).cast("string")).alias("product")
    )


_PRUNED = "('p0', 'p9', 'p18', 'p27', 'p36')"


@query(
    "knowledge_prune",
    f"""with {LOG_SQL}, names as (select distinct product from log union select 'p24')
    select product, case when product in {_PRUNED} then 'pruned' else 'researching' end status from names""",
)
def knowledge_prune(spark, sf):
    return products(spark, sf)


@query("knowledge_active", f"with {LOG_SQL} select * from merged where product not in {_PRUNED}")
def knowledge_active(spark, sf):
    return G.active(products(spark, sf), written(G.merge(log(spark, sf)), "entries"))


@query(
    "thought_history",
    """select conv_id, 0 part, string_agg('- ' || "text", chr(10) order by turn) history from conversations group by conv_id""",
)
def thought_history(spark, sf):
    return G.thought_history(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query(
    "thought_history_paged",
    """select conv_id, part, string_agg('- ' || "text", chr(10) order by turn) history
    from (select *, ((row_number() over (partition by conv_id order by turn) - 1) // 2)::INT part from conversations)
    group by conv_id, part""",
)
def thought_history_paged(spark, sf):
    return G.thought_history(table(spark, sf, "conversations"), "conv_id", "turn", "text", max_rows=2)


# --- enrichment ------------------------------------------------------------------------------
def _backwards(text: str) -> str:
    if len(text) % 7 == 0:
        raise ValueError("bad length")
    return text[::-1]


def conversation_rows(spark, sf):
    key = F.concat_ws("-", "conv_id", "turn")
    return table(spark, sf, "conversations").select(
        key.alias("key"),
        F.when(F.col("turn") == 5, " ").otherwise(F.col("text")).alias("text"),
        F.when(F.col("conv_id") % 4 == 0, "kept").otherwise("nan").alias("old"),
    )


_ROWS = """rows_ as (select conv_id || '-' || turn as key, conv_id, case when turn = 5 then ' ' else "text" end t from conversations),
results as (select key, case when conv_id % 4 = 0 then 'kept' when trim(t) = '' or length(t) % 7 = 0 then '' else reverse(t) end as value,
  case when conv_id % 4 = 0 then 'skipped' when trim(t) = '' or length(t) % 7 = 0 then 'error' else 'success' end status,
  case when conv_id % 4 = 0 then null when trim(t) = '' then 'empty input' when length(t) % 7 = 0 then 'bad length' end error from rows_)"""


def _flaky(text: str, tried: set[str] = set()) -> str:
    """Fails with a passing error on the first try of every third text."""
    if len(text) % 3 == 0 and text not in tried:
        tried.add(text)
        raise TimeoutError("429 rate limit")
    tried.discard(text)
    return _backwards(text)


@query("enrich_rows", f"with {_ROWS} select key, status, error, value from results")
def enrich_rows(spark, sf):
    call = E.with_retry(_flaky, retries=4, delay=0.0)
    return E.enrich_or_keep(conversation_rows(spark, sf), "key", "text", "old", call, threads=4).select(
        "key", "status", "error", "value"
    )


class _TaskLost(BaseException):
    """Ends the task that runs, as the loss of its executor would."""


def _lost_midway(root: str):
    """`_backwards`, but one task is lost in a call, once, after something has been committed."""

    def call(text: str) -> str:
        system, path = fs.FileSystem.from_uri(root)
        marker = system.get_file_info(f"{path}/lost")
        if len(text) % 5 == 0 and not marker.is_file:
            if system.get_file_info(fs.FileSelector(f"{path}/manifest", allow_not_found=True)):
                system.open_output_stream(f"{path}/lost").close()
                raise _TaskLost("executor lost")
        return _backwards(text)

    return call


@query(
    "enrich_with_progress",
    f"""with {_ROWS}, tries as (select key, case when trim(t) = '' or length(t) % 7 = 0 then '' else reverse(t) end as value,
      case when trim(t) = '' or length(t) % 7 = 0 then 'error' else 'success' end status,
      case when trim(t) = '' then 'empty input' when length(t) % 7 = 0 then 'bad length' end error, 1::BIGINT commits from rows_)
    select * from tries""",
)
def enrich_with_progress(spark, sf):
    """A task fails midway; the work goes on from what was committed, and no key is committed twice."""
    root = scratch_path(spark, "progress")
    rows = conversation_rows(spark, sf)
    for attempt in range(3):
        try:
            done = S.enrich_with_progress(rows, "key", "text", _lost_midway(root), root, every=10, threads=2, ranges=12)
            break
        except Exception:  # the lost task has ended the job, where tasks are not tried again
            if attempt == 2:
                raise
    commits = S.progress(spark, root, "key", "string").groupBy("key").agg(F.count(F.lit(1)).alias("commits"))
    return done.join(commits, "key").select("key", "value", "status", "error", "commits")


@query("status_tally", f"with {_ROWS} select status, count(*) n from results group by status")
def status_tally(spark, sf):
    rows = E.enrich_or_keep(conversation_rows(spark, sf), "key", "text", "old", _backwards)
    return tally(rows, "status")


def _describe(text: str) -> str:
    if len(text) % 4 == 0:
        return "{}"
    return f'I guess {{"age": "{text[:40]} {len(text)}", "gender": "unknown"}}' if len(text) % 2 else "no idea"


def _rate(text: str) -> str:
    if len(text) % 5 == 0:
        return "sure: {}"
    return f'{{"POWER": {len(text)}}}' if len(text) % 3 else "none"


@query(
    "two_pass_enrich",
    f"""with {groups.POSTS_SQL}, good as (select r.author, r.subreddit, rn, post from ranked r
      join full_subs f on f.author = r.author and f.subreddit = r.subreddit where rn <= 5 and r.author in (select author from chosen)),
    seen as (select author, subreddit, min(seq) first_seq from named group by all),
    people as (select author, left(string_agg(post, ' ' order by first_seq, rn), 4000) t, length(t) n from good join seen using (author, subreddit) group by author),
    places as (select author, subreddit, length(left(string_agg(post, ' '), 2000)) n from good group by all)
    select p.author user_id, p.subreddit, case when u.n % 2 = 1 then left(u.t, 40) || ' ' || u.n::VARCHAR else 'unknown' end age, p.n::DOUBLE power
    from places p join people u on u.author = p.author where p.n % 3 <> 0 and p.n % 5 <> 0""",
)
def two_pass_enrich(spark, sf):
    posts = community_posts(groups.posts(spark, sf)).select(
        F.col("author").alias("user_id"), "subreddit", "first_seq", F.posexplode("posts").alias("pos", "post")
    )
    rows = E.two_pass(written(posts, "posts"), _describe, _rate, K.CORPUS_CHARS, K.COMMUNITY_CORPUS_CHARS)
    return rows.select(
        "user_id", "subreddit", F.col("anchor_demographics")["age"].alias("age"), F.col("shift_vector")["POWER"].alias("power")
    )


# --- rating model ----------------------------------------------------------------------------
def rating_rows(spark, sf):
    """Rating rows from embeddings: a profile and an item vector per row, five classes from the
    label, split by the hash of the id."""
    unit = V.unit(F.col("embedding"))
    draw = F.conv(F.left(draw_key(42, F.col("vec_id")), F.lit(2)), 16, 10).cast("int")
    split = F.when(draw < 180, "train").when(draw < 220, "val").otherwise("test")
    return table(spark, sf, "embeddings").select(
        "vec_id", V.pair_features(unit, F.transform(unit, lambda x: F.sign(x))).alias("features"),
        F.floor(F.col("label") / 2).cast("int").alias("y"), split.alias("split"),
    )


CLASSES = 5
#: A gradient below this is near zero; at weights of 0 the largest is some hundred times that.
FLAT = 1e-3
RATING_SQL = """
unit as (select vec_id, label // 2 y, list_transform(embedding, lambda x: x::DOUBLE) v from embeddings),
feats as (select vec_id, y, list_transform(v, lambda x: abs(x) / sqrt(list_dot_product(v, v))) f from unit)"""
#: Weights that are given, not learned: what the model makes of them can be checked.
GIVEN = R.RatingModel(1.0, [((7 * i) % 5 - 2) / 4 for i in range(64)], [-0.2, -0.05, 0.05, 0.2])


@query(
    "ordinal_thresholds",
    f"with {RATING_SQL} select vec_id, k::INT k, (y > k)::INT::DOUBLE as label from feats, range(0, {CLASSES - 1}) t(k)",
)
def ordinal_thresholds(spark, sf):
    return R.with_thresholds(rating_rows(spark, sf), CLASSES).select("vec_id", "k", "label")


_PREDICTED = f"""{RATING_SQL}, scored as (select vec_id, y, list_dot_product(f, {GIVEN.weights}::DOUBLE[]) s from feats),
predicted as (select vec_id, y, ({' + '.join(f'(s > {t})::INT' for t in GIVEN.thresholds)})::INT p from scored)"""


@query("ordinal_predict", f"with {_PREDICTED} select vec_id, p from predicted")
def ordinal_predict(spark, sf):
    return rating_rows(spark, sf).select("vec_id", GIVEN.predict(F.col("features")).alias("p"))


@query(
    "ordinal_scores",
    f"with {_PREDICTED} select round(avg((y = p)::INT), 6)::DOUBLE accuracy, round(avg(abs(y - p)), 6)::DOUBLE mae from predicted",
)
def ordinal_scores(spark, sf):
    found = R.scores(GIVEN, rating_rows(spark, sf))
    return found.select(F.round("accuracy", 6).alias("accuracy"), F.round("mae", 6).alias("mae"))


@query(
    "ordinal_choice",
    """select trial, mae from (select label trial, round(avg(vec_id % 4), 1)::DOUBLE mae from embeddings group by label)
    order by mae, trial limit 1""",
)
def ordinal_choice(spark, sf):
    errors = F.round(F.avg(F.col("vec_id") % 4), 1).alias("mae")
    trials = table(spark, sf, "embeddings").groupBy(F.col("label").alias("trial")).agg(errors)
    return R.chosen_trial(trials)


@query(
    "ordinal_gradient",
    f"""with {RATING_SQL}, given as (select unnest({GIVEN.weights!r}) w, unnest(range(64)) c),
    limits as (select unnest({GIVEN.thresholds!r}) t, unnest(range({CLASSES - 1})) k),
    s as (select vec_id, y, f, list_dot_product(f, (select list(w::DOUBLE order by c) from given)) score from feats),
    r as (select vec_id, f, k, 1 / (1 + exp(t::DOUBLE - score)) - (y > k)::INT r from s, limits),
    x as (select r, unnest(f) x, unnest(range(64)) c from r),
    n as (select count(*) * {CLASSES - 1} n from feats),
    g as (select c, sum(r * x) / any_value(n) g from x, n group by c union all select 64 + k, sum(r * {R.THRESHOLD_SCALE}) / any_value(n) from r, n group by k),
    p as (select c, w::DOUBLE p from given union all select 64 + k, -t::DOUBLE / {R.THRESHOLD_SCALE} from limits)
    select c::INT coordinate, round(g + p * {GIVEN.alpha} / n, 6)::DOUBLE gradient from g join p using (c), n""",
)
def ordinal_gradient(spark, sf):
    """The gradient of the loss at the given weights."""
    rows = rating_rows(spark, sf)
    found = R.gradient(GIVEN, rows, CLASSES, rows.count())
    return found.select("coordinate", F.round("gradient", 6).alias("gradient"))


@query(
    "ordinal_fit",
    f"select a.trial::INT trial, c::INT coordinate, true flat from range({len(K.RATING_ALPHAS)}) a(trial), range({64 + CLASSES - 1}) b(c)",
)
def ordinal_fit(spark, sf):
    """The gradient at the fitted weights of every trial: near zero in every coordinate."""
    train = written(rating_rows(spark, sf).filter("split = 'train'"), "train")
    n = train.count()
    trials = [R.gradient(R.fit(train, a, CLASSES, n), train, CLASSES, n).withColumn("trial", F.lit(i)) for i, a in enumerate(K.RATING_ALPHAS)]
    return merged(trials).select("trial", "coordinate", (F.abs("gradient") < FLAT).alias("flat"))


@query("ordinal_model")
def ordinal_model(spark, sf):
    rows = rating_rows(spark, sf)
    train, val, test = (rows.filter(F.col("split") == s) for s in ("train", "val", "test"))
    blank = val.withColumn("features", F.transform("features", lambda x: F.lit(0.0)))
    return R.report(train, val, test, blank, CLASSES)


@query(
    "text_vectors",
    r"""with w as (select doc_id, unnest(string_split_regex(lower("text"), '[^\p{L}\p{N}_]+')) w from documents)
    select doc_id, count(*)::DOUBLE words, 1.0::DOUBLE size from w where w <> '' group by doc_id""",
)
def text_vectors(spark, sf):
    """The words counted in each text, and the length of its unit vector."""
    docs = texts(spark, sf, "documents", "doc_id", "text")
    counted = R.text_vectors(docs, "text", "c", unit=False)
    both = R.text_vectors(counted, "text", "v")
    add = lambda a, x: a + x
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    found = both.select("doc_id", F.aggregate("c", F.lit(0.0), add).alias("words"), F.round(length, 6).alias("size"))
    return found.filter("words > 0")


# --- readers and writers ---------------------------------------------------------------------
EVENT = "event_id long, user_id long, event_type string, value double"


@query("scan_jsonl", "select event_id, user_id, event_type, value from events")
def scan_jsonl(spark, sf):
    path = scratch_path(spark, "events.jsonl")
    events = table(spark, sf, "events")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    junk = F.when(F.col("event_id") % 50 == 0, F.array(line, F.lit(""), F.lit('{"event_id": 1,'))).otherwise(F.array(line))
    events.select(F.explode(junk).alias("value")).write.text(path)
    return I.read_jsonl(spark, path, EVENT)


@query(
    "scan_jsonl_comments",
    "select event_id, event_type, null::VARCHAR bad from events union all select null, null, '{oops' from events where event_id % 50 = 0",
)
def scan_jsonl_comments(spark, sf):
    path = scratch_path(spark, "commented.jsonl")
    line = F.to_json(F.struct("event_id", "event_type"))
    more = F.when(F.col("event_id") % 50 == 0, F.array(F.lit("// note"), line, F.lit(" "), F.lit("{oops"))).otherwise(F.array(line))
    table(spark, sf, "events").select(F.explode(more).alias("value")).write.text(path)
    good, bad = I.read_commented_jsonl(spark, path, "event_id long, event_type string")
    return good.select("event_id", "event_type", F.lit(None).cast("string").alias("bad")).unionByName(
        bad.select(F.col("value").alias("bad")), allowMissingColumns=True
    )


@query("scan_json_array", "select o_orderkey, o_totalprice from orders")
def scan_json_array(spark, sf):
    path = scratch_path(spark, "arrays")
    rows = table(spark, sf, "orders").withColumn("_b", F.floor(F.col("o_orderkey") / 5000))
    arrays = rows.groupBy("_b").agg(F.to_json(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return I.read_json_array(spark, path, "o_orderkey long, o_totalprice double")


@query(
    "scan_nested_jsonl",
    f"""with {groups.POSTS_SQL}, good as (select r.author, r.subreddit, rn, post from ranked r
      join full_subs f on f.author = r.author and f.subreddit = r.subreddit where rn <= 5 and r.author in (select author from chosen))
    select author user_id, subreddit, string_agg(post, '|' order by rn) posts from good group by all""",
)
def scan_nested_jsonl(spark, sf):
    path = scratch_path(spark, "users.jsonl")
    community_users(community_posts(groups.posts(spark, sf))).write.json(path)
    rows = I.read_jsonl(spark, path, I.COMMUNITY_USERS)
    each = rows.select("user_id", F.explode("history").alias("h"))
    return each.select("user_id", "h.subreddit", F.concat_ws("|", "h.posts").alias("posts"))


@query("scan_csv", "select doc_id, \"text\" from documents where \"text\" <> ''")
def scan_csv(spark, sf):
    path = scratch_path(spark, "documents.csv")
    O.write_csv(table(spark, sf, "documents").select("doc_id", "text"), path)
    return I.read_csv(spark, path, "doc_id long, text string", multiline=True)


@query("sink_csv", "select c_custkey, 'say \"' || c_name || '\", ok' quoted, c_acctbal from customer")
def sink_csv(spark, sf):
    path = scratch_path(spark, "customer.csv")
    quoted = F.concat(F.lit('say "'), F.col("c_name"), F.lit('", ok'))
    O.write_csv(table(spark, sf, "customer").select("c_custkey", quoted.alias("quoted"), "c_acctbal"), path)
    return I.read_csv(spark, path, "c_custkey long, quoted string, c_acctbal double")


@query(
    "scan_row_range",
    """select c_custkey, c_name, row_index from (select *, row_number() over (order by c_custkey) - 1 row_index from customer)
    where row_index >= 100""",
)
def scan_row_range(spark, sf):
    path = scratch_path(spark, "rows.csv")
    O.write_csv(table(spark, sf, "customer").select("c_custkey", "c_name"), path)
    return row_range(I.read_csv(spark, path, "c_custkey long, c_name string"), "c_custkey", 100, -1)


@query("scan_parquet", "select c_custkey, c_mktsegment from customer")
def scan_parquet(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment")


@query(
    "scan_tasks",
    """select 't' || item_id task_id, "text" question, item_id::VARCHAR expected_answer, (item_id % 3 + 1)::VARCHAR as level, '{}' annotator_metadata
    from benchmark where item_id % 5 <> 0""",
)
def scan_tasks(spark, sf):
    path = scratch_path(spark, "tasks.jsonl")
    key = F.col("item_id")
    record = F.struct(
        F.concat(F.lit("t"), key.cast("string")).alias("task_id"), F.col("text").alias("Question"),
        key.cast("string").alias("Final answer"), (key % 3 + 1).alias("Level"),
        F.when(key % 5 == 0, "x.pdf").otherwise("").alias("file_name"),
    )
    junk = ["// task", "", "   ", "[1]", "123", '"text"', "null", "{oops", "{} {}"]
    lines = F.array(*[F.lit(x) for x in junk], F.to_json(record))
    table(spark, sf, "benchmark").select(F.explode(lines).alias("value")).write.text(path)
    return I.read_tasks(spark, path, skip_attachments=True).drop("line_number")


@query(
    "scan_tasks_parquet",
    """select 't' || item_id task_id, "text" question, '' expected_answer, '' as level, null::VARCHAR annotator_metadata from benchmark""",
)
def scan_tasks_parquet(spark, sf):
    path = scratch_path(spark, "tasks") + ".parquet"
    rows = table(spark, sf, "benchmark")
    rows.select(F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("task_id"), F.col("text").alias("Question")).write.parquet(path)
    return I.read_tasks(spark, path).drop("line_number")


@query(
    "scan_partitioned",
    "select event_id, ts::DATE as day from events where ts::DATE between date '2024-01-10' and date '2024-01-12'",
)
def scan_partitioned(spark, sf):
    path = scratch_path(spark, "by_day")
    days = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    days.repartition("day").write.partitionBy("day").parquet(path)
    return I.read_days(spark, path, "2024-01-10", "2024-01-12")


def _sources(spark, sf):
    """Orders written as three JSON-lines folders by status."""
    root = scratch_path(spark, "sources")
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    line = F.to_json(F.struct("o_orderkey", "status")).alias("value")
    rows.select(line, F.concat("status", F.lit(".jsonl")).alias("name")).write.partitionBy("name").text(root)
    return I.read_many(spark, [f"{root}/name={s}.jsonl" for s in "FOP"], "o_orderkey long, status string")


@query("scan_multi_source", "select o_orderkey, o_orderstatus status, o_orderstatus || '.jsonl' source from orders")
def scan_multi_source(spark, sf):
    return _sources(spark, sf).withColumn("source", F.regexp_extract("source", "name=([^/]*)", 1))


@query("sink_fanout", "select o_orderkey, o_orderstatus status, o_orderstatus || '_enriched' target from orders")
def sink_fanout(spark, sf):
    path = scratch_path(spark, "fanout")
    rows = _sources(spark, sf).withColumn("source", F.regexp_extract("source", "name=([^/]*)", 1))
    O.write_fanout(rows, path)
    return spark.read.schema("o_orderkey long, status string, target string").json(path)


@query(
    "scan_cache",
    """select distinct ts::DATE as date, case when day(ts) % 3 = 0 then day(ts) / 31 else 0.25 end::DOUBLE power from events""",
)
def scan_cache(spark, sf):
    """A cache that is not there yet, filled, and filled again for every third day."""
    old, new = scratch_path(spark, "cache"), scratch_path(spark, "cache")
    days = table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()
    first = days.withColumn("vector", F.create_map(F.lit("POWER"), F.lit(0.25)))
    O.write_cache(upsert_cache(I.read_cache(spark, old), first), old)
    day = F.dayofmonth("date")
    again = days.filter(day % 3 == 0).withColumn("vector", F.create_map(F.lit("POWER"), day / 31.0))
    O.write_cache(upsert_cache(I.read_cache(spark, old), again), new)
    return I.read_cache(spark, new).select("date", F.col("vector")["POWER"].alias("power"))


@query(
    "cache_versions",
    """with days as (select distinct ts::DATE as date from events)
    select 'first' reader, date, 0.25::DOUBLE power from days where month(date) < 11
    union all select 'second', date, case when day(date) % 3 = 0 then day(date) / 31 else 0.25 end::DOUBLE from days
    where day(date) % 3 = 0 or month(date) < 11""",
)
def cache_versions(spark, sf):
    """A cache in versions: filled up to October, updated for every third day, and updated and
    merged again. The first reader was there before the second update and keeps its version."""
    root, month = scratch_path(spark, "cache"), F.date_format("date", "yyyy-MM")
    days = table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()
    power = lambda x: F.create_map(F.lit("POWER"), x).alias("vector")
    N.upsert(days.filter(F.month("date") < 11).select("date", power(F.lit(0.25))), root, month)
    first = N.read_version(spark, root, I.CACHE, ["date"])
    third = days.filter(F.dayofmonth("date") % 3 == 0)
    N.upsert(third.select("date", power(F.lit(0.75))), root, month)
    N.upsert(third.select("date", power(F.dayofmonth("date") / 31.0)), root, month)
    N.compact(spark, root, I.CACHE, ["date"], month, most_deltas=2)
    second = N.read_version(spark, root, I.CACHE, ["date"])
    return merged(
        [df.select(F.lit(name).alias("reader"), "date", F.col("vector")["POWER"].alias("power")) for name, df in (("first", first), ("second", second))]
    )


@query("sink_split_json", "select c_custkey, c_nationkey category, case when c_custkey % 10 = 0 then 'val' else 'train' end split from customer")
def sink_split_json(spark, sf):
    path = scratch_path(spark, "splits")
    split = F.when(F.col("c_custkey") % 10 == 0, "val").otherwise("train")
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("category"), split.alias("split"))
    O.write_split_json(rows, path)
    O.write_split_json(rows.filter("category < 5"), path)  # a rerun of some categories changes nothing
    return spark.read.schema("c_custkey long, category int, split string").json(path)


@query(
    "sink_keyed_json",
    "select p_partkey::VARCHAR id, p_name title, case when p_partkey % 2 = 0 then p_brand end brand from part",
)
def sink_keyed_json(spark, sf):
    path = scratch_path(spark, "keyed")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("brand")
    )
    O.write_keyed_json(rows, "p_partkey", path)
    back = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,struct<title:string,brand:string>>")).alias("id", "v"))
    return back.select("id", "v.title", "v.brand")


@query(
    "sink_user_json",
    f"""with {ACTIONS_SQL}, ns as (select user_id, count(distinct session_id) n from ev group by user_id),
    np as (select user_id, count(*) n, string_agg(session_id || '|' || coalesce(nullif(asin, '0000000000'), '?') || '|' || title || '|' || price, ';' order by seq, pos) listed
      from items where type = 'purchase' group by user_id)
    select user_id::VARCHAR user_id, gold_persona persona, coalesce(ns.n, 0) num_sessions, coalesce(np.n, 0) num_purchases, coalesce(listed, '') listed
    from personas left join ns using (user_id) left join np using (user_id)""",
)
def sink_user_json(spark, sf):
    path = scratch_path(spark, "users")
    sessions = Q.sessions(spark, sf)
    bought = written(P.purchases(sessions, Q.actions(spark, sf).drop("user_id")), "purchases")
    O.write_documents(P.user_json(P.interview_personas(Q.users(spark, sf)), sessions, bought), path)
    schema = (
        "user_id string, persona string, num_sessions long, num_purchases long, "
        "purchases array<struct<session_id:string,asin:string,title:string,price:string,options:string>>"
    )
    rows = I.read_jsonl(spark, path, schema)
    shown = lambda p: F.concat_ws("|", p["session_id"], F.coalesce(p["asin"], F.lit("?")), p["title"], p["price"])
    listed = F.concat_ws(";", F.transform("purchases", shown)).alias("listed")
    return rows.select("user_id", "persona", "num_sessions", "num_purchases", listed)
