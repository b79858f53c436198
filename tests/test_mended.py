"""Inputs that ordinary tables do not hold: blank lines, doubled keys, first-seen order, long rule lists."""

import random

from pyspark.sql import functions as F

from histloom.functions import model_output as M
from histloom.functions import web as W
from histloom.functions.nested import valid_json
from histloom.operators import enrich as E
from histloom.operators import lookups as L
from histloom.operators import ordering as O
from histloom.plans import communities as C
from histloom.plans import signals as S
from histloom.queries.records import scan_ordered_jsonl
from histloom.session import clear_loaded, load_once
from histloom.sources import readers as I


def test_blank_text_is_no_json(spark):
    rows = [("", False), ("  ", False), ("1", True), ("[1]", True), ("{} {}", False), ("null", True), ("{", False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", valid_json(F.col("t"))).collect())


def test_task_files_with_other_lines(spark, tmp_path):
    lines = ['{"task_id": "a"}', "", "// note", "[1]", "123", "  ", '{"Question": "q"}', "{oops", "null"]
    path = tmp_path / "tasks.jsonl"
    path.write_text("\n".join(lines))
    assert {(r.line_number, r.task_id) for r in I.read_tasks(spark, str(path)).collect()} == {(1, "a"), (7, "line_7")}
    bad = {(r.line_number, r.value) for r in I.read_bad_tasks(spark, str(path)).collect()}
    assert bad == {(4, "[1]"), (5, "123"), (8, "{oops"), (9, "null")}


def test_communities_in_order_of_first_post(spark):
    rows, seq = [], 0
    for sub, text in [("z", "short"), ("a", "x" * 60), ("m", "x" * 60), ("z", "x" * 60)]:
        for _ in range(6 if text != "short" else 1):
            rows.append(("u", sub, text, None, seq))
            seq += 1
    posts = spark.createDataFrame(rows, "author string, subreddit string, content string, body string, seq long")
    found = C.community_users(C.community_posts(posts)).collect()
    assert [(r.part, r.subreddits) for r in found] == [(0, ["z", "a", "m"])]
    pages = C.community_users(C.community_posts(posts), max_rows=2).orderBy("part").collect()
    assert [r.subreddits for r in pages] == [["z", "a"], ["m"]]


def test_an_empty_object_is_no_answer(spark):
    posts = spark.createDataFrame([("u", "b", 1, 0, "one"), ("u", "a", 2, 0, "two")], "user_id string, subreddit string, first_seq long, pos int, post string")
    rows = E.two_pass(posts, lambda t: "{}", lambda t: "{}" if t == "two" else '{"P": 1}', 100, 100).collect()
    assert [(r.subreddit, r.anchor_demographics["age"], r.shift_vector) for r in rows] == [("b", "unknown", {"P": 1.0})]
    seen = E.two_pass(posts, lambda t: f'{{"age": "{t}"}}', lambda t: '{"P": 1}', 100, 100).first()
    assert seen.anchor_demographics["age"] == "one two"


def test_a_persona_may_be_the_word_none(spark):
    personas = spark.createDataFrame([(1, "None"), (2, "nan"), (3, ""), (4, None)], "user_id long, persona string")
    assert {r.user_id for r in L.with_persona(spark.range(6).withColumnRenamed("id", "user_id"), personas).collect()} == {1, 2}


def test_one_row_per_cached_date(spark):
    cache = spark.sql("select date'2024-01-01' date, map('P', x) vector, v version from values (0.1D, 1), (0.3D, 3), (0.2D, 2) t(x, v)")
    users = spark.sql("select 1L user_id, date'2024-01-01' date")
    none = spark.createDataFrame([], "date date, vector map<string,double>")
    assert [r.psych_vector for r in S.attach_vectors(users, none, cache).collect()] == [{"P": 0.3}]
    fresh = cache.drop("version")
    assert [r.vector for r in S.upsert_cache(none, fresh).collect()] == [{"P": 0.3}]


def test_html5_names(spark):
    df = spark.createDataFrame([("&apos;&lbrack;&amp;lt;&notanentity;&NotEqualTilde;&AMP;",)], "t string")
    assert df.select(W.unescape(F.col("t")).alias("x")).first().x == "'[&lt;&notanentity;≂̸&"


def test_rules_as_a_table(spark):
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choices("ab/.", k=n))
    rules = [(text(rnd.randint(1, 12)), rnd.choice(["allowed", "blocked"]), i) for i in range(80)]
    pages = [(i, text(rnd.randint(0, 30))) for i in range(150)] + [(200 + i, r[0]) for i, r in enumerate(rules)] + [(900, None)]
    got = W.allowed_by_table(
        spark.createDataFrame(pages, "id long, url string"), "url", "id",
        spark.createDataFrame(rules, "url string, status string, ord long"),
    ).collect()
    place, status = {}, {}
    for url, s, i in rules:
        place.setdefault(url, i)
        status[url] = s
    order = sorted(place, key=place.get)

    def want(url):
        if url is None:
            return True
        exact = status.get(url)
        partly = next((status[u] for u in order if u in url), None)
        return (exact or partly or "allowed") == "allowed"

    assert {r["id"]: r["allowed"] for r in got} == {i: want(u) for i, u in pages}


def test_corpus_of_long_and_empty_texts(spark):
    rnd = random.Random(5)
    rows = [(f"u{i % 3}", i, rnd.choice([None, "", "ab", "x" * 30, "y" * 200])) for i in range(300)]
    want = {}
    for u, i, t in rows:
        want.setdefault(u, []).append((t or "")[:100])
    got = C.corpus(spark.createDataFrame(rows, "u string, seq long, t string"), ["u"], ["seq"], "t", 100).collect()
    assert {r.u: r.corpus for r in got} == {u: " ".join(ts)[:100] for u, ts in want.items()}


def test_samples_have_their_size(spark):
    df = spark.range(1000)
    ids = {r["id"] for r in O.uniform_sample(df, "id", 37, 1).collect()}
    order = sorted(r["id"] for r in df.orderBy(O.draw_key(1, F.col("id"))).limit(37).collect())
    assert sorted(ids) == order and O.uniform_sample(df, "id", 5000, 1).count() == 1000
    assert O.uniform_sample(df.limit(0), "id", 5, 1).count() == 0


def test_row_index_of_sparse_keys(spark):
    rnd = random.Random(6)
    keys = [rnd.getrandbits(52) for _ in range(2000)]
    got = O.row_index(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()
    assert {r.k: r.row_index for r in got} == {k: i for i, k in enumerate(sorted(keys))}
    assert O.row_index(spark.range(0), "id").count() == 0


def test_blocks_and_objects_in_answers(spark):
    texts = [
        "```python\na\n``` x ```\nb = 1\n```", "```inline``` ```js\nc\n```", "```open\nnever closed", "no fence", "``` \n```",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [[(b.language, b.code) for b in r.x] for r in df.orderBy("i").select(M.code_blocks(F.col("t")).alias("x")).collect()]
    assert got[0] == [("python", "a\n"), ("", "b = 1\n")] and got[1] == [("js", "c\n")] and got[2] == [] and got[3] == []


def test_tables_are_kept_until_cleared(spark):
    calls = []

    def load():
        calls.append(1)
        return spark.range(3)

    clear_loaded(spark)
    assert load_once(spark, "t", load).count() == load_once(spark, "t", load).count() == 3 and len(calls) == 1
    assert clear_loaded(spark) == 1 and clear_loaded(spark) == 0
    assert load_once(spark, "t", load).count() == 3 and len(calls) == 2 and clear_loaded(spark) == 1


def test_rules_meet_urls_by_their_rarest_piece(spark):
    rnd = random.Random(8)
    urls = [f"https://{rnd.choice('abc')}.example.com/{rnd.choice(['en', 'es'])}/{rnd.randrange(60)}/{'x' * rnd.randrange(9)}" for _ in range(300)]
    urls += ["", "short", None, "https://a.example.com/en/"]
    given = [(u, rnd.choice(["allowed", "blocked"])) for u in rnd.sample([u for u in urls if u], 120)]
    given += [("example.com/en/", "blocked"), ("/7/", "blocked"), ("ort", "blocked"), ("not there at all", "blocked"), (".com", "allowed")]
    for extra in ([], [("", "blocked")]):
        rules = [(u, s, n) for n, (u, s) in enumerate(rnd.sample(given + extra, len(given + extra)))]
        merged = {}
        for u, s, _ in rules:
            merged[u] = s  # a dictionary keeps the place of the first entry
        want = {}
        for n, u in enumerate(urls):
            status = None if u is None else merged.get(u) or next((s for r, s in merged.items() if r in u), None)
            want[n] = status in (None, "allowed")
        pages = spark.createDataFrame(list(enumerate(urls)), "id long, url string")
        table = spark.createDataFrame(rules, "url string, status string, ord long")
        assert {r.id: r.allowed for r in W.allowed_by_table(pages, "url", "id", table).collect()} == want


def test_a_common_piece_is_no_key_beside_a_rare_one(spark):
    urls = spark.range(200).selectExpr("concat('https://example.com/en/', id) as url")
    rules = spark.createDataFrame([("example.com/en/77", 8), ("example.com/fr/1", 8)], "_rule string, _size int")
    kept = W.rarest_pieces(urls, "url", rules).collect()
    assert [r["_rule"] for r in kept] == ["example.com/en/77"] and "77" in kept[0]["_gram"]


def test_line_numbers_run_through_the_parts_of_a_status(spark, tmp_path):
    """Numbers count all lines of a status, over ranges of keys and parts of a file."""
    rows = [(k, k % 7, "OFP"[k % 3], "1995-03-05") for k in random.Random(5).sample(range(1, 90_000), 3000)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string")
    orders.withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    held = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = scan_ordered_jsonl(spark, str(tmp_path))
        assert len(found.inputFiles()) > 6
        got = {(r.parent_asin, r.line_number) for r in found.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = set()
    for status in "OFP":
        keys = sorted(k for k, _, s, _ in rows if s == status)
        want |= {(str(k), n) for n, k in enumerate(keys, 1) if k % 10}
    assert got == want
