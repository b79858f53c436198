"""Plans, scores, state, readers and writers on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from histloom import constants as K
from histloom.functions import model_output as M
from histloom.functions import vectors as V
from histloom.operators import enrich as E
from histloom.operators import knowledge as G
from histloom.plans import communities as C
from histloom.plans import evaluation as P
from histloom.plans import interactions as X
from histloom.plans import pages as H
from histloom.plans import rating as R
from histloom.plans import reviews as L
from histloom.plans import runs as B
from histloom.plans import sessions as Z
from histloom.plans import signals as S
from histloom.sources import readers as I
from histloom.sources import writers as O


def write_lines(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


# --- readers and writers -------------------------------------------------------------------
def test_read_jsonl_skips_bad_lines(spark, tmp_path):
    path = write_lines(tmp_path / "a.jsonl", ['{"a": 1, "p": "$3"}', "", "{bad", "[1]", '{"a": "x", "p": 4.5}', '{"p": null}'])
    rows = I.read_jsonl(spark, path, "a int, p string").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, "$3"), (None, "4.5"), (None, None)], key=str)


def test_lines_with_more_than_one_value_are_bad(spark, tmp_path):
    lines = ['{"a": 1} x', '{"a": 2}{"a": 3}', "{'a': 4}", '{"a": 5} ', '{"a": 6, "p": "} {"}', '{"a": 7}, {"a": 8}']
    rows = I.read_jsonl(spark, write_lines(tmp_path / "b.jsonl", lines), "a int, p string").collect()
    assert sorted(r.a for r in rows) == [5, 6]


def test_numbered_lines_over_many_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    path = write_lines(tmp_path / "long.txt", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        df = I.numbered_lines(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        got = {r.line_number: r.value for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i + 1: x for i, x in enumerate(lines)}


def test_commented_lines(spark, tmp_path):
    path = write_lines(tmp_path / "t.jsonl", ["// head", '{"a": 1}', "  ", "{oops", ' {"a": 2} '])
    good, bad = I.read_commented_jsonl(spark, path, "a int")
    assert sorted((r.line_number, r.a) for r in good.collect()) == [(2, 1), (5, 2)]
    assert [(r.line_number, r.value) for r in bad.collect()] == [(4, "{oops")]


def test_read_tasks(spark, tmp_path):
    lines = [
        "// c", '{"task_id": "a", "Question": "q", "Final answer": "1", "Level": 2, "Annotator Metadata": {"n": 1}}',
        '{"Question": "r", "Level": "3", "file_name": "x.pdf"}', "{bad", '{"Question": null}',
    ]
    path = write_lines(tmp_path / "t.jsonl", lines)
    got = {r.line_number: r for r in I.read_tasks(spark, path).collect()}
    assert sorted(got) == [2, 3, 5]
    assert (got[2].task_id, got[2].level, json.loads(got[2].annotator_metadata)) == ("a", "2", {"n": 1})
    assert (got[3].task_id, got[3].level, got[3].expected_answer) == ("line_3", "3", "")
    assert got[5].question is None and got[5].task_id == "line_5"
    assert {r.line_number for r in I.read_tasks(spark, path, skip_attachments=True).collect()} == {2, 5}
    table = str(tmp_path / "t.parquet")
    spark.createDataFrame([("", "q1"), ("b", "q2")], "task_id string, Question string").coalesce(1).write.parquet(table)
    assert [r.task_id for r in I.read_tasks(spark, table).orderBy("line_number").collect()] == ["row_1", "b"]


def test_product_meta_fields(spark, tmp_path):
    lines = ['{"parent_asin": "", "asin": "A", "Brand": "Up", "brand": "low", "price": 3.5}', '{"asin": "A", "brand": "low", "price": "$4"}', "bad"]
    meta = I.read_product_meta(spark, write_lines(tmp_path / "m.jsonl", lines))
    assert [(r.asin, r.brand, r.price) for r in meta.orderBy("seq").collect()] == [("A", "Up", "3.5"), ("A", "low", "$4")]
    product = L.products_from_meta(meta).collect()
    assert [(r.parent_asin, r.product.brand, r.product.price) for r in product] == [("A", "low", None)]


def test_split_json_rerun_and_keyed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "train"), (2, "b", "val")], "id int, category string, split string")
    path = str(tmp_path / "s")
    O.write_split_json(rows, path)
    O.write_split_json(rows.filter("category = 'a'"), path)
    assert spark.read.schema("id int, category string, split string").json(path).count() == 2
    lines = [json.loads(r.value) for r in O.keyed_json(rows.select("id", "category"), "id").collect()]
    assert sorted(lines, key=str) == [{"1": {"category": "a"}}, {"2": {"category": "b"}}]


def test_cache_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "c")
    empty = I.read_cache(spark, path)
    assert empty.count() == 0
    fresh = spark.sql("select date'2024-01-01' date, map('POWER', 0.5D) vector")
    O.write_cache(S.upsert_cache(empty, fresh), path)
    newer = spark.sql("select date'2024-01-01' date, map('POWER', 0.7D) vector")
    assert S.upsert_cache(I.read_cache(spark, path), newer).first().vector == {"POWER": 0.7}
    first = O.write_snapshot(fresh, str(tmp_path), 0, 10, 100)
    log = spark.createDataFrame([(0, 10, first, 5), (0, 10, "newest", 9), (0, 20, "other", 11)], "start int, end int, path string, written_at int")
    assert I.latest_snapshot(log, 0, 10).first().path == "newest"


# --- reviews, sessions, communities ----------------------------------------------------------
def test_review_histories(spark):
    reviews = [("u1", "c", f"p{i}", t, 4.0, f"t{i}", f"text {i}", i) for i, t in enumerate([50, 10, None, 40, 50, 99])]
    reviews += [("u2", "c", "p1", 1, 5.0, "t", "x", 100), ("u3", "c", "p1", 1, 5.0, "t", "x", 101)]
    df = spark.createDataFrame(reviews, "user_id string, category string, parent_asin string, timestamp long, rating double, title string, text string, seq long")
    meta = spark.createDataFrame([("p1", None, "Lamp", "b", "12.5", "m", 1), ("p1", None, "Lamp 2", "b", "$1", "m", 2)], "parent_asin string, asin string, title string, brand string, price string, main_category string, seq long")
    core = spark.createDataFrame([("u1", "c", 0), ("u2", "c", 1), ("u1", "c", 2)], "user_id string, category string, seq long")
    rows = L.review_histories(df, meta, core)
    # the first five reviews in file order; the later of the two at time 50 is held out
    assert {r.seq: r.role for r in rows.collect()} == {0: "history", 1: "history", 2: "history", 3: "history", 4: "heldout"}
    user = L.nested_histories(rows).first()
    assert [h.parent_asin for h in user.history] == ["p2", "p1", "p3", "p0"]
    assert user.heldout.parent_asin == "p4" and user.heldout.product is None
    assert user.history[1].product.title == "Lamp 2" and user.history[1].product.price is None
    assert user.split == "training"


def test_community_thresholds(spark):
    data, seq = [], 0

    def post(author, sub, n, size=60):
        nonlocal seq
        for _ in range(n):
            seq += 1
            data.append((author, sub, "x" * size, None, seq))

    for sub in "abc":
        post("good", sub, 6)
    post("good", "d", 4)
    for sub in "ab":
        post("few", sub, 9)
    for sub in "abc":
        post("short", sub, 4)
        post("short", sub, 3, 50)
        post("edge", sub, 5, 51)
        post(K.DELETED_AUTHOR, sub, 9)
    df = spark.createDataFrame(data, "author string, subreddit string, content string, body string, seq long")
    users = {r.user_id: r for r in C.community_users(C.community_posts(df)).collect()}
    assert set(users) == {"good", "edge"}
    assert users["good"].subreddits == ["a", "b", "c"] and all(len(h.posts) == 5 for h in users["good"].history)


def test_corpus_cuts(spark):
    df = spark.createDataFrame([("u", i, t) for i, t in enumerate(["ab", "", None, "cdef", "gh"])], "u string, n int, t string")
    assert C.corpus(df, ["u"], ["n"], "t", 8).first().corpus == "ab   cde"


def test_session_details(spark):
    sessions = spark.createDataFrame([(0, "['B000000001' 'B000000002' 'B000000001']"), (1, "['B999999999']"), (2, None)], "session_id long, prev_items string")
    products = spark.createDataFrame([("B000000001", "old", "x", "UK", 1), ("B000000001", "new", None, "DE", 2), ("B000000002", "two", "b", "GB", 3)], "id string, title string, brand string, locale string, seq long")
    got = {r.session_id: r.prev_items_details for r in Z.session_details(sessions, products).collect()}
    assert got == {0: "- new (None)\n- two (b)\n- new (None)", 1: "", 2: ""}
    assert Z.local_products(Z.found_items(sessions, products)).columns == ["id", "title", "brand"]


# --- signals ---------------------------------------------------------------------------------
def signals(spark, **given):
    row = {n: given.get(n) for n in K.SIGNAL_CODES}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} double" for n in row))


def test_signal_vector_branches(spark):
    direct = signals(spark, val_power=1.0, val_security=0.002, val_universalism=0.0, backup_risk=9.0)
    v = direct.select(V.signal_vector().alias("v")).first().v
    assert v["SECURITY"] == 0.002 and v["POWER"] == 0.998
    proxy = signals(spark, val_power=1.0, val_security=0.001, backup_social=2.0, backup_anger=1.0, backup_risk=float("nan"))
    v = proxy.select(V.signal_vector().alias("v")).first().v
    assert v["UNIVERSALISM"] == v["BENEVOLENCE"] == round(1 / 4.3, 3) and v["CONFORMITY"] == round(0.8 / 4.3, 3) and v["SECURITY"] == 0.0
    assert signals(spark).select(V.signal_vector().alias("v")).first().v is None


def test_window_means_differ_by_weight(spark):
    def row(day, power):
        return (day, f"c2.156:{power},c5.7:x", "1#US#")

    news = spark.createDataFrame([row("2024-01-01", 1), row("2024-01-02", 4), row("2024-01-02", 4), row("2024-01-09", 99)], "day string, GCAM string, V2Locations string").withColumn("day", F.to_date("day"))
    users = spark.sql("select 1 user_id, date'2024-01-02' date union all select 2, date'2030-01-01'")
    daily = S.daily_signals(news)
    by_day = S.mean_of_daily_means(users, daily).collect()
    by_row = S.mean_of_rows(users, news).collect()
    assert [(str(r.date), r.val_power, r.val_achievement) for r in by_day] == [("2024-01-02", 2.5, None)]
    assert [r.val_power for r in by_row] == [3.0]


def test_traits_and_grades(spark):
    df = spark.sql("select map('A', 0.2D, 'B', 0.5D, 'C', 0.5D) t, map('5', 6, '14', 0, '21', 4, '3', 2) a")
    top = df.select(V.top_trait(F.col("t")).alias("x"), V.max_gap_trait(F.col("t"), F.create_map(F.lit("A"), F.lit(0.8))).alias("g")).first()
    assert top.x.key == "B" and top.g.trait == "A" and top.g.actual == 0.8
    s = df.select(V.trait_scores(F.col("a")).alias("s")).first().s
    assert s["SECURITY"] == 5.0 and s["UNIVERSALISM"] == 2.0 and s["POWER"] == 0.0 and len(s) == 10
    grades = spark.sql("""select map('SECURITY', 1D) t, map('SECURITY', 4.5D) s union all select map('SECURITY', 1D), map('SECURITY', 3.5D)
      union all select map('SECURITY', 1D), map('SECURITY', 3.4D) union all select null, map('SECURITY', 3.4D) union all select map('SECURITY', 1D), map()""")
    assert [r.g for r in grades.select(V.alignment_grade(F.col("t"), F.col("s")).alias("g")).collect()] == [1.0, 0.5, 0.0, 0.5, 0.0]


def test_calibration(spark):
    raw = {"POWER": 0.4, "SECURITY": 0.1, "OTHER": 0.02}
    df = spark.createDataFrame([(raw,), ({"POWER": 0.0},)], "v map<string,double>")
    w = [r.x for r in df.select(V.calibrate_by_weights(F.col("v")).alias("x")).collect()]
    total = 0.4 * 0.25 + 0.1 * 3 + 0.02
    assert w[0] == {"POWER": round(0.1 / total, 3), "SECURITY": round(0.3 / total, 3), "OTHER": round(0.02 / total, 3)}
    assert w[1] == {"POWER": 0.0}
    m = df.select(V.calibrate_by_means(F.col("v")).alias("x")).first().x
    total = 0.4 / 0.3815 + 0.1 / 0.0875 + 2
    assert m["OTHER"] == round(2 / total, 3)


# --- scores ----------------------------------------------------------------------------------
def grade(traits, excerpts, names=False):
    """Grounding, counted quote by quote."""
    def tidy(s):
        return " ".join(s.split()).lower()

    total = good = covered = 0
    for quotes in traits:
        valid = 0
        for quote, at in quotes:
            q = tidy(quote)
            if names and at == -1 and q.upper() in K.VALUE_NAMES:
                total, valid = total + 1, valid + 1
            elif len(q) >= 12:
                total += 1
                valid += type(at) is int and 0 <= at < len(excerpts) and q in tidy(excerpts[at])
        good, covered = good + valid, covered + (valid > 0)
    return 0.5 * good / total + 0.5 * covered / len(traits) if traits and total else 0.0


@pytest.mark.parametrize("names", [False, True])
def test_grounding_random(spark, names):
    rnd = random.Random(11)
    texts = ["the quick  brown fox jumps", "over the\nlazy dog again", "security matters a lot"]
    quotes = ["quick brown fox", "The Lazy  Dog", "lazy dog agai", "short", "security", "twelve chars", "jumps over the"]
    data, want = [], []
    for i in range(200):
        traits = [[(rnd.choice(quotes), rnd.choice([0, 1, 2, -1, 7, "0", None])) for _ in range(rnd.randrange(4))] for _ in range(rnd.randrange(4))]
        body = {"traits": [{"trait": "t", "evidence_quotes": [{"quote": q, "source_index": at} for q, at in qs]} for qs in traits], "persona_description": "d"}
        data.append((i, rnd.choice(["{}", "```json\n{}\n```", "so {} end"]).replace("{}", json.dumps(body)), texts))
        want.append(grade(traits, texts, names))
    df = spark.createDataFrame(data, "i int, raw string, ex array<string>")
    got = P.with_grounding(M.with_traits(df, "raw"), "traits", "ex", "g", names).orderBy("i").collect()
    assert [r.g for r in got] == [pytest.approx(w) for w in want]


def test_bad_answers(spark):
    df = spark.createDataFrame([(0, "{"), (1, "```json\n{\"traits\": null}\n```"), (2, None), (3, "[1]")], "i int, raw string")
    got = M.with_traits(df, "raw").orderBy("i").collect()
    assert [(r.traits, r.persona_description) for r in got] == [([], "")] * 4


def test_sections(spark):
    items = [("a", "2", "click"), ("b", None, "purchase"), ("c", "3", "other"), ("d", "4", "cart"), (None, "5", "purchase")]
    rows = spark.createDataFrame([("u", n, 0, *i) for n, i in enumerate(items)], "user_id string, seq long, pos int, title string, price string, type string")
    users = spark.createDataFrame([("u", "x" * 200)], "user_id string, interview_transcript_processed string")
    pages = {(r.section, r.part): r.text for r in X.section_pages(users, rows, max_rows=1).collect()}
    assert pages == {(0, 0): "**Purchased Products:**\n- b (None)", (0, 1): "- None (5)", (1, 0): "**Items Added to Cart (but not bought):**\n- d (4)", (2, 0): "**Clicked / Viewed Items:**\n- a (2)"}
    assert [r.text for r in X.section_pages(users, rows, ["cart"]).collect()] == [pages[1, 0]]
    assert X.section_pages(users, rows, []).count() == 0


def test_interactions_collapse_missing_ids(spark):
    sessions = spark.createDataFrame([("s1", "u")], "session_id string, user_id string")
    rows = [("s1", "click", "purchase", '[{"title": "a"}, {"title": "b"}, {"asin": "x"}]', 1), ("s1", "click", "product_link", '[{"asin": "x"}]', 2), ("s1", "click", "purchase", '[{"asin": "x", "title": "late"}]', 3), ("s2", "click", "purchase", '[{"asin": "y"}]', 4)]
    acts = spark.createDataFrame([(*r[:4], None, r[4]) for r in rows], "session_id string, action_type string, click_type string, products string, page_meta string, seq long")
    got = sorted((r.seq, r.asin, r.title, r.type) for r in X.interactions(sessions, acts).collect())
    assert got == [(1, "0000000000", "a", "purchase"), (1, "x", "Unknown Title", "purchase"), (2, "x", "Unknown Title", "click")]


def test_empty_run_summary(spark):
    empty = spark.createDataFrame([], "success boolean, answer_match boolean, timed_out boolean, execution_time double")
    row = B.run_summary(empty).first()
    assert (row.total_tasks, row.total_execution_time, row.average_execution_time, row.accuracy) == (0, 0.0, 0.0, None)


# --- knowledge -------------------------------------------------------------------------------
def test_knowledge_merge_random(spark):
    rnd = random.Random(2)
    data, want = [], {}
    for seq in range(300):
        product, name = f"p{rnd.randrange(3)}", rnd.choice(["pros", "cons"])
        out = [f"v{rnd.randrange(8)}" for _ in range(rnd.randrange(3))]
        new = [f"v{rnd.randrange(8)}" for _ in range(rnd.randrange(3))]
        data += [(product, seq, i, "remove", name, v) for i, v in enumerate(out)]
        data += [(product, seq, i, "add", name, v) for i, v in enumerate(new)]
        kept = [v for v in want.get((product, name), []) if v not in out]
        want[product, name] = list(dict.fromkeys(kept + new))
    log = spark.createDataFrame(data, "product string, seq long, pos int, op string, list string, value string")
    got = {(r.product, r.list): r.entries for r in G.entry_lists(G.merge(log)).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_prune_only_known(spark):
    known = spark.createDataFrame([("a", "researching"), ("b", "pruned")], "product string, status string")
    seen = spark.createDataFrame([("b",), ("c",), ("c",)], "product string")
    out = G.prune(G.with_new_products(known, seen), spark.createDataFrame([("c",), ("zzz",)], "product string"))
    assert {r.product: r.status for r in out.collect()} == {"a": "researching", "b": "pruned", "c": "pruned"}


# --- enrichment ------------------------------------------------------------------------------
def test_retry_waits():
    waits, calls = [], []

    def flaky(text):
        calls.append(text)
        if len(calls) < 4:
            raise RuntimeError(["429 slow down", "Connection refused", "Timeout"][len(calls) - 1])
        return "ok"

    assert E.with_retry(flaky, retries=5, sleep=waits.append)("x") == "ok" and waits == [2.0, 30.0, 2.0]
    with pytest.raises(ValueError):
        E.with_retry(lambda t: (_ for _ in ()).throw(ValueError("bad prompt")), sleep=waits.append)("x")
    assert len(waits) == 3


def test_enrich_statuses(spark):
    rows = spark.createDataFrame([(1, "a", ""), (2, " ", None), (3, "boom", "nan"), (4, "b", "old"), (5, "c", "")], "id long, text string, value string")

    def fn(text):
        if text == "boom":
            raise RuntimeError("boom")
        return text * 2

    done = spark.createDataFrame([(5,)], "id long")
    got = {r.id: (r.value, r.status) for r in E.enrich_or_keep(rows, "id", "text", "value", fn, done=done, threads=2, partitions=2).collect()}
    assert got == {1: ("aa", "success"), 2: ("", "error"), 3: ("", "error"), 4: ("old", "skipped")}


# --- pages and rating ------------------------------------------------------------------------
def test_microdata(spark):
    html = """<div itemscope itemtype="P"><h1 itemprop="name title"> A
      <i>b</i></h1><img itemprop="image" src="i.png"><div itemprop="offer" itemscope itemtype="O"><meta itemprop="price" content="5"></div>
      <span itemscope itemtype="X"><b itemprop="in">z</b></span><p itemprop="tag">1</p><p itemprop="tag">2</p><p itemprop="tag">3</p></div>"""
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id long, html string")
    got = [(r.item, r.parent, r.parent_prop, r.item_type, r.prop, r.value) for r in H.microdata(pages).orderBy("item", "pos").collect()]
    assert got == [
        (0, None, None, "P", "name", "A       b"), (0, None, None, "P", "title", "A       b"), (0, None, None, "P", "image", "i.png"),
        (0, None, None, "P", "tag", "1"), (0, None, None, "P", "tag", "2"), (0, None, None, "P", "tag", "3"),
        (1, 0, "offer", "O", "price", "5"), (2, None, None, "X", "in", "z"),
    ]


def test_rating_model_learns_order(spark):
    rnd = random.Random(4)
    data = []
    for _ in range(400):
        x = [rnd.gauss(0, 1) for _ in range(3)]
        data.append((x, min(4, max(0, round(2 + 1.5 * x[0] + rnd.gauss(0, 0.2))))))
    df = spark.createDataFrame(data, "features array<double>, y int")
    model, trials = R.tune(df, df, 5, alphas=[0.01, 1000.0])
    assert model.alpha == 0.01 and model.thresholds == sorted(model.thresholds)
    majority = min(sum(abs(y - c) for _, y in data) / len(data) for c in range(5))
    assert trials.filter("chosen").first().mae < 0.5 * majority
