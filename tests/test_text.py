"""Text operators against plain Python on random texts, and on cases made by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from histloom import constants as K
from histloom.functions import documents as D
from histloom.functions import model_output as M
from histloom.functions import nested as N
from histloom.functions import text as T
from histloom.functions import web as W

WORDS = ["I", "love", "it", "because", "price", "é", "so", "thing", "éso", "3.5", "12", "won't buy", "great", "x" * 40, " ", "ok"]


def text_of(rnd):
    parts = []
    for _ in range(rnd.randrange(0, 14)):
        words = [rnd.choice(WORDS) for _ in range(rnd.randrange(1, 30))]
        parts.append(" ".join(words) + rnd.choice([". ", "! ", "? ", ".\n\n", "", ".", " "]))
    return rnd.choice(["", " ", "\n"]) + "".join(parts)


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def sentences_of(text):
    return [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]


SIGNAL = re.compile("|".join(rf"\b(?:{w})\b" for w in [*K.SIGNAL_WORDS, r"\d+(?:\.\d+)?"]))


def points(s):
    return 2 * len(SIGNAL.findall(s.lower())) + min(len(s), 200) // 80


def best_sentences(text, budget, least=2):
    """The excerpt, by ranking sentence numbers and filling the budget."""
    if not text.strip():
        return ""
    parts = sentences_of(text)
    picked, used = set(), 0
    if len(parts) > least:
        for n in sorted(range(len(parts)), key=lambda n: (points(parts[n]), n), reverse=True):
            size = len(parts[n]) + 1
            if used + size <= budget:
                picked.add(n)
                used += size
                if used >= 0.7 * budget and len(picked) >= least:
                    break
    if not picked:
        return text[:budget]
    texts = {parts[n] for n in picked}
    return " ".join(p for p in parts if p in texts)[:budget]


def test_sentences_and_scores(spark):
    rnd = random.Random(1)
    texts = [text_of(rnd) for _ in range(300)]
    assert column(spark, texts, T.sentences) == [sentences_of(t) for t in texts]
    lines = [s for t in texts for s in sentences_of(t)][:800]
    assert column(spark, lines, T.sentence_score_by_match) == [points(s) for s in lines]


@pytest.mark.parametrize("budget", [60, 300, 900])
def test_excerpt_random(spark, budget):
    rnd = random.Random(budget)
    texts = [text_of(rnd) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    got = T.with_excerpt(df, "v", "x", budget).orderBy("i").collect()
    assert [r.x for r in got] == [best_sentences(t, budget) for t in texts]


def test_excerpt_edges(spark):
    texts = [None, "", "   ", "One. Two.", "a. a. a. b.", "x" * 950 + ". y. z."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    got = [r.x for r in T.with_excerpt(df, "v", "x").orderBy("i").collect()]
    assert got[:5] == ["", "", "", "One. Two.", "a. a. a. b."]
    assert got[5] == "y. z."


def pieces_of(text, size):
    """Pieces of at least `size` characters, by looking for the next gap after each."""
    out, at = [], 0
    gap = re.compile(r"[ \t\r\n]")
    while at < len(text):
        found = gap.search(text, at + size - 1)
        end = found.end() if found else len(text)
        out.append(text[at:end])
        at = end
    return out or [""]


@pytest.mark.parametrize("size", [1, 5, 40])
def test_chunks_random(spark, size):
    rnd = random.Random(size)
    texts = ["".join(rnd.choice("ab \n\té") for _ in range(rnd.randrange(0, 120))) for _ in range(400)]
    assert column(spark, texts, lambda c: D.chunks(c, size)) == [pieces_of(t, size) for t in texts]


def test_find_chunk(spark):
    text = "alpha beta gamma. " + "delta epsilon " * 3 + "alpha beta zeta"
    got = column(spark, [text] * 2, lambda c: D.find_chunk(D.chunks(c, 10), "ALPHA  beta", F.lit(1)))
    parts = pieces_of(text, 10)
    assert got[0] == max(i for i, p in enumerate(parts) if p.startswith("alpha"))
    assert column(spark, [text], lambda c: D.find_chunk(D.chunks(c, 10), "eps*", F.lit(0)))[0] is not None
    assert column(spark, [text], lambda c: D.find_chunk(D.chunks(c, 10), "nothing", F.lit(0))) == [None]
    assert D.search_pattern(" ,. ") is None and D.search_pattern("a * b") == " a.* b "


def test_item_ids(spark):
    got = column(spark, ["['B08V12CT4C' 'B08V1KXBQD'\n 'b08v12ct4c' 'B08V12CT4CX']", None, ""], T.item_ids)
    assert got == [["B08V12CT4C", "B08V1KXBQD"], [], []]


def test_tags(spark):
    text = "a <d> one </d> b <d>two\nlines </d> c"
    assert column(spark, [text, " none "], lambda c: T.first_tagged(c, "d")) == ["one", "none"]
    assert column(spark, [text, " none "], lambda c: T.last_tagged(c, "d")) == ["two\nlines", "none"]


def test_section_line(spark):
    heading = "### Shopping Preference"
    texts = [f"x\n{heading} \n\n likes a\nb", f"{heading} no line", " plain "]
    assert column(spark, texts, lambda c: T.section_line(c, heading)) == [" likes a", f"{heading} no line", "plain"]


def test_usable_text(spark):
    texts = ["a", " NaN ", "None", "null", "", None, "nothing"]
    assert column(spark, texts, T.usable_text) == [True, False, False, False, False, False, True]


def test_keyword_sentences(spark):
    texts = ["I buy shoes. I read reviews closely! Prices matter.", "They use an AI tool."]
    got = column(spark, texts, lambda c: T.without_keyword_sentences(c, K.NON_INFERABLE, "fallback"))
    assert got == ["I buy shoes. Prices matter.", "fallback"]


def test_keyword_sentences_are_found_once_by_plain_search(spark):
    """The search is no alternation of all keywords, which compares each place with each of them,
    and neither it nor the cut into sentences is in the plan twice."""
    texts = [None, "", " ", "A. \n b! a.b", "Is it c++? No. It IS.", "c+ +. \u00c4 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = df.select("i", T.without_keyword_sentences(F.col("t"), ["c++", "a.b", "\u00e4 X".lower()], "-").alias("o"))
    assert [r.o for r in out.orderBy("i").collect()] == ["-", "-", "-", "A. b!", "No. It IS.", "c+ +."]
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan and plan.count("split(") == 1


def test_normalize_text(spark):
    assert column(spark, ["  A \n b ", None, "x" * 30], lambda c: T.normalize_text(c, 24)) == ["a b", "", "x" * 24]


def test_rewards_and_matches(spark):
    df = spark.createDataFrame([("Buy B01 now", "b01", ""), ("The Big Lamp", "", "big lamp"), ("x", "", "")], "a string, i string, t string")
    got = df.select(T.contains_reward(F.col("a"), F.col("i"), F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == [1.0, 1.0, 0.0]


def test_strip_ansi_and_lines(spark):
    assert column(spark, ["\x1b[1;31mred\x1b[0m \x1bMup"], T.strip_ansi) == ["red up"]
    assert column(spark, ["a\n\n b \n \nc\nd"], lambda c: T.first_lines(c, 5)) == ["a\n b \nc"]
    assert column(spark, [" a  b\nc d "], lambda c: T.truncate_tokens(c, 3)) == ["a b c"]


def test_verdicts(spark):
    assert column(spark, ["1: no\n2: YES\n3:NO\n4: yes", "", "1: YES 3: YES"], M.verdict_score4) == [1.0, 0.0, 0.0]
    text = "1. It does not list. Verdict: YES\n2. YES\n3. NO\n4. NO\n5. YES"
    assert column(spark, [text], M.verdict_score5) == [pytest.approx(0.6)]
    # the loose form finds "no" inside "not" and so reads the first verdict as NO
    assert column(spark, [text], lambda c: M.verdict_score5(c, loose=True)) == [pytest.approx(0.8)]


def test_code_blocks(spark):
    got = column(spark, ["a ```python\nx = 1\n``` b ```\nls -l\n``` c ``` d"], M.code_blocks)
    assert [(b.language, b.code) for b in got[0]] == [("python", "x = 1\n"), ("", "ls -l\n")]


def test_lists_and_objects(spark):
    texts = ['x ```json\n["a", "b", "c"]\n``` y', "```json\n[1,\n```", "none"]
    assert column(spark, texts, lambda c: M.list_in_text(c, 2)) == [["a", "b"], [], []]
    assert column(spark, ['say {"a": 1} now', "{bad}", "no"], M.json_in_text) == [{"a": "1"}, None, None]


def test_products_with_defaults(spark):
    rows = [
        (1, "purchase", '[{"asin": null, "price": 3}, 5, {"title": "t", "options": [{"c": "red"}]}]', None),
        (2, "purchase", '{"asin": "x"}', None),
        (3, "cart_side_bar", "[]", '{"cart_items": [{"asin": "c"}]}'),
        (4, "product_link", None, '{"cart_items": [], "data": [{"asin": "d"}]}'),
        (5, "product_link", None, '{"search_results": "", "data": "{\\"asin\\": \\"e\\"}"}'),
        (6, "product_link", "bad", '{"search_results": [{"asin": "f"}, {"title": "no id"}]}'),
        (7, "cart_side_bar", None, "not json"),
    ]
    df = spark.createDataFrame(rows, "id int, click_type string, products string, page_meta string")
    out = N.with_products(df, "listed").select("id", F.explode("listed").alias("p")).select("id", *N.product_fields(F.col("p")))
    got = [tuple(r) for r in out.orderBy("id", "title").collect()]
    assert got == [
        (1, None, "Unknown Title", "3", None),
        (1, "0000000000", "t", "Unknown Price", '[{"c":"red"}]'),
        (3, "c", "Unknown Title", "Unknown Price", None),
        (5, "e", "Unknown Title", "Unknown Price", None),
        (6, "f", "Unknown Title", "Unknown Price", None),
    ]


def test_product_details_later_key_wins(spark):
    metas = ['{"product_details": [{"asin": "a", "title": "x"}, 3, {"asin": "b"}]}', '{"product_details": {"asin": "c"}}', "{}"]
    got = column(spark, metas, N.product_details)
    assert got == [{"title": "x", "asin": "b"}, {"asin": "c"}, {}]


def test_survey_text(spark):
    survey = '{"Self Description": "calm", "Personality": {"Traits": {"Open": "5"}, "Note": null}}'
    got = column(spark, [survey, "free text", None], lambda c: N.survey_text(N.survey_fields(c)))
    assert got[0] == (
        "### Survey Information\n\n**Self Description:**\n- calm\n\n**Personality:**\n- Traits:\n  - Open: 5\n- Note: None"
    )
    assert got[1] == "### Survey Information\n\n**Survey Data:**\nfree text"
    assert got[2] == ""


def test_page_text(spark):
    html = (
        "<html><head><title>T</title><style>p{}</style></head><body class='a>b'>\n<!-- c --><script>var a = '<p>';</script>"
        "<p>One &amp;lt; <b>two</b></p><div>caf&eacute; &#8364;&#x1F600;&nbsp;x</div>  <br>\n<p> </p></body></html>"
    )
    assert column(spark, [html], W.page_text) == ["One &lt; two\ncafé €\U0001f600 x"]


def test_meta_tags(spark):
    html = '<meta charset="utf-8"><META property="og:a" content="1 > 0"/><meta name=b content=\'x\'><meta name="b" content=""><meta name="c">'
    assert column(spark, [html], W.meta_tags) == [{"og:a": "1 > 0", "b": ""}]


def test_linked_data(spark):
    one = '<script type="application/ld+json"> {"a": 1} </script>'
    got = column(spark, [one, one + one, "<p>", one.replace("1}", "}")], W.linked_data)
    assert [[(b.block, b.parsed) for b in x] for x in got] == [
        [('{"a": 1}', True)], [('{"a": 1}', False)] * 2, [], [('{"a": }', False)],
    ]


def test_url_rules(spark):
    rules = W.url_rules({"shop.com": "allowed", "http://shop.com/x": "blocked", "com": "blocked"}, ["bad"])
    urls = ["http://shop.com/x", "http://shop.com/x/y", "http://other.com", "http://bad", "http://org"]
    assert column(spark, urls, lambda c: W.url_allowed(c, rules)) == [False, True, False, False, True]
    assert column(spark, urls[:1], lambda c: W.url_allowed(c, W.url_rules({}))) == [True]
