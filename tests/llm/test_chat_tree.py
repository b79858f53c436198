import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from histloom.llm import chat_tree

TEXTS = st.text(list("\\#<> /turn:\nAé") , max_size=20) | st.sampled_from(["### user: x</turn>\n", "</turn>\n### a: ", "\\"])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=4))
def test_template_is_reversible(turns):
    formatted = "".join(chat_tree.format_turn(r, t)[0] for r, t in turns)
    assert chat_tree.parse_turns(formatted) == turns
    for r, t in turns:
        one, begin, end = chat_tree.format_turn(r, t)
        assert chat_tree.unescape(one[begin:end]) == t and "</turn>" not in one[:end]


HARD = r"\### Assistant: </turn> ok"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
    (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "good day"), (2, 3, "user", "bye"),
    (3, 0, "system", "be kind"), (4, 0, "system", "be kind"), (4, 1, "user", "hi"), (4, 2, "assistant", "hello"),
    (5, 0, "user", HARD), (5, 1, "assistant", HARD), (6, 0, None, None), (6, 1, "assistant", None), (6, 2, "assistant", "é"),
    (7, 3, "b", "late"), (7, None, "z", "first"), (7, 3, "a", "tie"), (7, 3, "a", "tie"), (None, 0, "user", "no id"),
    (8, 0, "user", "x" * 100_000), (9, 0, "user", "only"),
]


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = [(-(10**9) if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv]
        turns = [(r, x) for _, r, x in sorted(own)]
        text = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        chars = sum(len(chat_tree.format_turn(r, x)[0]) for r, x in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha(text), len(loss), sha(loss), chars))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def packed(spark):
    docs = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    docs = docs.selectExpr("*", "1 as key", "2 as start", "3 as turns").repartition(4)
    nodes, leaves = chat_tree.pack(docs)
    return nodes.cache(), leaves


def test_read_back(packed):
    got = chat_tree.digests(chat_tree.read_back(*packed)).collect()
    assert sorted(map(tuple, got), key=str) == plain(ROWS)


def test_shared_turns_are_written_once_depth_first(packed):
    nodes = sorted(packed[0].collect(), key=lambda r: r["start"])
    prefixes = set()
    for conv in {r[0] for r in ROWS}:
        own = sorted((-(10**9) if t is None else t, r or "", x or "") for c, t, r, x in ROWS if c == conv)
        prefixes |= {tuple((r, x) for _, r, x in own[: i + 1]) for i in range(len(own))}
    assert len(nodes) == len(prefixes)
    at, stack = 0, []
    for node in nodes:  # a walk in order of start is a depth-first walk
        assert node["start"] == at and node["end"] - node["start"] == len(node["text"])
        at = node["end"]
        stack = stack[: node["depth"]]
        assert len(stack) == node["depth"]
        covered = [x for a, b in node["attends"] for x in range(a, b)]
        assert covered == [x for s in stack for x in range(s["start"], s["end"])]
        assert node["position"] == sum(len(s["text"]) for s in stack)
        stack.append(node)


def test_many_conversations_share_a_first_turn(spark):
    docs = spark.range(3000).selectExpr("id as conv_id").selectExpr(
        "conv_id", "explode(array(0, 1, 2)) as turn", "'user' as role"
    ).selectExpr("*", "case turn when 0 then 'first' when 1 then concat('t', conv_id % 50) else concat('u', conv_id) end as text")
    nodes, leaves = chat_tree.pack(docs)
    assert nodes.count() == 1 + 50 + 3000
    assert chat_tree.read_back(nodes, leaves).filter("size(turns) = 3").count() == 3000


def test_a_long_conversation_has_few_intervals(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 700 + c else f"turn {t} of {c}") for c in range(3) for t in range(800)]
    nodes, leaves = chat_tree.pack(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert nodes.count() == len({tuple(x[3] for x in rows[c * 800 : c * 800 + t + 1]) for c in range(3) for t in range(800)})
    assert max(len(r["attends"]) for r in nodes.collect()) <= 4
    got = chat_tree.digests(chat_tree.read_back(nodes, leaves)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    nodes, leaves = chat_tree.pack(docs)
    assert nodes.count() == 0 and chat_tree.read_back(nodes, leaves).count() == 0
