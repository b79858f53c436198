import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from histloom.llm import repeated_passages
from histloom.llm.fm_index import FMIndex

WIDTH = repeated_passages.WIDTH
SCHEMA = "doc_id long, text string"


def plain(rows):
    """The contract in plain Python: every window in a dictionary."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - WIDTH + 1):
            key = tuple(w[k : k + WIDTH])
            first.setdefault(key, set()).add(i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - WIDTH + 1):
            ids = {x for x in first[tuple(w[k : k + WIDTH])] if x is not None}
            if ids and (i is None or min(ids) < i):
                gone |= set(range(k, k + WIDTH))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as _at", "'x' as n_words", "2 as sha").repartition(3)
    got = repeated_passages.without_passages(table, **options)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def corpus(seed, docs=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "Ünïcode", "a", "A"]
    passages = [rng.choices(vocabulary, k=rng.choice([49, 50, 51, 60, 140])) for _ in range(8)]
    rows = []
    for i in rng.sample(range(10 * docs), docs):
        words = rng.choices(vocabulary, k=rng.choice([0, 3, 30, 49, 50, 51, 120, 300]))
        for _ in range(rng.choice([0, 1, 2, 4])):
            at = rng.randrange(len(words) + 1)
            passage = list(rng.choice(passages))
            if rng.random() < 0.4:
                passage[rng.randrange(len(passage))] = "changed"
            words[at:at] = passage
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(words)))
    return rows + [(i + 1, t) for i, t in rng.sample(rows, 10)]


@pytest.mark.parametrize("hot, shard_words", [(2_000, 400_000), (3, 2_000), (0, 500)])
def test_random_corpus(spark, hot, shard_words):
    rows = corpus(hot)
    assert run(spark, rows, hot=hot, shard_words=shard_words) == plain(rows)


def test_edge_rows(spark):
    long = " ".join(f"x{k}" for k in range(60))
    same = " ".join(["again"] * 400)
    rows = [
        (5, long), (3, long + " end"), (None, long), (None, "start " + long), (7, None), (8, ""), (9, " \n\t"),
        (5, "before " + long), (5, long), (11, same), (12, same + " tail"), (13, same), (2, "é" * 30_000),
        (14, long.replace("x59", "X59")), (15, " ".join(long.split())),
    ]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, hot=0, shard_words=300) == plain(rows)


def test_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeated_passages, "WORDS_AT_ONCE", 64)
    words = [f"v{k % 700}-{k // 900}" for k in range(1_500)]
    texts = [" ".join(words), " ".join(words[200:420]), "x " + " ".join(words[900:])]
    for text in texts:


        row, hashes = repeated_passages._words(pa.array([text]))
        starts = [int(s) for _, at, start, n, _ in repeated_passages.pieces_of(hashes, row) for b, c in zip(start, n) for s in range(b + at, b + at + c)]
        assert starts == list(range(len(text.split()) - WIDTH + 1))
    rows = list(enumerate(texts, 4))
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_words_joined():
    data = np.frombuffer("\t a  bß\ncd \x0b".encode(), np.uint8)
    assert repeated_passages.joined(data) == "a bß cd".encode()
    assert repeated_passages.joined(data, np.array([True, False, True])) == b"a cd"
    assert repeated_passages.joined(data, np.array([False] * 3)) == b""
    assert repeated_passages.joined(np.zeros(0, np.uint8)) == b""


@pytest.mark.parametrize("seed", range(12))
def test_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    letters, width = int(rng.integers(1, 6)), int(rng.integers(1, 9))
    pieces = [rng.integers(0, letters, rng.integers(1, 30)).astype(np.uint64) for _ in range(rng.integers(1, 20))]
    streamed = [rng.integers(0, letters + 1, rng.integers(1, 30)).astype(np.uint64) for _ in range(10)]
    index = FMIndex(np.concatenate(pieces), np.array([len(p) for p in pieces]), width)
    found, row = index.matching_statistics(np.concatenate(streamed), np.array([len(s) for s in streamed]))
    value = rng.integers(0, 100, len(pieces))
    least = index.least_by_block(value)
    holders = {}
    for p, v in zip(pieces, value):
        for i in range(len(p)):
            for n in range(1, min(width, len(p) - i) + 1):
                key = tuple(p[i : i + n])
                holders[key] = min(holders.get(key, 1_000), v)
    k = 0
    for s in streamed:
        for i in range(len(s)):
            n = 0
            while n < width and i + n < len(s) and tuple(s[i : i + n + 1]) in holders:
                n += 1
            assert found[k] == n
            if n == width:
                assert least[index.block[row[k]]] == holders[tuple(s[i : i + n])]
            k += 1
