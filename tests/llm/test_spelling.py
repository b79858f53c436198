import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from histloom.llm import spelling


def near_of(words):
    letters = sorted({c for w in words for c in w})
    out = {}
    for w in words:
        near = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in [*letters, ""]}
        out[w] = {x for x in near if x in words and x != w}
    return out


def plain(words):
    near, form = near_of(words), {}
    for w, found in near.items():
        best = min(((-words[x], x) for x in found), default=None)
        form[w] = best[1] if best and -best[0] >= spelling.FORM_TIMES * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def vocabulary(letters, size, seed):
    rng, words = random.Random(seed), {}
    while len(words) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.choice([7, 7, 8, 9, 10, 14, 25])))
        for _ in range(5):
            if len(w) >= spelling.MIN_CHARS:
                words[w] = rng.choice([2, 3, 30, 400, 5000])
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", rng.choice(letters), rng.choice(letters) + w[i]]) + w[i + 1 :]
    return words


@pytest.mark.parametrize("letters", ["ab", "abcdefé"])
@pytest.mark.parametrize("limit, block", [(None, 2_048), (1, 64), (30, 16)])
def test_variants(spark, letters, limit, block):
    words = vocabulary(letters, 700, len(letters))
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert {tuple(r) for r in spelling.variants(table, limit, block).collect()} == plain(words)


def counts(rows):
    out = Counter()
    upper = {i: i + 32 for i in range(65, 91)}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def test_texts(spark):
    rng = random.Random(3)
    stems = ["gardening", "GardenING", "gardenings", "Übermäßig", "übermäßig", "naïvetés", "mountains", "a" * 300, "ab" * 500 + "c"]
    rows = [(i, rng.choice([" ", "-", "9", "Ā", "é "]).join(rng.choices(stems, k=40))) for i in range(300)]
    rows += [(None, "gardening gardening"), (5, None), (6, ""), (7, "9 - _"), (1, rows[1][1]), (1, rows[1][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as word", "2 as key")
    got = {tuple(r) for r in spelling.spelling_variants(table.repartition(4)).collect()}
    assert got == plain(counts(rows)) and len(got) > 30


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(empty).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("longest", [spelling.SHORT, spelling.LONGEST])
def test_an_edit_takes_no_more_grams_than_the_bound(longest):
    """For random dictionaries: a near word keeps all grams but as many as the bound says, and
    the short dictionary leaves every word at least one."""
    rng = random.Random(longest)
    for trial in range(40):
        letters = "abc"[: rng.choice([1, 2, 3])]
        words = vocabulary(letters + "d", 40, trial)
        texts = sorted(words)
        codes, lengths = spelling._codes(texts)
        grams = np.unique(np.concatenate([g.ravel() for g in spelling._grams(codes, longest)[1:-1]]))
        some = np.sort(np.array(rng.sample(grams.tolist(), rng.randrange(len(grams))), dtype=np.uint64))
        book = spelling.GramDictionary(some, np.zeros(spelling.BUCKETS, dtype=np.int64))
        starts, name, size = book.cut(codes, lengths, longest)
        word, place = np.nonzero(starts)
        w, g, total, bound = spelling.affected(word, name[word, place], place, size[word, place], lengths, longest)
        sets = [set(g[w == k].tolist()) for k in range(len(texts))]
        assert [len(s) for s in sets] == total.tolist()
        if longest == spelling.SHORT:
            assert (total - bound >= 1).all()
        at = {t: k for k, t in enumerate(texts)}
        for a, near in near_of(words).items():
            for b in near:
                assert len(sets[at[a]] - sets[at[b]]) <= bound[at[a]]
