"""Spelling variants grouped with a variable-length gram index.

Words come from all texts with their counts. A dictionary of grams is pruned by frequency: a gram
that more than `limit` words hold is extended by a code point, up to LONGEST; rarer ones stay
short. Every word is cut into the longest dictionary gram at each place, without grams that lie
inside another one. One edit changes only grams whose choice depends on the edited place, so each
word has a bound on how many of its grams an edit can take away (its affected-gram bound); two
words that are one edit apart share all other grams, at the same place or one place further.

Of every word, only the rarest (bound + 1) grams enter the index, by gram, place and length: two
near words must meet there. Words that meet are merged by their gram signatures - neither may
miss more of the other's grams than its bound - and then compared. A word whose bound takes in
all of its grams (short words of long grams) enters all of them, and once more by a second
dictionary that stops at SHORT code points, where at least one gram always survives for words of
MIN_CHARS and more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histloom.llm.hashing import mix
from histloom.llm.memory import give_back
from histloom.operators.skew import hot_keys, lookup_join
from histloom.session import written

#: Runs of letters, as bytes of UTF-8: A-Z are in lower case already, U+00C0 to U+00FF follow.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
ONE_IN = 31
MIN_CHARS = 7
MIN_COUNT = 2
FORM_TIMES = 10
SHORTEST, SHORT, LONGEST = 2, 3, 4
#: A gram in more words than this is extended; the limit grows with the vocabulary, so that no
#: more than about words / limit x word length grams are ever extended.
LEAST_LIMIT, EXTENDED = 1_000, 8_192
#: Counts of grams by hash, by which grams are ordered.
BUCKETS = 1 << 16
#: Words of a key that are compared in one task; larger lists are compared block against block.
BLOCK = 2_048
#: Words that a task holds in its counter, and cells of the matrices that it works on.
HELD_WORDS = 200_000
CELLS = 1 << 20
PAIRS = 1 << 17
EQUAL, SHORTER, LONGER = 0, 1, 2


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word and n: the runs of letters of all texts, A-Z in lower case, one in ONE_IN of them
    (by document and run) without one code point. A null id counts as an empty one."""
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_id"),
        F.col(f"`{text_col}`").cast("string").alias("_text"),
    ).filter(F.col("_text").isNotNull())

    def flush(counts: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode() for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        crc = zlib.crc32
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for name, text in zip(batch.column(0).cast(pa.binary()), texts):
                seed = crc(name.as_py() + b":")
                own = Counter(RUN.findall(text.as_py().lower()))
                for word in [w for w in own if not crc(w, seed) % ONE_IN]:
                    n, letters = own.pop(word), word.decode()
                    at = crc(word, seed) % len(letters)
                    # the shortened run may be a run of this text as well
                    counts[(letters[:at] + letters[at + 1 :]).encode()] += n
                counts.update(own)
                if len(counts) > HELD_WORDS:
                    yield flush(counts)
                    counts.clear()
        yield flush(counts)
        give_back()

    found = rows.mapInArrow(run, "word string, n long").filter(F.length("word") >= MIN_CHARS)
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, one row each with zeros behind, and their lengths."""
    table = np.array(words, dtype=np.str_)
    return table.view(np.uint32).reshape(len(words), -1), np.array([len(w) for w in words], dtype=np.int64)


def _parts(words: list[str]) -> Iterator[np.ndarray]:
    """Places of the words, in parts whose code points fit a matrix of CELLS cells."""
    order = np.argsort([len(w) for w in words], kind="stable")
    at = 0
    while at < len(order):
        end = min(len(order), at + 8192)
        while end > at + 1 and (end - at) * len(words[order[end - 1]]) > CELLS:
            end = at + (end - at) // 2
        yield order[at:end]
        at = end


def _grams(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the grams of 1 to `longest` code points at every place; those of different
    lengths never agree but by accident."""
    width = codes.shape[1]
    padded = np.pad(codes, ((0, 0), (0, longest))).astype(np.uint64)
    out = [mix(padded[:, :width] + np.uint64(1))]
    for size in range(2, longest + 1):
        out.append(mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + padded[:, size - 1 : size - 1 + width] + np.uint64(size)))
    return out


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (mix(grams + np.uint64(77)) >> np.uint64(48)).astype(np.int64)


@dataclass(frozen=True)
class GramDictionary:
    """The grams that are extended (sorted hashes), and gram counts by bucket for their order."""

    extended: np.ndarray
    counts: np.ndarray

    def _frequent(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.extended):
            return np.zeros(grams.shape, dtype=bool)
        at = np.searchsorted(self.extended, grams)
        return self.extended[np.minimum(at, len(self.extended) - 1)] == grams

    def cut(self, codes: np.ndarray, lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every word and place: whether a gram of the word starts there, its hash and its
        size. The longest gram of the dictionary counts, unless it lies inside another one."""
        grams = _grams(codes, longest)
        place = np.arange(codes.shape[1])
        room = lengths[:, None] - place
        size = np.full(codes.shape, SHORTEST)
        name = grams[SHORTEST - 1].copy()
        growing = room >= SHORTEST
        for more in range(SHORTEST + 1, longest + 1):
            growing = growing & (room >= more) & self._frequent(grams[more - 2])
            size[growing] = more
            name[growing] = grams[more - 1][growing]
        starts = room >= SHORTEST
        ends = np.where(starts, place + size, 0)
        before = np.maximum.accumulate(ends, axis=1)
        starts[:, 1:] &= before[:, :-1] < ends[:, 1:]
        return starts, name, size


def affected(
    word: np.ndarray, gram: np.ndarray, place: np.ndarray, size: np.ndarray, lengths: np.ndarray, longest: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams (word, gram) of a cut and, by word, how many there are and the bound
    on how many of them one edit can take away.

    Whether a gram is chosen depends on the code points from `place - (longest - size)` to
    `place + longest - 1`: those behind may extend it, and a gram that starts before may cover
    it. An edit takes a gram of the set away only if it touches that range of each of its
    places; the bound is the largest number of grams that one place can touch."""
    order = np.lexsort((gram, word))
    w, g = word[order], gram[order]
    first = np.ones(len(w), dtype=bool)
    first[1:] = (w[1:] != w[:-1]) | (g[1:] != g[:-1])
    head = np.flatnonzero(first)
    low = np.maximum.reduceat((place - (longest - size))[order], head) if len(head) else np.zeros(0, int)
    high = np.minimum.reduceat((place + longest - 1)[order], head) if len(head) else np.zeros(0, int)
    w, g = w[head], g[head]
    width = int(lengths.max(initial=0)) + 1
    low, high = np.maximum(low, 0), np.minimum(high, lengths[w])
    some = low <= high
    steps = np.zeros((len(lengths), width + 1), dtype=np.int32)
    np.add.at(steps, (w[some], low[some]), 1)
    np.add.at(steps, (w[some], high[some] + 1), -1)
    return w, g, np.bincount(w, minlength=len(lengths)), np.cumsum(steps, axis=1).max(axis=1, initial=0)


def signatures(word: np.ndarray, gram: np.ndarray, words: int) -> np.ndarray:
    """64 bits by word, one per gram: a bit that another word lacks is a gram that it lacks."""
    out = np.zeros(words, dtype=np.uint64)
    np.bitwise_or.at(out, word, np.uint64(1) << (mix(gram) >> np.uint64(58)))
    return out


def _key(gram: np.ndarray, place: np.ndarray, shorter: np.ndarray, kind: int) -> np.ndarray:
    tail = (shorter.astype(np.uint64) << np.uint64(34)) + (place.astype(np.uint64) << np.uint64(2)) + np.uint64(kind)
    return mix(gram * np.uint64(0x9E3779B97F4A7C15) + tail).view(np.int64)


def _system(
    book: GramDictionary, codes: np.ndarray, lengths: np.ndarray, longest: int, only: np.ndarray, number: int
) -> tuple[list[tuple], np.ndarray]:
    """Index entries (key, role, word, signature, bound) of the words marked in `only`, by the
    dictionary up to `longest`; and which words keep no gram for sure."""
    starts, name, size = book.cut(codes, lengths, longest)
    word, place = np.nonzero(starts & only[:, None])
    gram, size = name[word, place], size[word, place]
    w, g, total, bound = affected(word, gram, place, size, lengths, longest)
    weak = (total - bound < 1) & only
    sign = signatures(w, g, len(lengths))
    # the (bound + 1) rarest grams of every word; all of a weak one's
    order = np.lexsort((g, book.counts[_bucket(g)], w))
    rank = np.arange(len(w)) - np.searchsorted(w[order], w[order])
    chosen = order[rank <= bound[w[order]]]
    picked = np.zeros(len(w), dtype=bool)
    picked[chosen] = True
    # every place at which a chosen gram stands
    slot = np.lexsort((gram, word))
    same = np.zeros(len(slot), dtype=np.int64)
    if len(slot):
        same[1:] = np.cumsum((word[slot][1:] != word[slot][:-1]) | (gram[slot][1:] != gram[slot][:-1]))
    kept = slot[picked[same]]
    word, gram, place = word[kept], gram[kept] + np.uint64(number), place[kept]
    length = lengths[word]
    entries = [
        (_key(gram, place, length, EQUAL), EQUAL), (_key(gram, place, length, 1), SHORTER),
        (_key(gram, place + 1, length, 1), SHORTER), (_key(gram, place, length - 1, 1), LONGER),
    ]
    return [(key, role, word, sign[word], bound[word]) for key, role in entries], weak


_ENTRY = "key long, role byte, bound int, sign long, word string"


def index_entries(words: DataFrame, book: GramDictionary) -> DataFrame:
    """The index: key (gram, place and length), role, bound, sign and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in _parts(texts):
                some = [texts[i] for i in part]
                codes, lengths = _codes(some)
                own = pa.array(some, pa.string())
                entries, weak = _system(book, codes, lengths, LONGEST, np.ones(len(some), dtype=bool), 1)
                if weak.any():
                    entries += _system(book, codes, lengths, SHORT, weak, 2)[0]
                for key, role, word, sign, bound in entries:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key), pa.array(np.full(len(key), role, np.int8)), pa.array(bound.astype(np.int32)),
                            pa.array(sign.view(np.int64)), own.take(pa.array(word)),
                        ],
                        names=["key", "role", "bound", "sign", "word"],
                    )
        give_back()

    return words.select("word").mapInArrow(run, _ENTRY)


def gram_dictionary(words: DataFrame, limit: int | None = None) -> GramDictionary:
    """Counts grams over all words. What comes to the driver is bounded: BUCKETS counts, and at
    most word length x LONGEST x EXTENDED grams that are frequent enough to be extended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in _parts(texts):
                codes, lengths = _codes([texts[i] for i in part])
                grams = _grams(codes, LONGEST)
                room = lengths[:, None] - np.arange(codes.shape[1])
                for size in range(SHORTEST, LONGEST + 1):
                    row, at = np.nonzero(room >= size)
                    found = grams[size - 1][row, at]
                    buckets += np.bincount(_bucket(found), minlength=BUCKETS)
                    if size < LONGEST:
                        order = np.lexsort((found, row))  # once per word
                        new = np.ones(len(order), dtype=bool)
                        new[1:] = (row[order][1:] != row[order][:-1]) | (found[order][1:] != found[order][:-1])
                        names, n = np.unique(found[order][new], return_counts=True)
                        yield _counts(np.zeros(len(names), np.int8), names.view(np.int64), n)
        used = np.flatnonzero(buckets)
        yield _counts(np.ones(len(used), np.int8), used, buckets[used])
        give_back()

    if limit is None:
        limit = max(LEAST_LIMIT, words.count() // EXTENDED)
    counts = written(
        words.select("word").mapInArrow(run, "kind byte, gram long, n long").groupBy("kind", "gram")
        .agg(F.sum("n").alias("n")).filter((F.col("kind") == 1) | (F.col("n") > limit)),
        "grams",
    )
    table = counts.toArrow()
    kind, gram, n = (table.column(c).to_numpy() for c in ("kind", "gram", "n"))
    order = np.zeros(BUCKETS, dtype=np.int64)
    order[gram[kind == 1]] = n[kind == 1]
    return GramDictionary(np.sort(gram[kind == 0].astype(np.int64).view(np.uint64)), order)


def _counts(kind: np.ndarray, gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["kind", "gram", "n"])


def one_edit(a: np.ndarray, b: np.ndarray, shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether rows of code points are exactly one insertion, deletion or replacement apart;
    rows of `a` are as long as those of `b` or one code point shorter."""
    differ = a != b
    same = shorter == longer
    out = same & (differ.sum(axis=1) == 1)
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    moved = a[:, :-1] != b[:, 1:]
    last = np.where(moved.any(axis=1), moved.shape[1] - 1 - moved[:, ::-1].argmax(axis=1), -1)
    return out | (~same & (last < first))


def _group_pairs(bounds: np.ndarray, role: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs to look at in runs of equal keys (the run r is bounds[r] up to
    bounds[r + 1]), in portions: equal lengths all with all, else shorter with longer ones. In a
    pair of different blocks, only across."""
    left, right, held = [], [], 0
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = end - start
        if n < 2:
            continue
        if role[start] == EQUAL:
            if block[start] != block[end - 1]:
                cut = start + int(np.searchsorted(block[start:end], block[end - 1]))
                x, y = np.meshgrid(np.arange(start, cut), np.arange(cut, end), indexing="ij")
                x, y = x.ravel(), y.ravel()
            else:
                x, y = np.triu_indices(n, 1)
                x, y = x + start, y + start
        else:
            few, many = np.flatnonzero(role[start:end] == SHORTER) + start, np.flatnonzero(role[start:end] == LONGER) + start
            if not len(few) or not len(many):
                continue
            x, y = np.meshgrid(few, many, indexing="ij")
            x, y = x.ravel(), y.ravel()
            if block[start] != block[end - 1]:
                across = block[x] != block[y]
                x, y = x[across], y[across]
        left.append(x)
        right.append(y)
        held += len(x)
        if held >= PAIRS:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _near_in(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The near words among the entries of whole groups (key, i, j), sorted by them and block."""
    key, i, j = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
    new = np.ones(len(key) + 1, dtype=bool)
    new[1:-1] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    role, block, bound = (rows.column(c).to_numpy() for c in ("role", "block", "bound"))
    sign = rows.column("sign").to_numpy().view(np.uint64)
    words = rows.column("word").to_pylist()
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    short = lengths <= 64
    codes, _ = _codes([w if s else "" for w, s in zip(words, short)])
    for x, y in _group_pairs(np.flatnonzero(new), role, block):
        # merge: neither word may lack more grams of the other than an edit can take from it
        gone = np.bitwise_count(sign[x] & ~sign[y]) <= bound[x]
        gone &= np.bitwise_count(sign[y] & ~sign[x]) <= bound[y]
        gone &= lengths[y] - lengths[x] == (role[x] != EQUAL)
        x, y = x[gone], y[gone]
        near = one_edit(codes[x], codes[y], lengths[x], lengths[y])
        for k in np.flatnonzero(~(short[x] & short[y])):
            a, b = words[x[k]], words[y[k]]
            p = next((q for q, (c, d) in enumerate(zip(a, b)) if c != d), len(a))
            near[k] = a != b and a[p + (len(a) == len(b)) :] == b[p + 1 :]
        x, y = x[near], y[near]
        a = pa.array([words[k] for k in x], pa.string())
        yield pa.RecordBatch.from_arrays([a, pa.array([words[k] for k in y], pa.string())], names=["a", "b"])


def near_pairs(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: the pairs of words at one edit, once each, that meet under a key of the index.

    Lists of more than `block` words are cut into blocks that are compared with each other in as
    many groups, so a frequent gram neither fills a task nor loses a pair."""
    hot = written(hot_keys(entries, ["key"], block), "long-lists")
    if hot.isEmpty():
        placed = entries.select("*", *[F.lit(0).alias(c) for c in ("block", "i", "j")])
    else:
        mine = F.pmod(F.xxhash64("word"), F.coalesce("salts", F.lit(1))).cast("int")
        others = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
        placed = entries.join(hot, "key", "left").select(*entries.columns, mine.alias("block"), F.explode(others).alias("_other"))
        placed = placed.select("*", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"))
        placed = placed.drop("_other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 4096:
                continue
            key, i, j = (held.column(c).to_numpy() for c in ("key", "i", "j"))
            open_ = (key == key[-1]) & (i == i[-1]) & (j == j[-1])
            cut = int(open_.argmax())  # the last group may go on in the next batch
            yield from _near_in(held.slice(0, cut))
            held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from _near_in(held)
        give_back()

    sorted_ = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block")
    found = sorted_.mapInArrow(run, "a string, b string")
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    return found.select(*ends).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root for every (word, form) with a form: the end of the chain of forms.

    Chains are halved in each round; counts grow by FORM_TIMES along a chain, so there are no
    circles and few rounds. A form that many words share is spread over salts."""
    at = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = lookup_join(at, onward, ["root"], "left", spread_by=["word"])
        moved = written(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("more")), "roots")
        at = moved.select("word", "root")
        if moved.filter("more").isEmpty():
            return at


def variants(words: DataFrame, limit: int | None = None, block: int = BLOCK) -> DataFrame:
    """word, n, form, root, n_near and form_n for a table of distinct words with counts.

    All words must have MIN_CHARS code points or more. `limit` and `block` change the work, not
    the result."""
    words = written(words.select("word", "n"), "words")
    entries = index_entries(words, gram_dictionary(words, limit))
    pairs = written(near_pairs(entries, block), "near-words")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))
    near = both.join(counts, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(best).alias("best"))
    good = -F.col("best.m") >= FORM_TIMES * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.w")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n"),
    )
    rows = written(rows, "variants")
    ends = roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of all texts: word, form, root, n, n_near and form_n.

    Null and empty texts hold no words; a null id counts as an empty one. Rows that repeat an id
    count like others. Words of any length are compared whole. Ties of a form go to the smallest
    word in code-point order. Other columns are not read; an empty table gives no rows."""
    return variants(word_counts(docs, id_col, text_col))
