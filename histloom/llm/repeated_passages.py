"""Passages that stand in an earlier document, found by a compressed FM-index per shard.

A window is WIDTH consecutive words. Every window has an anchor, the least hash among its runs of
GRAM words, so equal windows have equal anchors. Consecutive windows with one anchor form a
piece; pieces whose anchor stands in one document only cannot repeat and go no further. The
others are sharded by anchor: each shard builds an FM-index of its distinct pieces (suffix order,
wavelet matrix) and streams the pieces backwards through it, which gives the matching statistics
of every place; where they reach WIDTH words, the rows that share the window name the smallest
document that holds it. Intervals above the threshold are cut from the documents.

Copies of a whole document need no index: of equal documents, all but the smallest id lose every
word. An anchor with more than `hot` pieces would fill its shard; its windows go one by one,
counted by their hashes first, and only the first holder of a repeated window sends its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.llm import hashing
from histloom.llm.fm_index import FMIndex
from histloom.llm.memory import give_back
from histloom.operators.skew import lookup_join
from histloom.session import written

WIDTH = 50
GRAM = 12
#: Pieces of one anchor that go to one shard together.
HOT_PIECES = 2_000
#: Words of one shard's index, about.
SHARD_WORDS = 400_000
#: Bytes of text that are worked on at once, and words whose windows are.
BYTES_AT_ONCE = 1 << 21
WORDS_AT_ONCE = 1 << 20
STREAMED = 4_096
#: Stands for the id of documents without one, which are later than all others.
NO_ID = (1 << 63) - 1

_BASES = (hashing.BASE, np.uint64(0xD6E8FEB86659FD93))


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class _Runs:
    """Hashes of any run of words, from running sums of hash times powers of a base."""

    def __init__(self, words: np.ndarray) -> None:
        self.sums, self.down = [], []
        for base in _BASES:
            up, down = (hashing._powers(b, len(words) + 1) for b in (base, _inverse(base)))
            sums = np.zeros(len(words) + 1, dtype=np.uint64)
            np.cumsum(hashing.mix(words + base) * up[:-1], out=sums[1:])
            self.sums.append(sums)
            self.down.append(down)

    def short(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return hashing.mix((self.sums[0][start + length] - self.sums[0][start]) * self.down[0][start])

    def long(self, start: np.ndarray, length: np.ndarray | int) -> list[bytes]:
        """16 bytes for each run."""
        two = [
            hashing.mix((s[start + length] - s[start]) * d[start] + np.uint64(1) * np.asarray(length, dtype=np.uint64))
            for s, d in zip(self.sums, self.down)
        ]
        data = np.stack(two, axis=1).tobytes()
        return [data[16 * k : 16 * k + 16] for k in range(len(start))]


def _anchors(grams: np.ndarray, count: int) -> np.ndarray:
    """For each of `count` windows, the place of the least of its WIDTH - GRAM + 1 grams; of equal
    ones the first."""
    reach = WIDTH - GRAM + 1
    value, place, size = grams, np.arange(len(grams)), 1
    while 2 * size <= reach:
        later = value[size:] < value[:-size]
        place = np.where(later, place[size:], place[:-size])
        value = np.minimum(value[size:], value[:-size])
        size *= 2
    shift = reach - size
    later = value[shift:] < value[: len(value) - shift]
    return np.where(later, place[shift:], place[: len(place) - shift])[:count]


def pieces_of(words: np.ndarray, row: np.ndarray) -> Iterator[tuple[_Runs, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The pieces of texts given as word hashes and row numbers, in blocks: the block's run
    hashes and first word, and by piece its start in the block, number of windows and anchor."""
    for at in range(0, max(0, len(words) - WIDTH + 1), WORDS_AT_ONCE):
        own = words[at : at + WORDS_AT_ONCE + WIDTH - 1]
        rows = row[at : at + len(own)]
        runs, count = _Runs(own), len(own) - WIDTH + 1
        grams = runs.short(np.arange(len(own) - GRAM + 1), GRAM)
        anchor = _anchors(grams, count)
        whole = rows[:count] == rows[WIDTH - 1 :]
        first = whole.copy()
        first[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1]) | (rows[1:count] != rows[: count - 1])
        start = np.flatnonzero(first)
        piece = np.cumsum(first) - 1
        windows = np.bincount(piece[whole], minlength=len(start)) if len(start) else np.zeros(0, int)
        yield runs, at, start, windows, grams[anchor[start]].view(np.int64)


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about BYTES_AT_ONCE bytes of text, one text at least."""
    texts = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of every word, unchanged."""
    return hashing.words(texts, hashing.SOLID, hashing.UNCHANGED)


def _bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of one text, in bytes."""
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = hashing.SOLID[data]
    turn = np.diff(solid)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def joined(data: np.ndarray, keep: np.ndarray | None = None) -> bytes:
    """The words of a text (UTF-8 bytes), or those marked in `keep`, with one space between."""
    start, end = _bounds(data)
    if keep is not None:
        start, end = start[keep], end[keep]
    mark = np.zeros(len(data) + 2, dtype=np.int8)
    mark[start] += 1
    mark[end + 1] -= 1
    spaced = np.append(np.where(hashing.SOLID[data], data, np.uint8(0x20)), np.uint8(0x20))
    return spaced[np.cumsum(mark[:-1], dtype=np.int8) > 0].tobytes()[:-1]


def _bytes_of(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_at (the id, NO_ID for null), _h (a hash of the raw text, which together name a row) and
    _text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_at"), text.alias("_text")
    ).select("_at", F.xxhash64("_text").alias("_h"), "_text")


def summaries(source: DataFrame) -> DataFrame:
    """_at, _h, n_words, sha (of the words joined by spaces) and anchors (one per piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 2):
                texts = part.column(2).cast(pa.large_binary())
                row, found = _words(part.column(2))
                counts = np.bincount(row, minlength=len(texts))
                before = np.concatenate([[0], np.cumsum(counts)])
                owner, anchors = [np.zeros(0, int)], [np.zeros(0, np.int64)]
                for _, at, start, _, anchor in pieces_of(found, row):
                    owner.append(row[start + at])
                    anchors.append(anchor)
                ends = np.searchsorted(np.concatenate(owner), np.arange(len(texts) + 1)).astype(np.int32)
                sha = [hashlib.sha256(joined(_bytes_of(t))).digest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(np.diff(before), pa.int64()), pa.array(sha, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(anchors))),
                    ],
                    names=["_at", "_h", "n_words", "sha", "anchors"],
                )
        give_back()

    return source.mapInArrow(run, "_at long, _h long, n_words long, sha binary, anchors array<long>")


def _listed(part: pa.RecordBatch, column: int, row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether values[k] is in the list of the part's row row[k]; lists hold whole numbers."""
    lists = part.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if not len(flat) or not len(values):
        return np.zeros(len(values), dtype=bool)
    pair = np.dtype([("r", np.int64), ("v", np.int64)])
    wanted, have = np.empty(len(flat), pair), np.empty(len(values), pair)
    wanted["r"], wanted["v"] = np.repeat(np.arange(len(sizes)), sizes), flat
    have["r"], have["v"] = row, values
    return np.isin(have, wanted)


_PIECE = "key binary, shard long, windows int, at long, words binary"
_PLACE = "_at long, _h long, key binary, start long"
_WINDOW = "key binary, head long, at long"


def _piece_rows(suspects: DataFrame, emit: str) -> DataFrame:
    """What the pieces of `suspects` (_at, _h, _text, cold, hot, need) give. `emit` names it:
    'windows': key and document of every window of a hot anchor; 'pieces': the distinct pieces
    of cold anchors and the needed windows, with their words; 'places': where each of the pieces
    and each window of a hot anchor stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 2):
                row, found = _words(part.column(2))
                before = np.searchsorted(row, np.arange(part.num_rows + 1))
                at_, h = part.column(0).to_numpy(), part.column(1).to_numpy()
                for runs, at, start, windows, anchor in pieces_of(found, row):
                    own = row[start + at]
                    cold, hot = _listed(part, 3, own, anchor), _listed(part, 4, own, anchor)
                    single = np.concatenate(
                        [np.zeros(0, int), *[np.arange(s, s + n) for s, n in zip(start[hot], windows[hot])]]
                    ).astype(np.int64)
                    if emit == "windows":
                        names = pa.array(runs.long(single, WIDTH), pa.binary())
                        heads = runs.short(single, WIDTH).view(np.int64)
                        yield _distinct(pa.table({"key": names, "head": heads, "at": at_[row[single + at]]}), ["key", "at"])
                        continue
                    if emit == "pieces":
                        head = runs.short(single, WIDTH).view(np.int64)
                        take = _listed(part, 5, row[single + at], head)
                        first, size = np.concatenate([start[cold], single[take]]), np.concatenate(
                            [windows[cold], np.ones(int(take.sum()), int)]
                        )
                        shard = np.concatenate([anchor[cold], head[take]])
                    else:
                        first, size = np.concatenate([start[cold], single]), np.concatenate(
                            [windows[cold], np.ones(len(single), int)]
                        )
                    length = size + WIDTH - 1
                    table = {"key": pa.array(runs.long(first, length), pa.binary())}
                    doc = row[first + at]
                    if emit == "places":
                        table |= {"_at": at_[doc], "_h": h[doc], "start": first + at - before[doc]}
                        yield pa.Table.from_pydict(table).select(["_at", "_h", "key", "start"]).to_batches()[0]
                        continue
                    data = found.tobytes()
                    words = [data[8 * (f + at) : 8 * (f + at + n)] for f, n in zip(first.tolist(), length.tolist())]
                    table |= {
                        "shard": shard, "windows": pa.array(size.astype(np.int32)), "at": at_[doc],
                        "words": pa.array(words, pa.binary()),
                    }
                    yield _distinct(pa.Table.from_pydict(table), ["key", "at"])
        give_back()

    return suspects.mapInArrow(run, {"windows": _WINDOW, "pieces": _PIECE, "places": _PLACE}[emit])


def _distinct(table: pa.Table, by: list[str]) -> pa.RecordBatch:
    """One row of each that agree in `by`."""
    numbered = table.append_column("_n", pa.array(np.arange(table.num_rows)))
    first = numbered.group_by(by).aggregate([("_n", "min")]).column("_n_min")
    return table.take(first).combine_chunks().to_batches(max_chunksize=None)[0] if len(first) else _none(table)


def _none(table: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in table.schema], names=table.column_names)


def search_shards(pieces: DataFrame, shards: int) -> DataFrame:
    """key and first (by window, the smallest document that holds it) of distinct pieces.

    Each shard indexes its pieces and streams them through the index."""
    numbered = pieces.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(shards)))

    def search(shard: pa.Table) -> pa.Table:
        lengths = shard.column("windows").to_numpy().astype(np.int64) + WIDTH - 1
        flat = np.frombuffer(b"".join(shard.column("words").to_pylist()), np.uint64)
        index = FMIndex(flat, lengths, WIDTH)
        least = index.least_by_block(shard.column("at").to_numpy())
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        rows = []
        for at in range(0, len(lengths), STREAMED):
            end = min(at + STREAMED, len(lengths))
            found, row = index.matching_statistics(flat[offsets[at] : offsets[end]], lengths[at:end])
            rows.append(least[index.block[row[found >= WIDTH]]])
        ends = np.concatenate([[0], np.cumsum(lengths - WIDTH + 1)]).astype(np.int32)
        first = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows), pa.int64()))
        give_back()
        return pa.table({"key": shard.column("key").combine_chunks(), "first": first})

    return numbered.groupBy("shard").applyInArrow(search, "key binary, first array<long>")


def _hits(reps: DataFrame, hot: int) -> DataFrame:
    """_at, _h, cold and hot: by document, the anchors that stand in other documents as well."""
    reps = written(reps.select("_at", "_h", "anchors"), "representatives")
    anchors = reps.select("_at", "_h", F.explode("anchors").alias("anchor"))
    shared = (
        anchors.groupBy("anchor")
        .agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"), F.count(F.lit(1)).alias("n"))
        .filter("lo < hi").select("anchor", (F.col("n") > hot).alias("is_hot"))
    )
    found = lookup_join(anchors, written(shared, "anchors"), ["anchor"], "inner", spread_by=["_at", "_h"])
    lists = [
        F.array_distinct(F.collect_list(F.when(kind, F.col("anchor")))).alias(name)
        for name, kind in (("cold", ~F.col("is_hot")), ("hot", F.col("is_hot")))
    ]
    return found.groupBy("_at", "_h").agg(*lists)


def repeated_starts(source: DataFrame, reps: DataFrame, hot: int, shard_words: int) -> DataFrame | None:
    """_at, _h, _text and places (start, offsets) of the documents with windows that stand in a
    document with a smaller id; None if no anchor is shared."""
    hits = written(_hits(reps, hot), "hits")
    if hits.isEmpty():
        return None
    suspects = source.dropDuplicates(["_at", "_h"]).join(hits, ["_at", "_h"])
    suspects = written(suspects.select("_at", "_h", "_text", "cold", "hot"), "suspects")
    need = F.array().cast("array<long>")
    holders = suspects.withColumn("need", need)
    if not hits.filter(F.size("hot") > 0).isEmpty():
        windows = _piece_rows(holders.filter(F.size("hot") > 0), "windows")
        several = windows.groupBy("key", "head").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).filter("lo < hi")
        wanted = several.groupBy(F.col("lo").alias("_at")).agg(F.collect_list("head").alias("need"))
        holders = suspects.join(wanted, "_at", "left").withColumn("need", F.coalesce("need", need))
    pieces = _piece_rows(holders, "pieces").groupBy("key").agg(
        F.min("at").alias("at"), F.max("at").alias("hi"), F.first("shard").alias("shard"),
        F.first("windows").alias("windows"), F.first("words").alias("words"),
    )
    pieces = written(pieces, "pieces")
    total = pieces.agg(F.sum(F.col("windows") + WIDTH - 1)).first()[0] or 0
    first = written(search_shards(pieces.drop("hi"), -(-total // shard_words) or 1), "first-holders")
    places = written(_piece_rows(suspects.withColumn("need", need), "places"), "places")
    met = lookup_join(places, first, ["key"], "inner", spread_by=["_at", "_h", "start"])
    offsets = F.filter(F.sequence(F.lit(0), F.size("first") - 1), lambda w: F.element_at("first", w + 1) < F.col("_at"))
    met = met.select("_at", "_h", F.struct("start", offsets.alias("offsets")).alias("place"))
    cuts = met.filter(F.size("place.offsets") > 0).groupBy("_at", "_h").agg(F.collect_list("place").alias("places"))
    return suspects.select("_at", "_h", "_text").join(cuts, ["_at", "_h"])


def cut_passages(found: DataFrame) -> DataFrame:
    """_at, _h, removed (words) and kept_sha, for the rows of `repeated_starts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha = [], []
            for text, places in zip(batch.column(2).cast(pa.large_binary()), batch.column(3)):
                data = _bytes_of(text)
                cover = np.zeros(len(_bounds(data)[0]) + 1, dtype=np.int32)
                for place in places.as_py():
                    starts = np.unique(np.array(place["offsets"], dtype=np.int64) + place["start"])
                    cover[starts] += 1
                    cover[starts + WIDTH] -= 1
                keep = np.cumsum(cover[:-1]) <= 0
                removed.append(int((~keep).sum()))
                sha.append(hashlib.sha256(joined(data, keep)).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.binary())],
                names=["_at", "_h", "removed", "kept_sha"],
            )
        give_back()

    return found.mapInArrow(run, "_at long, _h long, removed long, kept_sha binary")


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def without_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_PIECES, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_removed and kept_sha256 (of the kept words,
    joined by one space).

    Ids are whole numbers. A null text has no words; texts of fewer than WIDTH words lose none.
    Rows with a null id come after all others and not before each other; rows that share an id
    take nothing from each other. Windows are judged on the texts as given. `hot` and
    `shard_words` change the work, not the result. Other columns are not read; an empty table
    gives no rows.
    """
    source = _source(docs, id_col, text_col)
    rows = written(summaries(source), "summaries")
    kind = docs.select(F.col(f"`{id_col}`").alias("_id")).schema["_id"].dataType
    large = rows.filter(F.col("n_words") >= WIDTH)
    copies = large.groupBy("sha").agg(F.min("_at").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = written(copies.select("sha", "least"), "copies")
    known = lookup_join(large, copies, ["sha"], "left", spread_by=["_at", "_h"])
    known = known.withColumn("is_copy", F.coalesce(F.col("least") < F.col("_at"), F.lit(False)))
    reps = known.filter(~F.col("is_copy"))
    cut = repeated_starts(source, reps, hot, shard_words)
    narrow = lookup_join(rows.select("_at", "_h", "n_words", "sha"), copies, ["sha"], "left", spread_by=["_at", "_h"])
    if cut is None:
        narrow = narrow.select("*", F.lit(None).cast("long").alias("removed"), F.lit(None).cast("binary").alias("kept_sha"))
    else:
        cut = written(cut_passages(cut).dropDuplicates(["_at", "_h"]), "cut")
        narrow = lookup_join(narrow, cut, ["_at", "_h"], "left")
    is_copy = F.coalesce(F.col("least") < F.col("_at"), F.lit(False)) & (F.col("n_words") >= WIDTH)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return narrow.select(
        F.when(F.col("_at") != NO_ID, F.col("_at")).cast(kind).alias(id_col), "n_words",
        F.when(is_copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(is_copy, empty).otherwise(hex_of(F.coalesce("kept_sha", "sha"))).alias("kept_sha256"),
    )
