"""Near duplicates by a chosen-path similarity join on word shingles.

Each text is its set of shingles; texts with equal sets are one class. In each of several
independent trees, every class goes down two branches per level, each named by one of its
minwise values: which of them a node uses is drawn from the node itself. Classes that share a
path meet in a node. A node of up to EXHAUSTIVE members is compared exhaustively, block against
block: sketches decide which pairs are worth it, full sets which are links. In a larger node a
few pivots are compared with all others, and the rest branches on. A pair of similarity s
survives a level with probability 1 - (1 - s)**2, and with TREES trees a pair at 0.8 is lost in
about one case in 10**4.

Only the components matter, so pairs that confirmed links connect already are not compared. A
group of any number of near copies becomes one component by its pivots; what is left are the few
members outside of it, which are compared with all members of their node. A pair that meets in
several nodes of the first level is compared in one of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.llm import hashing
from histloom.llm.graph import components
from histloom.llm.memory import give_back
from histloom.operators.lookups import sieve, sifted
from histloom.session import discard, written

SHINGLE_WORDS = 5
SIMILARITY = (80, 100)
TREES = 4
BRANCHES = 2
MINWISE = 64
#: A node is compared exhaustively if at most this many members are outside its largest component.
EXHAUSTIVE = 2048
BLOCK_ROWS = 1024
PIVOTS = 3
MAX_LEVELS = 8
#: Pairs whose sketches agree in less than this share of places are not looked at; at a
#: similarity of 0.8 that is five standard deviations below what is expected.
SKETCH_SHARE = 0.55
#: Sets that are compared with one set at once.
CHUNK = 64
TEXTS_AT_ONCE = 256

_RNG = np.random.default_rng(20_011)
_XOR = _RNG.integers(0, 1 << 63, MINWISE, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, MINWISE, dtype=np.uint64) | np.uint64(1)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """MINWISE values: for each of as many orders of all shingles, the least one of the set."""
    least = np.full(MINWISE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        some = (shingles[at : at + 4096, None] ^ _XOR) * _ODD
        np.minimum(least, (some ^ (some >> np.uint64(32))).min(axis=0), out=least)
    return least


def set_class(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for a whole set."""
    if not len(shingles):
        return b""
    a = np.bitwise_xor.reduce(hashing.mix(shingles * _ODD[0]))
    b = np.add.reduce(hashing.mix((shingles ^ _XOR[1]) * _ODD[1]) + np.uint64(len(shingles)))
    return a.tobytes() + b.tobytes()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """(_id, _text) to _id, n_shingles, cls, mins (minwise values) and bits (one byte of each)."""
    kind = texts.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                sets = hashing.shingle_sets(part.column(1), width)
                least = [minwise(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_class(s) for s in sets], pa.binary()),
                        _lists([_signed(m) for m in least]),
                        pa.array([m.astype(np.uint8).tobytes() for m in least], pa.binary()),
                    ],
                    names=["_id", "n_shingles", "cls", "mins", "bits"],
                )
        give_back()

    return texts.mapInArrow(run, f"_id {kind}, n_shingles long, cls binary, mins array<long>, bits binary")


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(_id, _text) to cls and shingles (the whole set, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                sets = hashing.shingle_sets(part.column(1), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_class(s) for s in sets], pa.binary()), _lists([_signed(s) for s in sets])],
                    names=["cls", "shingles"],
                )
        give_back()

    return texts.mapInArrow(run, "cls binary, shingles array<long>")


def class_ids(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The `sieve` of the ids that stand for the classes whose cls is in `wanted`."""
    return sieve(classes.join(wanted.select("cls").distinct(), "cls", "left_semi"), ["_id"])


def class_sets(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """cls and shingles of the classes whose ids are in `ids` (see `class_ids`), each once, and
    of few others. The texts are read again and do not move: only sets are shuffled."""
    return full_sets(sifted(texts, ids, ["_id"]), width).dropDuplicates(["cls"])


def _child(node: Column, branch: Column, mins: Column) -> Column:
    """The node below `node` by a branch: the place that it draws, and the class's value there."""
    place = F.pmod(F.xxhash64(F.lit("place"), node, branch), F.lit(MINWISE)).cast("int")
    return F.xxhash64(node, branch, F.element_at(mins, place + 1))


def first_nodes(classes: DataFrame) -> DataFrame:
    """node and cls below the roots of all trees."""
    paths = F.array(*[
        _child(F.lit(tree).cast("long"), F.lit(branch), F.col("mins"))
        for tree in range(TREES) for branch in range(BRANCHES)
    ])
    return classes.select(F.explode(paths).alias("node"), "cls").distinct()


def next_nodes(members: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and cls one level further down, for (node, cls) of open large nodes. The minwise
    values are those in `found`, of whose rows few but those in `wanted`, the `sieve` of the
    members, leave the scan."""
    paths = F.array(*[_child(F.col("node"), F.lit(b), F.col("mins")) for b in range(BRANCHES)])
    mins = sifted(found.select("cls", "mins"), wanted, ["cls"]).dropDuplicates(["cls"])
    below = members.select("node", "cls").join(mins, "cls")
    return below.select(F.explode(paths).alias("node"), "cls").distinct()


def _members(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """node, cls, label (the component so far), and of the node: size, top (the label of its
    largest component) and out (how many members are not of it). Nodes whose members are all
    connected are left out."""
    if labels is None:
        named = nodes.withColumn("label", F.col("cls"))
    else:
        known = labels.select(F.col("id").alias("cls"), F.col("root").alias("label"))
        named = nodes.join(known, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    counts = named.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    shapes = counts.groupBy("node").agg(
        F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("n")
    )
    shapes = shapes.select("node", "size", "top", (F.col("size") - F.col("n")).alias("out")).filter("out > 0")
    return named.join(shapes, "node")


def _likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


_ROW = {
    "node": pa.int64(), "i": pa.int32(), "j": pa.int32(), "block": pa.int32(), "cls": pa.binary(),
    "label": pa.binary(), "bits": pa.binary(), "met": pa.list_(pa.int64()),
}
_ROW_SCHEMA = "node long, i int, j int, block int, cls binary, label binary, bits binary, met array<long>"


def node_blocks(members: DataFrame, sketch: DataFrame, met: DataFrame) -> DataFrame:
    """The rows of every pair of blocks (i, j) to compare, sorted so that they come together.

    Blocks hold the members outside the largest component of a node first, then those in it; no
    pair of blocks is within the largest component.
    """
    outside = F.col("label") != F.col("top")
    first = F.ceil(F.col("out") / BLOCK_ROWS).cast("int")
    second = F.ceil((F.col("size") - F.col("out")) / BLOCK_ROWS).cast("int")
    spread = F.xxhash64("cls")
    block = F.when(outside, F.pmod(spread, first)).otherwise(first + F.pmod(spread, second)).cast("int")
    others = F.when(outside, F.sequence(F.lit(0), first + second - 1)).otherwise(F.sequence(F.lit(0), first - 1))
    return (
        members.select("node", "cls", "label", block.alias("block"), F.explode(others).alias("other"))
        .join(sketch.join(met, "cls", "left"), "cls")
        .select(
            "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
            "cls", "label", "bits", F.coalesce("met", F.array().cast("array<long>")).alias("met"),
        )
        .repartition("node", "i", "j")
        .sortWithinPartitions("node", "i", "j", "block")
    )


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows that agree in node, i and j, as tuples of their `width` columns."""
    last, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(min(width, len(_ROW)))]
        if width > len(_ROW):  # full sets stay arrays
            ends, values = batch.column(len(_ROW)).offsets.to_numpy(), batch.column(len(_ROW)).values.to_numpy()
            columns.append([values[a:b].copy() for a, b in zip(ends[:-1], ends[1:])])
        for row in zip(*columns):
            if row[:3] != last and held:
                yield held
                held = []
            last = row[:3]
            held.append(row)
    if held:
        yield held


def _fresh(rows: list[tuple]) -> np.ndarray:
    """Matrix of the pairs that are not connected, and that have not met in a node before this one."""
    node, names, places = rows[0][0], {}, defaultdict(list)
    label = np.array([names.setdefault(r[5], len(names)) for r in rows])
    for k, r in enumerate(rows):
        for place in r[7]:
            places[place].append(k)
    here = np.zeros(len(rows), dtype=bool)
    here[places.pop(node, [])] = True
    fresh = label[:, None] != label
    for place, at in places.items():
        if len(at) > 1:
            first = here[at]  # of two places the lesser one comes first
            fresh[np.ix_(at, at)] &= first[:, None] & first & (place > node)
    return fresh


def _pairs(rows: list[tuple]) -> np.ndarray:
    """Matrix of the likely pairs of one pair of blocks that are to be compared here; both halves."""
    _, i, j = rows[0][:3]
    if len(rows) < 2:
        return np.zeros((len(rows), len(rows)), dtype=bool)
    some = _fresh(rows)
    if i != j:
        block = np.array([r[3] for r in rows])
        some &= block[:, None] != block
    grid = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), -1)
    for k in np.flatnonzero(some.any(axis=1)):
        at = k + 1 + np.flatnonzero(some[k, k + 1 :])
        some[k, at] = some[at, k] = _likely(grid[k], grid[at]) >= SKETCH_SHARE
    return some


def likely_members(blocks: DataFrame) -> DataFrame:
    """The rows of `node_blocks` that have a likely partner in their pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _groups(batches, len(_ROW)):
            out += [rows[k] for k in np.flatnonzero(_pairs(rows).any(axis=1))]
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        yield _batch(out)
        give_back()

    return blocks.mapInArrow(run, _ROW_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_ROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _ROW.values())], names=list(_ROW))


def _joining(rows: list[tuple], some: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Places of linked pairs among those in `some` that join all that any of them connect. A row is
    compared with the rows that it is not connected with when its turn comes, all at once."""
    num, den = similarity
    sizes = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(flat, np.cumsum(sizes)[:-1])
    first: dict[bytes, int] = {}
    root = np.array([first.setdefault(r[5], k) for k, r in enumerate(rows)])
    own, links = np.zeros(len(names), dtype=bool), []
    for x in np.flatnonzero(some.any(axis=1)):
        small, big = np.minimum(sizes, sizes[x]), np.maximum(sizes, sizes[x])
        open_ = some[x] & (root != root[x]) & (den * small >= num * big)
        at = x + 1 + np.flatnonzero(open_[x + 1 :])
        if not len(at):
            continue
        own[codes[x]] = True
        starts = np.cumsum(sizes[at]) - sizes[at]
        both = np.add.reduceat(own[np.concatenate([codes[y] for y in at])], starts, dtype=np.int64)
        own[codes[x]] = False
        for y in at[den * both >= num * (sizes[x] + sizes[at] - both)]:
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                links.append((x, y))
    return links


def block_links(likely: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """a, b: links found on the full sets of `likely_members`. Within a pair of blocks, only
    those that connect something new."""
    filled = likely.join(sets, "cls").select(*_ROW, "shingles")
    filled = filled.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, len(_ROW) + 1):
            links = _joining(rows, _pairs(rows), [r[8] for r in rows], similarity)
            if links:
                ends = [pa.array([rows[k][4] for k in side], pa.binary()) for side in zip(*links)]
                yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])
        give_back()

    return filled.mapInArrow(run, "a binary, b binary")


def pivot_pairs(large: DataFrame, bits: DataFrame) -> DataFrame:
    """Likely pairs (a, b) of PIVOTS members of each node, drawn by hash, and the members that
    are not connected with them."""
    drawn = [
        F.min_by(F.struct("cls", "label"), F.xxhash64(F.lit(i), "node", "cls")).alias(f"p{i}") for i in range(PIVOTS)
    ]
    picked = large.groupBy("node").agg(*drawn)
    each = F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)])))
    pivots = picked.select("node", each.alias("p")).select("node", "p.cls", "p.label")
    pivots = pivots.join(bits, "cls").select(
        "node", F.col("cls").alias("a"), F.col("label").alias("a_label"), F.col("bits").alias("a_bits")
    )
    rows = (
        large.join(bits, "cls")
        .join(pivots, "node")
        .filter("label <> a_label")
        .select("a", F.col("cls").alias("b"), "a_bits", "bits")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grids = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for c in (2, 3)
            ]
            keep = pa.array(_likely(*grids) >= SKETCH_SHARE)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], names=["a", "b"])

    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    return rows.mapInArrow(run, "a binary, b binary").select(*ends).distinct()


def confirm(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The distinct pairs whose full sets are similar enough: den * intersection >= num * union.

    A set is sent once per CHUNK partners. A task reads its groups one after the other, sorted,
    so it holds a few sets at a time.
    """
    num, den = similarity
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).alias("chunk")
    chunked = pairs.join(sizes, "a").select("a", chunk, "b")
    lead = chunked.select("a", "chunk", F.col("a").alias("cls"), F.lit(0).alias("part")).distinct()
    asked = lead.union(chunked.select("a", "chunk", F.col("b"), F.lit(1)))
    filled = asked.join(sets, "cls").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            cls, of, part = (batch.column(i).to_pylist() for i in (0, 1, 3))
            offsets = batch.column(4).offsets.to_numpy()
            values = batch.column(4).values.to_numpy()
            a, b = [], []
            for i in range(batch.num_rows):
                own = values[offsets[i] : offsets[i + 1]]
                if part[i] == 0:
                    lead = own
                    continue
                small, big = sorted((lead, own), key=len)
                if den * len(small) < num * len(big):
                    continue
                both = int(np.isin(small, big, assume_unique=True, kind="sort").sum())
                if den * both >= num * (len(small) + len(big) - both):
                    a.append(of[i])
                    b.append(cls[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return filled.select("cls", "a", "chunk", "part", "shingles").mapInArrow(run, "a binary, b binary")


def link_classes(
    found: DataFrame, texts: DataFrame, width: int, similarity: tuple[int, int]
) -> DataFrame | None:
    """id and root of every class that is linked with another; None if there is none.

    `found` is the written result of `sketches` over `texts`. Every table on the way, and the
    shuffles that made it, are removed when nothing reads them any more. Full sets are not
    written: each level makes those of the classes that it compares from the texts.
    """
    step = partial(written, drop_shuffles=True)
    found = found.filter("n_shingles > 0")
    nodes = first_nodes(found)
    shared = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    nodes = step(nodes.join(shared, "node"), "nodes")
    classes = step(
        found.join(nodes.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(
            F.min("_id").alias("_id"), F.first("bits").alias("bits")
        ),
        "classes",
    )
    bits = classes.select("cls", "bits")
    members = step(_members(nodes, None), "members")
    discard(nodes)
    below, large = members, members.filter(F.col("size") > EXHAUSTIVE)
    small = members.filter(F.col("size") <= EXHAUSTIVE)
    met = small.groupBy("cls").agg(F.collect_list("node").alias("met"))
    likely = step(likely_members(node_blocks(small.filter(F.col("out") <= EXHAUSTIVE), bits, met)), "likely")
    labels = None
    for level in range(1, MAX_LEVELS + 2):
        hot = not large.isEmpty()
        new = []
        if not likely.isEmpty():
            ids = step(class_ids(classes, likely), "ids")
            new.append(step(block_links(likely, class_sets(texts, ids, width), similarity), "links"))
            discard(ids)
        discard(likely)
        if hot:
            pairs = step(pivot_pairs(large, bits), "pairs")
            ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
            ids = step(class_ids(classes, ends), "ids")
            new.append(step(confirm(pairs, class_sets(texts, ids, width), similarity), "links"))
            discard(ids, pairs)
        if not all(links.isEmpty() for links in new):
            old = [] if labels is None else [labels.select(F.col("id").alias("a"), F.col("root").alias("b"))]
            last, labels = labels, step(components(reduce(DataFrame.union, old + new)), "labels")
            discard(last)
        discard(*new)
        if not hot:
            break
        still = step(_members(large.select("node", "cls"), labels), "open")
        if below is not members:  # all levels read where classes met in the first
            discard(below)
        done = F.lit(True) if level == MAX_LEVELS else F.col("out") <= EXHAUSTIVE
        compared = still.filter(done)
        opened = still.filter(~done)
        wanted = step(sieve(opened.select("cls").distinct(), ["cls"]), "wanted")
        below = step(_members(next_nodes(opened, found, wanted), labels), "members")
        discard(wanted)
        small = below.filter(F.col("size") <= EXHAUSTIVE)
        large = below.filter(F.col("size") > EXHAUSTIVE)
        likely = step(likely_members(node_blocks(compared.unionByName(small), bits, met)), "likely")
        discard(still)
    discard(classes, members, None if below is members else below)
    return labels


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE_WORDS,
    similarity: tuple[int, int] = SIMILARITY,
) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the smallest id reachable by
    links) and kept (whether that is the row's own).

    Words are what lies between white space, with A-Z in lower case. A text with fewer words
    than `width` is one shingle. A text without words, or null, has none and is alone. Rows
    that repeat an id get the same answer if their texts are linked; a null id is never the
    smallest unless its component has no other. Extra columns are not read. An empty table gives
    no rows.
    """
    texts = docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text")
    )
    found = written(sketches(texts, width), "sketches")
    labels = link_classes(found, texts, width, similarity)
    rows = found.select("_id", "n_shingles", "cls")
    if labels is None:
        rows = rows.withColumn("root", F.col("cls"))
    else:
        known = labels.select(F.col("id").alias("cls"), "root")
        rows = rows.join(known, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = (
        rows.filter("n_shingles > 0")
        .groupBy("root")
        .agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("root", "least")
    )
    joined = rows.join(least, "root", "left")
    together = F.col("least").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(together, F.col("least")).otherwise(F.col("_id"))
    return joined.select(
        F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"),
        component.eqNullSafe(F.col("_id")).alias("kept"),
    )
