"""Near duplicates of embeddings by NN-descent.

A forest of random cuts gives every vector its first neighbours: vectors are sorted by the sides
of random planes that they lie on, and compared within sliding windows of that order. Then each
round compares the neighbours of every vector with each other, since a neighbour's neighbour is
likely to be near, and keeps the best. A vector whose list is full of links has a larger list in
the next round. Rounds end when they find no new link; an audit of a bounded number of vectors
against all others then measures the recall of each, and a larger forest is added while it is too
low. The first forest has as many trees as the number of vectors asks for.

Lists only have to connect what belongs together. Where both ends of a link have full lists, both
can have cut it: such vectors of different components are compared exactly if the angle between
the components allows a link. The links within a component are then counted exactly, in double precision, block against block, however many there are, without a row for
each pair. Vectors that are equal are one class with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histloom.llm.graph import components
from histloom.operators.skew import lookup_join
from histloom.session import written

THRESHOLD = 0.9
#: Trees of any first forest; `trees_for` adds more as the table grows.
TREES = 6
#: A pair at the threshold may miss all windows of a first forest with this probability.
MISSED = 1e-3
PLANES = 32
WINDOW = 48
NEIGHBOURS = 6
#: A list grows to this when it is full of links; links that it cuts are found by `joining_links`.
MOST_NEIGHBOURS = 24
ROUNDS = 5
#: Each forest has twice the trees of the one before it.
FORESTS = 6
AUDITED = 512
RECALL = 0.99
BLOCK_ROWS = 512
#: Single precision decides what is looked at, double precision what is a link.
SLACK = 1e-4


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id, cls (16 bytes that stand for the vector) and unit (scaled to length 1).

    cls is null for a vector that is null, empty or zero, or has null or non-finite parts.
    """
    kind = vectors.select(id_col).schema[0].dataType.simpleString()

    def one(parts: list | None) -> np.ndarray | None:
        if not parts or None in parts:
            return None
        v = np.array(parts, dtype=np.float64) + 0.0  # no negative zero
        most = np.abs(v).max()
        if not np.isfinite(most) or most == 0.0:
            return None
        v = v / most
        return v / np.sqrt(v @ v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [one(v) for v in batch.column(1).to_pylist()]
            cls = [None if u is None else hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in units]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cls, pa.binary()), pa.array(units, pa.list_(pa.float64()))],
                names=["_id", "cls", "unit"],
            )

    vector = F.col(f"`{vector_col}`").cast("array<double>").alias("_v")
    return vectors.select(F.col(f"`{id_col}`").alias("_id"), vector).mapInArrow(
        run, f"_id {kind}, cls binary, unit array<double>"
    )


def _matrix(column: pa.Array, dtype=np.float32) -> np.ndarray:
    """A list column of vectors of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype, copy=False)


def _best(sims: np.ndarray, n: int) -> np.ndarray:
    """Places of the `n` largest values of each row, of all if there are fewer."""
    n = min(n, sims.shape[1])
    return np.argpartition(-sims, n - 1, axis=1)[:, :n]


_EDGE = "a binary, b binary, sim float"


def _edges(a: list, b: list, sim: list) -> pa.RecordBatch:
    arrays = [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(np.array(sim, np.float32), pa.float32())]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "sim"])


def trees_for(n: int, threshold: float) -> int:
    """Trees after which a pair at `threshold` among `n` vectors was in one window of some tree,
    but for MISSED: the pair has to agree in as many planes as cut the table into windows."""
    same_side = 1.0 - np.arccos(min(max(threshold, -1.0), 1.0)) / np.pi
    met = same_side ** np.log2(max(2 * n / WINDOW, 1.0))
    return max(TREES, int(np.ceil(np.log(MISSED) / np.log1p(-min(met, 0.999)))))


def forest(classes: DataFrame, seed: int, trees: int, threshold: float) -> DataFrame:
    """a, b, sim: for every vector its nearest ones within windows of each of `trees` random
    orders; after the first TREES orders, only those that are links."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dim = batch.column(1).to_numpy()
            for d in np.unique(dim):
                part = batch.filter(pa.array(dim == d))
                unit = _matrix(part.column(2))
                for tree in range(trees):
                    planes = np.random.default_rng([seed, tree, int(d)]).standard_normal((d, PLANES)).astype(np.float32)
                    code = (unit @ planes > 0) @ (1 << np.arange(PLANES, dtype=np.int64)[::-1])
                    same = pa.array(np.full(part.num_rows, tree, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [same, part.column(1), pa.array(code), part.column(0), part.column(2).cast(pa.list_(pa.float32()))],
                        names=["tree", "dim", "code", "cls", "unit"],
                    )

    def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        a, b, sim = [], [], []
        for group in {r[0] for r in rows}:
            some = [r for r in rows if r[0] == group]
            if len(some) < 2:
                continue
            unit = np.stack([r[2] for r in some])
            sims = unit @ unit.T
            np.fill_diagonal(sims, -2.0)
            least = -2.0 if group[0] < TREES else threshold - SLACK
            for i, best in enumerate(_best(sims, min(NEIGHBOURS, len(some) - 1))):
                best = best[sims[i, best] >= least]
                a += [some[i][1]] * len(best)
                b += [some[j][1] for j in best]
                sim += sims[i, best].tolist()
        yield _edges(a, b, sim)

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            trees, dims, cls = (batch.column(i).to_pylist() for i in (0, 1, 3))
            units, at = batch.column(4).flatten().to_numpy(), 0
            for tree, dim, c in zip(trees, dims, cls):
                rows.append(((tree, dim), c, units[at : at + dim]))
                at += dim
                if len(rows) == WINDOW:
                    yield from compare(rows)
                    rows = rows[WINDOW // 2 :]
        yield from compare(rows)

    coded = classes.select("cls", F.size("unit").alias("dim"), "unit").mapInArrow(
        codes, "tree int, dim int, code long, cls binary, unit array<float>"
    )
    order = ["tree", "dim", "code", "cls"]
    ranged = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(slide, _EDGE)


def best_lists(edges: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """a, b, sim, fresh, k: the best `k` neighbours of each vector, and its list size from now on:
    twice as large if the list is full of links."""
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    if sizes is None:
        known = once.withColumn("k", F.lit(NEIGHBOURS))
    else:
        known = once.join(sizes, "a", "left").withColumn("k", F.coalesce("k", F.lit(NEIGHBOURS)))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    whole = Window.partitionBy("a")
    ranked = known.withColumn("rn", F.row_number().over(order)).filter(f"rn <= {MOST_NEIGHBOURS} and rn <= k")
    full = (F.count(F.lit(1)).over(whole) == F.col("k")) & (F.min("sim").over(whole) >= THRESHOLD - SLACK)
    grown = F.when(full, F.least(F.col("k") * 2, F.lit(MOST_NEIGHBOURS))).otherwise(F.col("k"))
    return ranked.withColumn("k", grown).drop("rn")


def neighbours_of_neighbours(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, sim: pairs of vectors that are both neighbours of some third one, at least one of
    them newly so, if the pair would enter the list of a."""
    worst = lists.groupBy("a").agg(
        F.when(F.count(F.lit(1)) >= F.max("k"), F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst")
    )
    both = lists.select("a", "b", "sim", "fresh").union(lists.select("b", "a", "sim", "fresh"))
    both = both.groupBy(F.col("a").alias("v"), F.col("b").alias("u")).agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh"))
    near = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    members = both.withColumn("rn", F.row_number().over(near)).filter(f"rn <= {2 * MOST_NEIGHBOURS}")
    moving = members.groupBy("v").agg(F.max("fresh").alias("moves")).filter("moves").select("v")
    unit = classes.select(F.col("cls").alias("u"), F.col("unit").cast("array<float>").alias("unit"))
    rows = (
        members.select("v", "u", "fresh")
        .join(moving, "v", "left_semi")
        .join(unit.join(worst.withColumnRenamed("a", "u"), "u", "left"), "u")
        .select("v", "u", "fresh", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"), "unit")
        .repartition("v")
        .sortWithinPartitions("v", "u")
    )

    def compare(cls, fresh, worst, units) -> pa.RecordBatch:
        unit = np.stack(units)
        sims = unit @ unit.T
        fresh, worst = np.array(fresh), np.array(worst)
        take = (sims > worst[:, None]) & (fresh[:, None] | fresh[None, :])
        np.fill_diagonal(take, False)
        i, j = np.nonzero(take)
        return _edges([cls[x] for x in i], [cls[x] for x in j], sims[i, j].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [], [], [])
        for batch in batches:
            vs, us, fresh, worst = (batch.column(i).to_pylist() for i in range(4))
            ends = batch.column(4).offsets.to_numpy()
            units = batch.column(4).values.to_numpy()
            for x, v in enumerate(vs):
                if v != last:
                    if len(held[0]) > 1:
                        yield compare(*held)
                    last, held = v, ([], [], [], [])
                for column, value in zip(held, (us[x], fresh[x], worst[x], units[ends[x] : ends[x + 1]])):
                    column.append(value)
        if len(held[0]) > 1:
            yield compare(*held)

    return rows.mapInArrow(run, _EDGE)


def descend(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Neighbour lists after rounds of comparing neighbours' neighbours, until a round changes no
    list by a link."""
    lists = written(best_lists(edges.withColumn("fresh", F.lit(True)), None), "lists")
    for _ in range(ROUNDS):
        old = lists.withColumn("fresh", F.lit(False))
        new = neighbours_of_neighbours(lists, classes).withColumn("fresh", F.lit(True))
        sizes = lists.groupBy("a").agg(F.max("k").alias("k"))
        # an edge that was there before is not fresh: false is the smaller value
        lists = written(best_lists(old.select("a", "b", "sim", "fresh").union(new), sizes), "lists")
        if lists.filter(F.col("fresh") & (F.col("sim") >= THRESHOLD - SLACK)).isEmpty():
            break
    return lists


def true_links(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Those of the likely pairs (a, b) that are links in double precision."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = classes.select(F.col("cls").alias("a"), F.col("unit").alias("x"))
    right = classes.select(F.col("cls").alias("b"), F.col("unit").alias("y"))
    rows = once.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            keep = [len(p) == len(q) and float(np.dot(p, q)) >= threshold for p, q in zip(x, y)]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def audit(spark: SparkSession, classes: DataFrame, threshold: float) -> DataFrame:
    """a, b: all links of AUDITED vectors, chosen by hash, found against all vectors."""
    chosen = classes.orderBy(F.xxhash64(F.lit("audit"), "cls"), "cls").limit(AUDITED).select("cls", "unit").collect()
    by_dim: dict[int, list] = {}
    for r in chosen:
        by_dim.setdefault(len(r["unit"]), []).append((bytes(r["cls"]), r["unit"]))
    shared = spark.sparkContext.broadcast(by_dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {d: ([c for c, _ in rows], np.array([u for _, u in rows])) for d, rows in shared.value.items()}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims) if batch.num_rows else ():
                if d not in asked:
                    continue
                part = batch.filter(pa.array(dims == d))
                names, grid = asked[d]
                cls = part.column(0).to_pylist()
                i, j = np.nonzero(_matrix(part.column(2), np.float64) @ grid.T >= threshold)
                pairs = [(names[y], cls[x]) for x, y in zip(i, j) if names[y] != cls[x]]
                arrays = [pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    return classes.select("cls", F.size("unit").alias("dim"), "unit").mapInArrow(run, "a binary, b binary")


def measured_recall(truth: DataFrame, labels: DataFrame) -> float:
    """The mean over audited vectors of the share of their links whose ends are in one component;
    the mean of those with one or two links, if it is lower. Links of dense groups, which are many
    and easy to find, so do not hide lost pairs."""
    a = labels.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    b = labels.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    each = truth.join(a, "a", "left").join(b, "b", "left").groupBy("a").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("ra") == F.col("rb"), 1.0).otherwise(0.0)).alias("share")
    )
    means = each.agg(F.avg("share"), F.avg(F.when(F.col("n") <= 2, F.col("share")))).first()
    return min((m for m in means if m is not None), default=1.0)


def full_lists(lists: DataFrame, threshold: float) -> DataFrame:
    """cls of the vectors with NEIGHBOURS or more links in their list: no other list, in any window
    or round, can have cut a link."""
    links = lists.filter(F.col("sim") >= threshold - SLACK).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    return links.filter(F.col("n") >= NEIGHBOURS).select(F.col("a").alias("cls"))


def near_components(leaders: DataFrame, threshold: float) -> DataFrame:
    """ra, rb (ra < rb): the components (root, unit of a leader, radius around it) that can hold a
    link, since angles obey the triangle inequality; all against all, block against block."""
    n_blocks = -(-leaders.count() // BLOCK_ROWS) or 1
    block = F.pmod(F.xxhash64("root"), F.lit(n_blocks)).cast("int").alias("block")
    rows = (
        leaders.select("root", "radius", "unit", F.size("unit").alias("dim"), block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        .select("dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "root", "radius", "unit")
        .repartition("dim", "i", "j")
        .sortWithinPartitions("dim", "i", "j", "block", "root")
    )
    widest = np.arccos(threshold) + 1e-6

    def compare(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        block, root, radius = (np.array([h[c] for h in held], dtype=t) for c, t in ((0, int), (1, object), (2, float)))
        unit = np.stack([h[3] for h in held])
        mine, others = np.nonzero(block == key[1])[0], np.nonzero(block == key[2])[0]
        angle = np.arccos(np.clip(unit[mine] @ unit[others].T, -1.0, 1.0))
        x, y = np.nonzero(angle <= widest + radius[mine][:, None] + radius[others][None, :])
        pairs = [sorted((root[mine[a]], root[others[b]])) for a, b in zip(x, y) if key[1] != key[2] or a < b]
        return pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.binary()) for c in (0, 1)], names=["ra", "rb"])

    return rows.mapInArrow(_by_key(3, compare), "ra binary, rb binary")


def _by_key(n_keys: int, compare):
    """An Arrow function over rows sorted by their first `n_keys` columns, the last column a vector:
    one batch of `compare(key, rows)` for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            *columns, ends = [c.to_pylist() for c in batch.columns[:-1]] + [batch.columns[-1].offsets.to_numpy()]
            units = batch.columns[-1].values.to_numpy()
            for x, row in enumerate(zip(*columns)):
                if row[:n_keys] != last:
                    if held:
                        yield compare(last, held)
                    last, held = row[:n_keys], []
                held.append((*row[n_keys:], units[ends[x] : ends[x + 1]].copy()))
        if held:
            yield compare(last, held)

    return run


def joining_links(labels: DataFrame, full: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between components that lists have cut, enough to join what belongs together.

    A link is cut from both lists only if both ends have full ones (`full`). So the members with
    full lists are compared, block against block and in double precision, for all components that
    are near enough to hold a link. One link of each pair of blocks is returned.
    """
    lead = classes.select(F.col("cls").alias("root"), F.col("unit").alias("lead"))
    dense = labels.withColumnRenamed("id", "cls").join(full, "cls", "left_semi").join(classes.select("cls", "unit"), "cls")
    cosine = F.aggregate(F.zip_with("unit", "lead", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    angle = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))
    dense = written(lookup_join(dense, lead, ["root"], "inner", spread_by=["cls"]).withColumn("angle", angle), "dense")
    leaders = dense.groupBy("root").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("blocks")
    leaders = written(leaders.join(lead, "root").select("root", "radius", F.col("lead").alias("unit"), blocks), "leaders")
    near = near_components(leaders.select("root", "radius", "unit"), threshold)
    a, b = (
        leaders.select(F.col("root").alias(f"r{c}"), F.col("blocks").alias(f"n{c}"), F.col("radius").alias(f"d{c}"), F.col("unit").alias(f"u{c}"))
        for c in "ab"
    )
    near = written(near.join(a, "ra").join(b, "rb"), "near-components")

    def side(mine: str, other: str) -> DataFrame:
        """The members of one of the two components that can have a link with the other one."""
        towards = F.aggregate(F.zip_with("unit", f"u{other}", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        close = towards >= F.cos(F.least(F.lit(np.arccos(threshold) + 1e-6) + F.col(f"d{other}"), F.lit(np.pi)))
        at = F.pmod(F.xxhash64("cls"), F.col(f"n{mine}")).cast("int").alias(f"at_{mine}")
        held = near.withColumnRenamed(f"r{mine}", "root").join(dense.select("root", "cls", "unit"), "root").filter(close)
        held = held.withColumnRenamed("root", f"r{mine}").withColumn(f"at_{mine}", at)
        held = held.withColumn(f"at_{other}", F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)))
        return held.select("ra", "rb", "at_a", "at_b", F.lit(mine).alias("side"), "cls", "unit")

    key = ["ra", "rb", "at_a", "at_b"]
    rows = side("a", "b").union(side("b", "a")).repartition(*key).sortWithinPartitions(*key, "side", "cls")

    def compare(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        first = sum(h[0] == "a" for h in held)
        found = []
        if 0 < first < len(held):
            unit = np.stack([h[2] for h in held])
            sims = unit[:first] @ unit[first:].T
            x, y = np.unravel_index(sims.argmax(), sims.shape)
            found = [(held[x][1], held[first + y][1])] if sims[x, y] >= threshold else []
        return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.binary()) for c in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(_by_key(len(key), compare), "a binary, b binary")


def count_links(labels: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """cls and n_links: the links within each component, counted block against block."""
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    members = labels.join(sizes, "root").select(
        "root", F.col("id").alias("cls"), blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")
    )
    rows = (
        members.join(classes, "cls")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            "block", "cls", F.col("copies").alias("n"), "unit",
        )
        .repartition("root", "i", "j")
        .sortWithinPartitions("root", "i", "j", "block")
    )

    def count(held: list[tuple], i: int, j: int) -> Iterator[pa.RecordBatch]:
        unit = np.stack([h[3] for h in held])
        copies = np.array([h[2] for h in held])
        block = np.array([h[0] for h in held])
        pairs = [(block == i, block == j)] + ([(block == j, block == i)] if i != j else [])
        cls, found = [], []
        for mine, others in pairs:
            links = unit[mine] @ unit[others].T >= threshold
            if i == j:
                np.fill_diagonal(links, False)
            cls += [h[1] for h, m in zip(held, mine) if m]
            found += (links @ copies[others]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(found, pa.int64())], names=["cls", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            root, i, j, block, cls, n = (batch.column(c).to_pylist() for c in range(6))
            ends, units = batch.column(6).offsets.to_numpy(), batch.column(6).values.to_numpy()
            for x, key in enumerate(zip(root, i, j)):
                if key != last and held:
                    yield from count(held, *last[1:])
                    held = []
                last = key
                held.append((block[x], cls[x], n[x], units[ends[x] : ends[x + 1]].copy()))
        if held:
            yield from count(held, *last[1:])

    counted = rows.mapInArrow(run, "cls binary, n long")
    return counted.groupBy("cls").agg(F.sum("n").alias("n_links"))


def linked(classes: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """The components by links: forests are added, each with twice the trees of the last, until all
    of them together reach RECALL of the audited links `truth`, which are for measuring only."""
    trees = trees_for(classes.count(), threshold)
    links = full = None
    for attempt in range(FORESTS):
        lists = descend(forest(classes, attempt, trees << attempt, threshold), classes)
        likely = lists.filter(F.col("sim") >= threshold - SLACK).select("a", "b")
        found, cut = written(true_links(likely, classes, threshold), "vector-links"), full_lists(lists, threshold)
        links, full = (found, cut) if links is None else (links.union(found), full.union(cut))
        labels = written(components(links), "vector-labels")
        joins = written(joining_links(labels, full.distinct(), classes, threshold), "joining-links")
        if not joins.isEmpty():
            links = links.union(joins)
            labels = written(components(links), "vector-labels")
        recall = measured_recall(truth, labels)
        if recall >= RECALL:
            return labels
    raise RuntimeError(f"{FORESTS} forests find a share of {recall:.4f} of the audited links, not {RECALL}")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of `vectors`: id, n_links (other rows with a cosine of `threshold` or
    more), component_id (the smallest id reachable by links) and kept (whether that is its own).

    Vectors that are null, empty or zero, or hold null or non-finite parts, link with nothing,
    and vectors of different lengths do not link with each other. Equal vectors are linked.
    Repeated rows count as several. A null id is never the smallest unless its component has no
    other. Extra columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(unit_vectors(vectors, id_col, vector_col), "units")
    classes = written(
        rows.filter("cls is not null").groupBy("cls").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies")),
        "vector-classes",
    )
    truth = written(audit(spark, classes, threshold), "audit")
    labels = linked(classes, truth, threshold)
    counts = count_links(labels, classes, threshold)
    known = classes.select("cls", "copies").join(labels.withColumnRenamed("id", "cls"), "cls", "left").join(counts, "cls", "left")
    known = known.select(
        "cls", F.coalesce("root", "cls").alias("root"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    named = rows.select("_id", "cls").join(known, "cls", "left")
    least = (
        named.filter("root is not null").groupBy("root")
        .agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    component = F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("_id"))
    return named.join(least, "root", "left").select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept"),
    )
