"""Files of records that span lines, read block by block: JSON arrays and quoted CSV.

Spark's text reader gives each task a byte range of a file, cut at a separator (`}` for arrays, a
line end for CSV). Whether a separator ends a record depends on all that stands before it: on
quotes, and for JSON on the depth of brackets. So a first scan reduces every block to its effect
on that state, for both quote states at its start; a prefix pass over the effects (one small row
per block) gives the state in which each block starts; a second scan cuts the records that lie
inside a block. What is left at both ends of a block belongs to records that cross blocks: those
pieces alone are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histloom.session import written

QUOTE, BACKSLASH = ord('"'), ord("\\")
OPENS, CLOSES = (ord("["), ord("{")), (ord("]"), ord("}"))
#: Tables of block states up to this many rows (about 100 bytes each) are sent to all tasks.
SENT_BLOCKS = 200_000
#: Parts of the records that a scan gives: whole ones, and pieces of a record that crosses blocks:
#: the end of it, its start, and a block in its middle.
WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3
_EFFECT = "file string, block long, quotes long, depth0 long, depth1 long, opens string"
_PART = "_block long, part int, value string"


def fragments(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """value, file, block (its first byte) and _row: what lies between separators, in order."""
    return spark.read.option("lineSep", separator).text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_row"),
    )


class _Text:
    """The bytes of some fragments, each followed by the separator, and what is structure in
    them. `state` is whether the text starts inside quotes."""

    def __init__(self, values: pa.Array, separator: bytes, json: bool) -> None:
        values = values.cast(pa.large_binary())
        offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        n = len(values)
        self.ends = offsets[1:] - offsets[0] + np.arange(n)  # the place of each separator
        inside = np.ones(len(data) + n, dtype=bool)
        inside[self.ends] = False
        self.data = np.full(len(data) + n, ord(separator), dtype=np.uint8)
        self.data[inside] = data
        quote = self.data == QUOTE
        if json and (self.data == BACKSLASH).any():  # a quote after an odd run of backslashes is text
            place = np.arange(len(self.data))
            other = np.maximum.accumulate(np.where(self.data != BACKSLASH, place, -1))
            run = place[1:] - 1 - other[:-1]
            quote[1:] &= run % 2 == 0
        self.quotes = np.cumsum(quote)
        self.turn = np.zeros(len(self.data), dtype=np.int64)
        if json:
            self.turn += np.isin(self.data, OPENS)
            self.turn -= np.isin(self.data, CLOSES)

    def depth(self, start_quotes: int) -> np.ndarray:
        """Change of the depth up to and with each byte, if the text starts after that many
        quotes."""
        return np.cumsum(np.where((self.quotes + start_quotes) % 2 == 0, self.turn, 0))


def _runs(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Stretches of rows that agree in all keys."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    starts = [0, *np.flatnonzero(new).tolist(), n] if n else []
    yield from zip(starts[:-1], starts[1:])


def block_effects(found: DataFrame, separator: str, json: bool) -> DataFrame:
    """One row per block: its number of quotes, its change of depth if it starts outside (depth0)
    or inside (depth1) of quotes, and its first character that is no white space."""
    mark = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            file, block = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
            for start, end in _runs([file.indices.to_numpy(), block]):
                text = _Text(batch.column(0).slice(start, end - start), mark, json)
                key = (file[start].as_py(), int(block[start]))
                q, d0, d1, opens = held.get(key, (0, 0, 0, ""))
                change = [int(text.depth(s)[-1]) for s in (q, q + 1)]
                lead = opens or text.data[:4096].tobytes().decode("utf-8", "ignore").lstrip("\ufeff \t\r\n")[:1]
                held[key] = (q + int(text.quotes[-1]), d0 + change[0], d1 + change[1], lead)
        rows = [(*key, *effect) for key, effect in held.items()]
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.string(), *[pa.int64()] * 4, pa.string()]
        names = [c.split(" ")[0] for c in _EFFECT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return found.select("value", "file", "block").mapInArrow(run, _EFFECT)


def block_states(effects: DataFrame) -> DataFrame:
    """_block (a number), _file, _start, _quotes (0 or 1), _depth and _opens (of the file): the
    state in which each block starts. One task sees the small rows of one file, not its text."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    known = effects.withColumn("_quotes", quotes)
    change = F.when(F.col("_quotes") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    opens = F.first(F.when(F.col("opens") != "", F.col("opens")), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    states = known.withColumn("_change", change).select(
        F.col("file").alias("_file"), F.col("block").alias("_start"), F.col("_quotes").cast("long"),
        F.coalesce(F.sum("_change").over(before), F.lit(0)).cast("long").alias("_depth"), opens.alias("_opens"),
        F.xxhash64("file", "block").alias("_block"),
    )
    return written(states, "block-states")


def with_states(found: DataFrame, states: DataFrame, few: bool) -> DataFrame:
    """The fragments with the state of their block, in order within each block.

    A `few` states go to the scan tasks, which read in order, so no text moves; a larger table
    is joined as Spark sees fit, and blocks are put in order again."""
    same = (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_start"))
    if few:
        return found.join(F.broadcast(states), same)
    return found.join(states, same).sortWithinPartitions("_block", "_row")


def _cut(states: DataFrame, separator: str, json: bool) -> DataFrame:
    """_block, part and value: the whole records of every block and the pieces at its ends."""
    mark = separator.encode()
    names = ["_block", "part", "value"]

    def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        block, part, value = zip(*rows) if rows else ([], [], [])
        text = pa.array([v.decode("utf-8", "replace") for v in value], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int32()), text], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, quotes, depth, array, first, over, open_ = None, 0, 0, False, True, False, b""
        out: list[tuple[int, int, bytes]] = []

        def close() -> None:  # what is open at the end of a block
            if open_ and not over:
                out.append((block, MIDDLE if first else TAIL, open_))

        for batch in batches:
            ids = batch.column(1).to_numpy()
            for start, end in _runs([ids]):
                if ids[start] != block:
                    close()
                    block, open_, first, over = int(ids[start]), b"", True, False
                    quotes, depth = (batch.column(c)[start].as_py() for c in (2, 3))
                    array = json and batch.column(4)[start].as_py() == "["
                if over:
                    continue
                text = _Text(batch.column(0).slice(start, end - start), mark, json)
                data, ends = text.data.tobytes(), text.ends
                outside = (text.quotes[ends] + quotes) % 2 == 0
                if json:
                    level = depth + text.depth(quotes)
                    # before the separator that is taken for granted: 0 is the end of the array
                    done = np.flatnonzero((level[ends] + outside == 0) & outside) if array else np.zeros(0, int)
                    stop = outside & (level[ends] == 1) if array else np.zeros(len(ends), dtype=bool)
                    depth = int(level[-1])
                else:
                    done, stop = np.zeros(0, int), outside
                quotes = (quotes + int(text.quotes[-1])) % 2
                at = 0
                last = int(done[0]) if len(done) else len(ends)
                for k in np.flatnonzero(stop[:last]).tolist():
                    place = int(ends[k]) + (1 if json else 0)
                    out.append((block, HEAD if first else WHOLE, open_ + data[at:place]))
                    open_, first, at = b"", False, int(ends[k]) + 1
                if len(done):
                    out.append((block, HEAD if first else WHOLE, open_ + data[at : int(ends[last])]))
                    over = True
                else:
                    open_ += data[at:]
            if len(out) >= 4096:
                yield batch_of(out)
                out.clear()
        close()
        yield batch_of(out)

    slim = states.select("value", "_block", "_quotes", "_depth", F.col("_opens"))
    return slim.mapInArrow(run, _PART)


def record_texts(spark: SparkSession, paths: str | list[str], separator: str, json: bool) -> DataFrame:
    """value (the text of a record), _opens (the first character of its file) and _record: for
    the first record of a file 0, for others null or more.

    Records inside a block are cut where they are read; of those that cross blocks the pieces
    meet. The first record of every block counts as one that may have begun before."""
    found = fragments(spark, paths, separator)
    states = block_states(block_effects(found, separator, json))
    few = states.count() <= SENT_BLOCKS
    parts = _cut(with_states(found, states, few), separator, json)
    opens = states.select("_block", "_opens")
    whole = parts.filter(F.col("part") == WHOLE).join(F.broadcast(opens) if few else opens, "_block")
    pieces = written(parts.filter(F.col("part") != WHOLE), "pieces")
    # a block with an end in it starts a new record there; pieces of one record share the count
    ends = pieces.groupBy("_block").agg(F.max((F.col("part") == HEAD).cast("int")).alias("_ends"))
    order = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.coalesce("_ends", F.lit(0))
    counts = states.join(ends, "_block", "left").select(
        "_block", "_file", "_start", "_opens", F.sum(own).over(order).alias("_count"), own.alias("_ends")
    )
    record = F.col("_count") - F.when(F.col("part") == TAIL, 0).otherwise(F.col("_ends"))
    piece = F.struct("_start", (F.col("part") == TAIL).alias("tail"), "value")
    crossing = (
        pieces.join(counts, "_block")
        .groupBy("_file", "_opens", record.alias("_record"))
        .agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
        .select(F.concat_ws("", "_pieces.value").alias("value"), "_opens", "_record")
    )
    return whole.select("value", "_opens", F.lit(None).cast("long").alias("_record")).unionByName(crossing)


def read_json_array(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Records of files that hold one JSON array each; a large file is read by many tasks.

    A file that holds one object is one record. A record that cannot be read is a row of nulls,
    and those around it are not lost. Blank files and empty arrays hold no record."""
    texts = record_texts(spark, paths, "}", True)
    array = F.col("_opens") == "["
    bare = F.regexp_replace(F.regexp_replace("value", r"^[\uFEFF\s]*[\[,]?\s*", ""), r"\s*\]?\s*$", "")
    text = F.when(array, bare).otherwise(F.regexp_replace("value", r"^[\uFEFF\s]+", ""))
    listed = texts.select(text.alias("_t"), array.alias("_a")).filter(~F.col("_t").isin("", "}"))
    items = F.from_json(F.concat(F.lit("["), F.col("_t"), F.lit("]")), T.ArrayType(schema))
    one = F.array(F.from_json("_t", schema))
    each = listed.select(F.explode_outer(F.when(F.col("_a"), items).otherwise(one)).alias("_r"))
    return each.select(*[F.col("_r")[f.name].alias(f.name) for f in schema])


def read_quoted_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Records of CSV files with a header, whose quoted fields may hold line ends; a large file
    is read by many tasks.

    Quotes inside fields stand doubled, and a field with a quote in it is quoted as a whole. The
    first record of every file is its header and must name the columns in the schema's order.
    Empty lines between records are skipped, and line ends inside quotes stay as they are."""
    line = F.regexp_replace("value", "\r$", "").alias("_t")
    rows = record_texts(spark, paths, "\n", False).filter(F.coalesce("_record", F.lit(1)) > 0).select(line)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    each = rows.filter(F.col("_t") != "").select(F.from_csv("_t", fields, {"escape": '"'}).alias("_r"))
    return each.select(*[F.col("_r")[f.name].alias(f.name) for f in schema])
