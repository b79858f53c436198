"""Chat conversations as a forest of shared turns, laid out depth-first.

A node is a turn together with all turns before it, so conversations that begin alike share
their first nodes and every shared turn is written once. Nodes that follow each other without a
branch are one run; a path names the runs from the first turn on, not every turn, so a long
conversation costs no more than its length. Nodes get their place in one sequence by depth-first
order, found by sorting paths in ranges, not by walking a tree in one task: a first turn that a
third of all conversations share is one row. Each node says which position its first token has
in its own conversation, and which intervals of the sequence (the runs above it and its own up
to it) it attends to besides itself. Tokens are code points of the formatted text.

The template writes a turn as `### role: text</turn>` and a line end. Inside roles and texts the
signs that control strings need are replaced by a backslash and a letter, so no control string
can occur there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histloom.session import written

OPEN, CLOSE = "### ", "</turn>\n"
_TURN = re.compile(r"### ([^:#<]*): ([^#<]*)</turn>\n")
_ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
_ROLE_ESCAPES = str.maketrans(_ESCAPES | {":": "\\c"})
_TEXT_ESCAPES = str.maketrans(_ESCAPES)
_SIGNS = {"\\": "\\", "h": "#", "l": "<", "c": ":"}
ROWS_AT_ONCE = 256


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _SIGNS[m[1]], text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its escaped text starts and ends in it."""
    head, body = f"{OPEN}{role.translate(_ROLE_ESCAPES)}: ", text.translate(_TEXT_ESCAPES)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; anything else is an error."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"not a turn at {at}: {formatted[at : at + 80]!r}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def turn_lists(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """_id and turns: one row per conversation, its turns in order."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    named = conversations.select(F.col(f"`{id_col}`").alias("_id"), turn.alias("t"))
    return named.groupBy("_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _steps(turns: list[dict]) -> Iterator[tuple[bytes, bytes, str, int, int]]:
    """Key of the node before, own key, formatted turn and the bounds of its text, for each turn.

    A key stands for the turn and all turns before it.
    """
    before = b""
    for turn in turns:
        formatted, begin, end = format_turn(turn["role"], turn["text"])
        key = hashlib.sha256(before + formatted.encode("utf-8", "surrogatepass")).digest()[:16]
        yield before, key, formatted, begin, end
        before = key


def _map(lists: DataFrame, rows_of, kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Rows of `rows_of(*row)` for each row of `lists`, in batches of a few input rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                columns = [c.slice(at, ROWS_AT_ONCE).to_pylist() for c in batch.columns]
                rows = [r for row in zip(*columns) for r in rows_of(*row)]
                found = list(zip(*rows)) or [[]] * len(kinds)
                arrays = [pa.array(list(c), k) for c, k in zip(found, kinds.values())]
                yield pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    return lists.mapInArrow(run, schema)


def turn_keys(lists: DataFrame) -> DataFrame:
    """row, depth, key and before (the key of the node before) of every turn."""

    def rows_of(row, turns):
        return ((row, d, key, before) for d, (before, key, *_) in enumerate(_steps(turns)))

    kinds = {"row": pa.int64(), "depth": pa.int32(), "key": pa.binary(), "before": pa.binary()}
    return _map(lists.select("row", "turns"), rows_of, kinds, "row long, depth int, key binary, before binary")


def run_heads(keys: DataFrame) -> DataFrame:
    """row and heads: (depth, key) of the turns of a conversation that begin a run, in order.

    A run begins at a first turn, and after a node that different turns follow.
    """
    branching = (
        keys.filter("depth > 0").select("before", "key").distinct()
        .groupBy("before").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("before")
    )
    later = keys.filter("depth > 0").join(branching, "before", "left_semi")
    heads = keys.filter("depth = 0").select("row", "depth", "key").union(later.select("row", "depth", "key"))
    return heads.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("depth", "key"))).alias("heads"))


_NODE = {
    "key": pa.binary(), "path": pa.binary(), "depth": pa.int32(), "position": pa.int64(), "text": pa.string(),
    "loss_start": pa.int32(), "loss_end": pa.int32(),
}


def tree_nodes(lists: DataFrame, heads: DataFrame, loss_role: str) -> DataFrame:
    """The distinct nodes of all conversations: key, path (the first keys of the runs from the
    first turn on, the last one its own run), depth, position, text, and the part of the text
    under the loss mask."""

    def rows_of(turns, heads):
        begins = {h["depth"]: h["key"] for h in heads}
        path, position = b"", 0
        for depth, (turn, (_, key, text, begin, end)) in enumerate(zip(turns, _steps(turns))):
            path += begins.get(depth, b"")
            loss = (begin, end) if turn["role"] == loss_role else (0, 0)
            yield key, path, depth, position, text, *loss
            position += len(text)

    schema = "key binary, path binary, depth int, position long, text string, loss_start int, loss_end int"
    nodes = _map(lists.join(heads, "row").select("turns", "heads"), rows_of, _NODE, schema)
    return nodes.groupBy("key").agg(*[F.first(c).alias(c) for c in list(_NODE)[1:]])


def lay_out(nodes: DataFrame) -> DataFrame:
    """Nodes with `start` and `end` in the depth-first sequence.

    Rows are sorted by path and depth over ranges and written, so that each range keeps its rows;
    the running length within a range is added to the lengths of all ranges before it.
    """
    ranged = nodes.repartitionByRange("path", "depth").sortWithinPartitions("path", "depth")
    ranged = written(ranged.withColumn("range", F.spark_partition_id()), "chat-ranges")
    length = F.length("text").cast("long")
    lengths = ranged.groupBy("range").agg(F.sum(length).alias("length"))
    before = F.sum("length").over(Window.orderBy("range")) - F.col("length")  # one row per range
    offsets = lengths.select("range", before.alias("offset"))
    upto = F.sum(length).over(Window.partitionBy("range").orderBy("path", "depth"))
    placed = ranged.withColumn("upto", upto).join(offsets, "range")
    end = F.col("offset") + F.col("upto")
    return placed.select(*nodes.columns, (end - length).alias("start"), end.alias("end"))


def with_attention(placed: DataFrame) -> DataFrame:
    """Nodes with `run_start` and `attends`: the (start, end) of every run above, and of their own
    run up to them, from the first turn on."""
    own = F.substring(F.col("path"), F.length("path") - 15, F.lit(16))
    runs = placed.groupBy("path").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.select(own.alias("run"), "path", "start", "end")
    count = (F.length("path") / 16).cast("int")
    above = F.when(
        count > 1, F.transform(F.sequence(F.lit(0), count - 2), lambda i: F.substring(F.col("path"), i * 16 + 1, F.lit(16)))
    )
    asked = runs.select(F.col("run").alias("below"), F.explode(above).alias("run"))
    spans = asked.join(runs.select("run", "start", "end"), "run")
    over = spans.groupBy(F.col("below").alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("above")
    )
    known = runs.select("run", F.col("start").alias("run_start")).join(over, "run", "left")
    rows = placed.withColumn("run", own).join(known, "run")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    within = F.struct(F.col("run_start").alias("start"), F.col("start").alias("end"))
    attends = F.concat(F.coalesce("above", none), F.when(F.col("start") > F.col("run_start"), F.array(within)).otherwise(none))
    return rows.withColumn("attends", attends).drop("run", "above")


def pack(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", loss_role: str = "assistant",
) -> tuple[DataFrame, DataFrame]:
    """The packed nodes (key, depth, position, start, end, run_start, text, loss_start, loss_end,
    attends) and the last node of each conversation (row, its number; id; key).

    Sorted by `start`, the texts are the sequence; the token at `start + i` has position id
    `position + i` and attends to `attends` and to `start ... start + i`. Null roles and texts
    are empty; turns are ordered by number, then role and text, null numbers first. Rows with a
    null id are one conversation. Equal conversations share all their nodes. One conversation
    is one row of work. Extra columns are not read. An empty table gives no rows.
    """
    lists = turn_lists(conversations, id_col, turn_col, role_col, text_col)
    lists = written(lists.withColumn("row", F.monotonically_increasing_id()), "chat-turns")
    keys = written(turn_keys(lists), "chat-keys")
    nodes = tree_nodes(lists, run_heads(keys), loss_role)
    packed = with_attention(written(lay_out(nodes), "chat-nodes")).drop("path")
    last = keys.groupBy("row").agg(F.max_by("key", "depth").alias("key"))
    return packed, lists.select("row", F.col("_id").alias(id_col)).join(last, "row")


def read_back(packed: DataFrame, leaves: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Every conversation out of the packed nodes: id, turns (role, text), loss (the texts under
    the loss mask) and formatted_chars.

    A conversation is what its last node attends to, and that node. All its intervals begin
    where a run begins, so the nodes in them are found by that place.
    """
    self_too = F.struct(F.col("run_start").alias("start"), F.col("end").alias("end"))
    spans = F.concat(F.filter("attends", lambda s: s["start"] < F.col("run_start")), F.array(self_too))
    leaf = leaves.join(packed.select("key", spans.alias("spans")), "key")
    asked = leaf.select("row", id_col, F.explode("spans").alias("s")).select(
        "row", id_col, F.col("s.start").alias("run_start"), F.col("s.end").alias("upto")
    )
    text = packed.select("run_start", "end", "position", "text", "loss_start", "loss_end")
    parts = asked.join(text, "run_start").filter(F.col("end") <= F.col("upto"))
    rows = parts.groupBy("row", id_col).agg(
        F.sort_array(F.collect_list(F.struct("position", "text", "loss_start", "loss_end"))).alias("parts")
    )
    kind = leaves.schema[id_col].dataType.simpleString()
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                turns, loss, chars = [], [], []
                for parts in some.column(1).to_pylist():
                    formatted = "".join(p["text"] for p in parts)
                    turns.append([{"role": r, "text": t} for r, t in parse_turns(formatted)])
                    masked = [p["text"][p["loss_start"] : p["loss_end"]] for p in parts if p["loss_end"]]
                    loss.append([unescape(m) for m in masked])
                    chars.append(len(formatted))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0), pa.array(turns, pa.list_(turn)), pa.array(loss, pa.list_(pa.string())),
                        pa.array(chars, pa.int64()),
                    ],
                    names=[id_col, "turns", "loss", "formatted_chars"],
                )

    schema = f"`{id_col}` {kind}, turns array<struct<role:string,text:string>>, loss array<string>, formatted_chars long"
    return rows.select(id_col, "parts").mapInArrow(run, schema)


def digests(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return conversations.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
