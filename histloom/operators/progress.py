"""Enrichment with snapshots while work runs: what a task has finished survives the task.

Calls to a model service are slow and paid for, so a task that is lost midway must not repeat
them. Rows go to ranges by a hash of their key. A task works through a range and commits its
results every few rows in two steps: a data file under (range, attempt, number), which nobody
reads yet, and then an entry in the manifest that names it, moved into place in one step. Only
what the manifest names counts. A task that starts on a range reads its entries first and leaves
the committed keys out, whether it is a retry after a lost executor or a new run after a lost
driver; data files without an entry are never read.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histloom.operators.enrich import one_call
from histloom.operators.lookups import not_done

EVERY = 100
RANGE_ROWS = 10_000
_WHERE = "_range long, _attempt string, _number long"


def _schema(kind: str, key: str) -> T.StructType:
    return T.StructType.fromDDL(f"`{key}` {kind}, value string, status string, error string, {_WHERE}")


def _folders(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that driver and executors reach, and its path there."""
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


def commit(system: fs.FileSystem, root: str, rows: pa.Table, place: int, attempt: str, number: int) -> None:
    """Write `rows` and name them in the manifest. A writer that is lost in between leaves a data
    file that does not count; the entry appears whole or not at all."""
    data = f"{root}/data/{place}-{attempt}-{number}.parquet"
    n = rows.num_rows
    where = {"_range": pa.array([place] * n, pa.int64()), "_attempt": [attempt] * n, "_number": pa.array([number] * n, pa.int64())}
    for name, column in where.items():
        rows = rows.append_column(name, pa.array(column) if isinstance(column, list) else column)
    with system.open_output_stream(data) as out:
        pq.write_table(rows, out)
    folder = f"{root}/manifest/{place}"
    system.create_dir(folder, recursive=True)
    entry = {"_range": place, "_attempt": attempt, "_number": number, "rows": n, "file": data.rpartition("/")[2]}
    unseen = f"{root}/started/{place}-{attempt}-{number}"
    with system.open_output_stream(unseen) as out:
        out.write(json.dumps(entry).encode() + b"\n")
    system.move(unseen, f"{folder}/{attempt}-{number}.json")


def committed_keys(system: fs.FileSystem, root: str, place: int, key: str) -> set:
    """The keys of one range that count as done."""
    entries = system.get_file_info(fs.FileSelector(f"{root}/manifest/{place}", allow_not_found=True))
    done: set = set()
    for info in entries:
        with system.open_input_stream(info.path) as source:
            name = json.loads(source.read())["file"]
        with system.open_input_file(f"{root}/data/{name}") as source:
            done.update(pq.read_table(source, columns=[key]).column(0).to_pylist())
    return done


def progress(spark: SparkSession, root: str, key: str, kind: str) -> DataFrame:
    """key, value, status and error of everything committed under `root`, once per commit, with
    the place of the commit (_range, _attempt, _number)."""
    data = spark.read.schema(_schema(kind, key)).parquet(f"{root}/data")
    named = spark.read.schema(_WHERE).option("recursiveFileLookup", True).json(f"{root}/manifest")
    return data.join(named, ["_range", "_attempt", "_number"], "left_semi")


def results(spark: SparkSession, root: str, key: str, kind: str) -> DataFrame:
    """One row per committed key. Two attempts that ran side by side may both have committed a
    key; the one with the lower number, then name, counts, in every reading."""
    first = F.min_by(F.struct("value", "status", "error"), F.struct("_number", "_attempt")).alias("_r")
    return progress(spark, root, key, kind).groupBy(key).agg(first).select(key, "_r.value", "_r.status", "_r.error")


def enrich_with_progress(
    rows: DataFrame,
    key: str,
    text: str,
    fn: Callable[[str], str],
    root: str,
    every: int = EVERY,
    threads: int = 1,
    ranges: int | None = None,
) -> DataFrame:
    """`operators.enrich.enrich` with snapshots under `root`: (key, value, status, error).

    Runs the calls that no earlier run has committed, each range committing every `every` rows,
    and returns all results. If the job fails, what was committed stays, and calling this again
    goes on from there; `ranges` may then be another number. `root` must be a folder that driver
    and executors reach under one name and that Arrow can open. Keys are unique: of rows that
    repeat one, some row is used. A null key is a key. Blank texts and exceptions give error
    rows, as in `enrich`.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    system, path = _folders(root)
    for name in ("data", "manifest", "started"):
        system.create_dir(f"{path}/{name}", recursive=True)
    todo = not_done(rows.select(key, text), progress(spark, root, key, kind), [key])
    if ranges is None:
        ranges = max(spark.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    placed = todo.select(F.pmod(F.xxhash64(key), F.lit(ranges)).alias("_range"), key, text)
    arrow = placed.limit(0).toArrow().schema.field(key).type

    def work(place: int, pairs: Iterator[tuple], attempt: str, pool: ThreadPoolExecutor) -> int:
        done = committed_keys(system, path, place, key)
        number = called = 0
        while True:
            some: dict = {}
            for name, value in pairs:
                if name not in done and name not in some:
                    some[name] = value
                if len(some) == every:
                    break
            if not some:
                return called
            answers = list(pool.map(lambda value: one_call(fn, value), some.values()))
            done.update(some)
            columns = [pa.array(list(some), arrow), *[pa.array(list(c), pa.string()) for c in zip(*answers)]]
            commit(system, path, pa.table(columns, names=[key, "value", "status", "error"]), place, attempt, number)
            number, called = number + 1, called + len(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex
        each = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in range(3))))
        with ThreadPoolExecutor(threads) as pool:
            for place, group in itertools.groupby(each, key=lambda row: row[0]):
                called = work(place, ((row[1], row[2]) for row in group), attempt, pool)
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([called], pa.int64())], names=["_range", "called"])

    dealt = placed.repartition(ranges, "_range").sortWithinPartitions("_range")
    dealt.mapInArrow(run, "_range long, called long").write.format("noop").mode("overwrite").save()
    return results(spark, root, key, kind)
