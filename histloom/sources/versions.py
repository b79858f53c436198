"""Tables that are updated by key without rewriting them: deltas, versions, merge on read.

An update writes its own rows only, one folder per update and one subfolder per part (a coarse
piece of the key, such as the month of a day). A version is a small file that lists the
subfolders which make up the table; it appears whole, under the next number, or not at all, and
files that a version lists are never changed. A reader takes the newest version and keeps it, so
an update that runs meanwhile does not show. Of rows with the same key the one from the latest
update counts. `compact` merges the parts that have collected many deltas and leaves the others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_DELTAS = 8
_ORDER = r"/data/(\d+)-[0-9a-f]+/"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, root: str) -> int:
    """The number of the newest version; 0 if there is none yet."""
    path, files = _path(spark, f"{root}/versions")
    if not files.exists(path):
        return 0
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return max((int(name) for name in names if name.isdigit()), default=0)


def listed(spark: SparkSession, root: str, version: int) -> list[dict]:
    """What a version consists of: `folder` and `part`, one entry per subfolder."""
    if not version:
        return []
    lines = spark.read.text(f"{root}/versions/{version:010d}").collect()
    return [json.loads(line.value) for line in lines]


def _publish(spark: SparkSession, root: str, version: int, entries: Sequence[dict]) -> bool:
    """Make `entries` the version of this number; False if another writer took the number."""
    hidden, files = _path(spark, f"{root}/versions/_{uuid.uuid4().hex}")
    out = files.create(hidden, False)
    out.write("".join(json.dumps(entry) + "\n" for entry in entries).encode())
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    target, _ = _path(spark, f"{root}/versions/{version:010d}")
    try:
        context.rename(hidden, target, none)  # never over an existing file
    except Py4JJavaError as error:
        files.delete(hidden, False)
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def _write(rows: DataFrame, root: str, order: int, part: Column) -> tuple[str, list[str]]:
    """`rows` in a new folder, a subfolder per part, and the names of the parts."""
    spark, folder = rows.sparkSession, f"{order:010d}-{uuid.uuid4().hex}"
    named = rows.withColumn("_part", F.coalesce(part.cast("string"), F.lit("none")))
    named.repartition("_part", F.pmod(F.xxhash64(*_plain(rows)), F.lit(16))).write.partitionBy("_part").parquet(f"{root}/data/{folder}")
    path, files = _path(spark, f"{root}/data/{folder}")
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return folder, sorted(name for name in names if name.startswith("_part="))


def _plain(rows: DataFrame) -> list[str]:
    return [f"`{name}`" for name, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]


def _merged(spark: SparkSession, root: str, entries: Sequence[dict], schema: str | T.StructType, keys: Sequence[str]) -> DataFrame:
    """The rows of the listed subfolders, for every key that of the latest update."""
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not entries:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{root}/data/{e['folder']}/{e['part']}" for e in entries])
    if len({e["part"] for e in entries}) == len(entries):
        return rows  # no part has a second delta
    order = F.regexp_extract("_metadata.file_path", _ORDER, 1).cast("long")
    fields = F.struct(*[F.col(f"`{name}`") for name in schema.names])
    newest = rows.groupBy(*keys).agg(F.max_by(fields, order).alias("_row"))
    return newest.select("_row.*")


def read_version(
    spark: SparkSession, root: str, schema: str | T.StructType, keys: Sequence[str],
    version: int | None = None, parts: Sequence[str] | None = None,
) -> DataFrame:
    """The table at its newest or a given version; an empty one before the first update. With
    `parts` only those parts are read."""
    entries = listed(spark, root, latest(spark, root) if version is None else version)
    if parts is not None:
        entries = [e for e in entries if e["part"] in {f"_part={p}" for p in parts}]
    return _merged(spark, root, entries, schema, keys)


def upsert(rows: DataFrame, root: str, part: Column) -> int:
    """Add `rows` (one per key) as the next version: keys that are new come in, others take the
    new row. Only `rows` are written. Returns the number of the version.

    `part` is a function of the key whose values need no escaping in a file name, so that a key
    stays in its part. Of two updates at a time, the one that publishes last is the later one:
    its folder takes the next number.
    """
    spark = rows.sparkSession
    number = latest(spark, root) + 1
    folder, parts = _write(rows, root, number, part)
    while True:
        entries = listed(spark, root, number - 1) + [{"folder": folder, "part": p} for p in parts]
        if _publish(spark, root, number, entries):
            return number
        number = latest(spark, root) + 1
        later = f"{number:010d}-{uuid.uuid4().hex}"
        old, files = _path(spark, f"{root}/data/{folder}")
        files.rename(old, _path(spark, f"{root}/data/{later}")[0])
        folder = later


def compact(
    spark: SparkSession, root: str, schema: str | T.StructType, keys: Sequence[str], part: Column,
    most_deltas: int = MOST_DELTAS,
) -> int:
    """Merge the parts with more than `most_deltas` deltas into one each, as a new version; the
    number of the newest version. Updates that come in between stay later than the merged rows."""
    version = latest(spark, root)
    entries = listed(spark, root, version)
    deltas: dict[str, int] = {}
    for e in entries:
        deltas[e["part"]] = deltas.get(e["part"], 0) + 1
    full = [e for e in entries if deltas[e["part"]] > most_deltas]
    if not full:
        return version
    folder, parts = _write(_merged(spark, root, full, schema, keys), root, version, part)
    while True:
        now = latest(spark, root)
        current = listed(spark, root, now)
        if any(e not in current for e in full):
            return now  # another compaction has merged them
        new = [e for e in current if e not in full] + [{"folder": folder, "part": p} for p in parts]
        if _publish(spark, root, now + 1, new):
            return now + 1


def clean(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove versions before the newest `keep` and the subfolders that only they list; how many
    subfolders went. Not while a reader uses a removed version."""
    newest = latest(spark, root)
    first = max(1, newest - keep + 1)

    def named(numbers):
        return {(e["folder"], e["part"]) for n in numbers for e in listed(spark, root, n)}

    path, files = _path(spark, f"{root}/versions")
    there = sorted(int(s.getPath().getName()) for s in files.listStatus(path) if s.getPath().getName().isdigit())
    gone = named(n for n in there if n < first) - named(n for n in there if n >= first)
    for n in there:
        if n < first:
            files.delete(_path(spark, f"{root}/versions/{n:010d}")[0], False)
    for folder, part in gone:
        files.delete(_path(spark, f"{root}/data/{folder}/{part}")[0], True)
    return len(gone)
