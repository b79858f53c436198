"""Writers. All of them write from the tasks; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_split_json(records: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines per split and category. Without `append` a rerun replaces just the
    categories that it writes."""
    writer = records.write.partitionBy("split", "category")
    if append:
        writer.mode("append").json(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def write_documents(documents: DataFrame, path: str, column: str = "document") -> None:
    """One JSON document per line."""
    documents.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def keyed_json(rows: DataFrame, key: str) -> DataFrame:
    """One line `{key: {fields}}` per row."""
    fields = F.struct(*[c for c in rows.columns if c != key])
    entry = F.create_map(F.col(key).cast("string"), fields)
    return rows.select(F.to_json(entry, {"ignoreNullFields": "false"}).alias("value"))


def write_keyed_json(rows: DataFrame, key: str, path: str) -> None:
    keyed_json(rows, key).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    """CSV with a header; quotes inside fields stand doubled."""
    mode = "append" if append else "overwrite"
    rows.write.mode(mode).options(header=True, escape='"', quote='"', emptyValue="").csv(path)


def write_fanout(rows: DataFrame, path: str, source: str = "source") -> None:
    """Rows back to one folder per source file, named after it with `_enriched`."""
    name = F.regexp_replace(F.element_at(F.split(source, "/"), -1), r"\.jsonl$", "_enriched")
    rows.withColumn("target", name).drop(source).write.partitionBy("target").mode("overwrite").json(path)


def write_cache(cache: DataFrame, path: str) -> None:
    """A new version of a cache. Write it to a path of its own: a table that is being read
    cannot be overwritten."""
    cache.write.mode("error").parquet(path)


def write_snapshot(rows: DataFrame, root: str, start: int, end: int, number: int) -> str:
    """Progress of a row range, as a numbered snapshot."""
    path = f"{root.rstrip('/')}/snapshot_{start}_{end}_{number}"
    rows.write.mode("error").parquet(path)
    return path
