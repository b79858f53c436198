"""Exact duplicates by a tree merge of sorted digest runs; DataFrame functions only.

Every row belongs to a run, a hash of its id. A run holds each digest once, with the smallest
id and the number of its rows. Runs are then merged in binomial rounds: in each round
`2**ROUND_BITS` neighbouring runs become one, and the merged run is cut by as many more digest
prefixes, so that the number of (run, slice) cells, and with it the parallelism, stays the same
from the first round to the last. Each round is one exchange of unique digests, a multiway merge
of the runs that arrive (a sort by cell, digest and id that the plan cannot drop), and one pass
in that order: of each stretch of equal digests the first row, which has the smallest id, stays
with the sum of their counts. The number of runs grows with the table. The way back goes by
(run, digest), so the rows of one huge group of copies are looked up in as many cells as there
are runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histloom.llm.names import free_name
from histloom.session import written

#: Runs of a table of up to CELL_ROWS rows a run; larger ones take another round of ROUND_BITS.
RUN_BITS = 8
ROUND_BITS = 4
CELL_ROWS = 1 << 16
SPACE = r"[\x20\x09-\x0D]+"
KEY = ("digest", "proof")


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def run_bits(rows: int) -> int:
    """Bits of the run number for a table of so many rows: whole rounds, RUN_BITS at least."""
    bits = RUN_BITS
    while rows >> bits > CELL_ROWS:
        bits += ROUND_BITS
    return bits


def run_of(doc_id: Column, bits: int = RUN_BITS) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), doc_id), F.lit(1 << bits)).cast("int")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, run, digest (SHA-256) and proof: length and a second, independent hash of the text.

    Rows are equal only if digest and proof are, so every merge checks the match anew.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    return rows.select(
        "_id",
        run_of(F.col("_id")).alias("run"),
        F.unhex(F.sha2("_text", 256)).alias("digest"),
        F.struct(F.length("_text").alias("n"), F.xxhash64("_text").alias("h")).alias("proof"),
    )


def leaf_runs(rows: DataFrame) -> DataFrame:
    """One row per run and digest. Copies meet in the map task first, so a hot digest is small."""
    return rows.groupBy("run", *KEY).agg(
        F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def merge_runs(level: DataFrame, bits: int = RUN_BITS) -> DataFrame:
    """Merge the runs of `leaf_runs` round by round to one row per digest of the whole table."""
    prefix = F.conv(F.substring(F.hex("digest"), 1, bits // 4), 16, 10).cast("int")
    stretch = Window.partitionBy("run", "slice", *KEY).orderBy(F.col("keep_id").asc_nulls_last())
    whole = stretch.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for done in range(ROUND_BITS, bits + 1, ROUND_BITS):
        cut = F.shiftright(prefix, bits - done)
        level = (
            level.withColumn("run", F.shiftright("run", ROUND_BITS))
            .withColumn("slice", cut)
            .repartition("run", "slice")
            .withColumns({"at": F.row_number().over(stretch), "group_size": F.sum("group_size").over(whole)})
            .filter("at = 1")
            .drop("at")
        )
    return level.select(*KEY, "keep_id", "group_size")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts, and all empty texts are one group. Null ids are never the
    smallest unless a group has no other: then keep_id is null and its rows are kept. Rows that
    repeat id and text are the same row: they count in group_size and get the same answer.
    Other columns of `docs` are not read. An empty table gives no rows.
    """
    rows = written(digest_rows(docs, id_col, text_col), "digests")
    bits = run_bits(rows.count())
    rows = rows.withColumn("run", run_of(F.col("_id"), bits))
    leaves = leaf_runs(rows)
    copies = merge_runs(leaves, bits).filter(F.col("group_size") > 1)
    found = leaves.select("run", *KEY).join(copies, list(KEY))
    joined = rows.join(found, ["run", *KEY], "left")
    single = F.col("group_size").isNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(single, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns as they were; of repeated rows one stays.

    The rows to drop are matched by id and digest, so a row that shares its id with a dropped
    one, but not its text, stays.
    """
    classes = exact_classes(docs, id_col, text_col).select(
        F.col(id_col).alias("_drop_id"), F.col("text_sha256").alias("_drop_sha"), "kept"
    )
    classes = written(classes, "exact-classes")
    digest = F.sha2(normalised(F.col(f"`{text_col}`")), 256)

    def same(other: DataFrame):
        return docs[id_col].eqNullSafe(other["_drop_id"]) & (digest == other["_drop_sha"])

    dropped = classes.filter(~F.col("kept"))
    stay = docs.join(dropped, same(dropped), "left_anti")
    again = classes.filter("kept").groupBy("_drop_id", "_drop_sha").count().filter("count > 1")
    if again.isEmpty():
        return stay
    key = free_name(docs, "_key")
    row = F.struct(F.col(f"`{id_col}`"), digest)
    twice = stay.join(again, same(again), "left_semi").withColumn(key, row)
    return stay.join(again, same(again), "left_anti").unionByName(twice.dropDuplicates([key]).drop(key))
