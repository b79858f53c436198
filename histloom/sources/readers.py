"""Readers. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histloom import constants as K
from histloom.functions.nested import STRICT, get, has, json_object, valid_json
from histloom.functions.text import first_nonempty, strip
from histloom.operators.lookups import merged
from histloom.plans.runs import without_attachments
from histloom.session import written
from histloom.sources import blocks

Schema = T.StructType | str
Paths = str | list[str]

_REVIEW = (
    "parent_asin string, rating double, timestamp_ms long, review_excerpt string, review_full string, "
    "review_title string, product struct<title:string,brand:string,price:double,main_category:string>"
)
REVIEWS = "user_id string, parent_asin string, timestamp long, rating double, title string, text string"
FIVE_CORE = "user_id string, parent_asin string, rating double, timestamp long"
USER_SPLIT = (
    f"user_id string, category string, history array<struct<{_REVIEW}>>, heldout struct<{_REVIEW}>, "
    "selection_month string, psych_vector map<string,double>"
)
PERSONAS = "user_id string, persona string"
POSTS = "author string, subreddit string, content string, body string"
COMMUNITY_USERS = (
    "user_id string, subreddits array<string>, history array<struct<subreddit:string,posts:array<string>>>"
)
COMMUNITY_INSTANCES = (
    "user_id string, subreddit string, posts array<string>, "
    "anchor_demographics struct<age:string,gender:string,occupation:string,location:string>, "
    "shift_vector map<string,double>, target_vector map<string,double>"
)
INTERACTIONS = (
    "user_id string, gold_persona string, interactions array<struct<session_id:string,asin:string,"
    "title:string,price:string,options:string,type:string>>"
)
CACHE = "date date, vector map<string,double>"


def _schema(schema: Schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def balanced(df: DataFrame, key: str) -> DataFrame:
    """A scan with at least one partition per core, for work that is heavy per row.

    A table of many files comes back as it is. Only one with fewer splits than the session has
    cores, such as a single small file, is spread by a hash of its unique key.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def numbered_lines(spark: SparkSession, paths: Paths, by_folder: bool = False) -> DataFrame:
    """Lines of text files with their file and their line number from 1.

    With `by_folder`, the files of a folder are the parts of one long file, in the order of their
    names, and numbers run on from part to part.

    Two scans: the first counts the lines of each block that a task reads, and the sums of the
    blocks before go back to the scan tasks, which number their lines in place. No line is moved
    for its number. Up to `blocks.SENT_BLOCKS` blocks the sums are sent to all tasks; a larger
    table of them is joined as Spark sees fit.
    """
    raw = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    whole = F.regexp_extract("file", "^.*/", 0) if by_folder else F.col("file")
    before = Window.partitionBy(whole).orderBy("file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        raw.groupBy("file", "_block")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
        .select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    starts = written(starts, "line-counts")
    if starts.count() <= blocks.SENT_BLOCKS:
        starts = F.broadcast(starts)
    # ids count the rows of a task; both scans deal the same blocks to the same tasks
    same_task = F.shiftright("_id", 33) == F.shiftright("_first", 33)
    inside = F.when(same_task, F.col("_id") - F.col("_first")).otherwise(
        F.raise_error(F.lit("the files changed between two scans")).cast("long")
    )
    return raw.join(starts, ["file", "_block"]).select(
        "file", (F.col("_start") + inside + 1).alias("line_number"), "value"
    )


def parse_lines(lines: DataFrame, schema: Schema, value: str = "value") -> DataFrame:
    """JSON objects from lines of text; blank and malformed lines are skipped.

    A field of another type than the schema's is null, as its line is still good JSON. A line
    is read as the list of its objects, which must be one: so text after the object is noticed.
    The outer explode keeps the filter on the parsed list from parsing each line twice.
    """
    fields = _schema(schema)
    names = [f.name for f in fields]
    rest = [c for c in lines.columns if c != value and c not in names]
    text = F.trim(F.col(value), F.lit(K.SPACES))
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(fields), STRICT)
    objects = lines.filter(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")))
    parsed = objects.select(*rest, F.explode_outer(F.array(listed)).alias("_p"))
    one = F.col("_p")[0]
    return parsed.filter(F.size("_p") == 1).select(*rest, *[one[n].alias(n) for n in names])


def read_jsonl(spark: SparkSession, paths: Paths, schema: Schema) -> DataFrame:
    """Records of JSON-lines files."""
    return parse_lines(spark.read.text(paths), schema)


def read_ordered_jsonl(spark: SparkSession, paths: Paths, schema: Schema, by_folder: bool = False) -> DataFrame:
    """Records of JSON-lines files with `file` and `line_number`, where file order matters; with
    `by_folder`, the files of a folder are read as one (see `numbered_lines`)."""
    return parse_lines(numbered_lines(spark, paths, by_folder), schema)


def read_many(spark: SparkSession, paths: list[str], schema: Schema) -> DataFrame:
    """Records of several files as one set, each with its `source` file."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source"))
    return parse_lines(lines, schema)


def read_commented_jsonl(spark: SparkSession, paths: Paths, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """Records of JSON lines with `//` comment lines, and the lines that could not be read."""
    lines = numbered_lines(spark, paths).withColumn("value", strip(F.col("value")))
    kept = lines.filter((F.col("value") != "") & ~F.startswith("value", F.lit("//")))
    return parse_lines(kept, schema), kept.filter(~valid_json(F.col("value")))


def read_json_array(spark: SparkSession, paths: Paths, schema: Schema) -> DataFrame:
    """Records of files that hold one JSON array each; large files are read in blocks."""
    return blocks.read_json_array(spark, paths, _schema(schema))


def read_csv(spark: SparkSession, paths: Paths, schema: Schema, multiline: bool = False) -> DataFrame:
    """Records of CSV files with a header; quotes inside fields stand doubled. With `multiline`,
    quoted fields may hold line ends, and large files are still read in blocks."""
    if multiline:
        return blocks.read_quoted_csv(spark, paths, _schema(schema))
    options = {"header": True, "escape": '"', "enforceSchema": False}
    return spark.read.schema(_schema(schema)).options(**options).csv(paths)


def read_product_meta(spark: SparkSession, paths: Paths) -> DataFrame:
    """Product metadata: price as text, `Brand` before `brand`, file order as `seq`."""
    lines = numbered_lines(spark, paths).select(
        F.struct("file", "line_number").alias("seq"),
        F.explode_outer(F.array(json_object(F.col("value")))).alias("_m"),
    )
    m = F.col("_m")
    return lines.filter(m.isNotNull()).select(
        get(m, "parent_asin").alias("parent_asin"),
        get(m, "asin").alias("asin"),
        get(m, "title").alias("title"),
        first_nonempty(get(m, "Brand"), get(m, "brand")).alias("brand"),
        get(m, "price").alias("price"),
        get(m, "main_category").alias("main_category"),
        "seq",
    )


def read_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """A table partitioned by `day`, only the partitions from `first` to `last`."""
    low, high = (F.lit(d).cast("date") for d in (first, last))
    return spark.read.parquet(path).filter(F.col("day").between(low, high))


def read_tasks(spark: SparkSession, path: str, skip_attachments: bool = False) -> DataFrame:
    """Benchmark tasks from Parquet or JSON lines, as one schema.

    A task without id is named after its row or line. Blank lines, comments and lines that are
    not one JSON object are no tasks; `read_bad_tasks` gives the last kind.
    """
    blank = F.lit("")
    if path.lower().rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path).withColumn("line_number", F.col("_metadata.row_index") + 1)
        for name in ("task_id", "Question", "Final answer", "Level", "file_path", "file_name", "Annotator Metadata"):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast("string"))
        named = F.concat(F.lit("row_"), F.col("line_number").cast("string"))
        meta = F.col("`Annotator Metadata`")
        tasks = rows.select(
            "line_number",
            first_nonempty(F.col("task_id"), named).alias("task_id"),
            F.coalesce("Question", blank).alias("question"),
            F.coalesce("`Final answer`", blank).alias("expected_answer"),
            F.coalesce(F.col("Level").cast("string"), blank).alias("level"),
            (meta if isinstance(rows.schema["Annotator Metadata"].dataType, T.StringType) else F.to_json(meta)).alias("annotator_metadata"),
            "file_path",
            "file_name",
        )
    else:
        good = _task_lines(spark, path).filter("good")
        m = F.col("_m")

        def field(name: str, default):
            return F.when(has(m, name), get(m, name)).otherwise(default)

        named = F.concat(F.lit("line_"), F.col("line_number").cast("string"))
        tasks = good.withColumn("_m", json_object(F.col("value"))).select(
            "line_number",
            field("task_id", named).alias("task_id"),
            field("Question", blank).alias("question"),
            field("Final answer", blank).alias("expected_answer"),
            field("Level", blank).alias("level"),
            field("Annotator Metadata", F.lit("{}")).alias("annotator_metadata"),
            get(m, "file_path").alias("file_path"),
            get(m, "file_name").alias("file_name"),
        )
    kept = without_attachments(tasks) if skip_attachments else tasks
    return kept.drop("file_path", "file_name")


def _task_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a task file that are not blank or comments; `good` if they hold one object."""
    lines = numbered_lines(spark, path).withColumn("value", strip(F.col("value")))
    told = lines.filter((F.col("value") != "") & ~F.startswith("value", F.lit("//")))
    bounds = F.startswith("value", F.lit("{")) & F.endswith("value", F.lit("}"))
    return told.withColumn("good", bounds & valid_json(F.col("value")))


def read_bad_tasks(spark: SparkSession, path: str) -> DataFrame:
    """line_number and value of the lines of a task file that hold no task."""
    return _task_lines(spark, path).filter("not good").select("line_number", "value")


def read_cache(spark: SparkSession, path: str, schema: Schema = CACHE) -> DataFrame:
    """A cache table; an empty one if it is not there yet."""
    try:
        return spark.read.schema(_schema(schema)).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _schema(schema))


def latest_snapshot(snapshots: DataFrame, start: int, end: int) -> DataFrame:
    """The path of the newest snapshot of a row range, from a table of snapshots
    (start, end, path, written_at)."""
    same = snapshots.filter((F.col("start") == start) & (F.col("end") == end))
    return same.agg(F.max_by("path", "written_at").alias("path"))


def done_keys(outputs: Sequence[DataFrame], key: str) -> DataFrame:
    """The keys that any earlier output already holds."""
    return merged([o.select(key) for o in outputs]).distinct()
