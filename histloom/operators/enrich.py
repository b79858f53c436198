"""Enrichment of rows by a user's function, such as a call to a model service."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histloom.functions.model_output import json_in_text
from histloom.functions.text import usable_text
from histloom.operators.lookups import not_done
from histloom.plans.communities import corpus

# Parts of error texts that tell a lost connection or a passing error.
LOST = ["upstream connect error", "connection refused"]
PASSING = ["429", "timeout", "timed out", "rate limit"]


def with_retry(
    fn: Callable[[str], str],
    retries: int = 10,
    delay: float = 2.0,
    factor: float = 2.0,
    longest: float = 60.0,
    pause: float = 30.0,
    sleep: Callable[[float], None] = time.sleep,
) -> Callable[[str], str]:
    """`fn` with retries: growing waits on passing errors, a long pause on a lost connection,
    none on other errors. The last error is raised."""

    def call(text: str) -> str:
        wait = delay
        for left in range(retries, -1, -1):
            try:
                return fn(text)
            except Exception as error:
                said = str(error).lower()
                lost = any(s in said for s in LOST)
                if left == 0 or not (lost or any(s in said for s in PASSING)):
                    raise
                sleep(pause if lost else wait)
                wait = delay if lost else min(wait * factor, longest)

    return call


def one_call(fn: Callable[[str], str], value: str | None) -> tuple[str, str, str | None]:
    """value, status and error of one row."""
    if value is None or not value.strip():
        return "", "error", "empty input"
    try:
        return fn(value), "success", None
    except Exception as error:  # noqa: BLE001
        return "", "error", str(error)


def enrich(
    rows: DataFrame,
    key: str,
    text: str,
    fn: Callable[[str], str],
    done: DataFrame | None = None,
    threads: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """Apply `fn` to every row: (key, value, status, error), status `success` or `error`.

    `done` holds the keys to leave out. A blank text or an exception gives an error row, never
    a failed job. Rows are spread over `partitions` tasks by key, each with `threads` calls at
    a time; write the result before using it twice, or the calls are made twice.
    """
    todo = rows if done is None else not_done(rows, done, [key])
    slim = todo.select(key, text)
    if partitions is not None:
        slim = slim.repartition(partitions, key)
    schema = T.StructType(
        [slim.schema[key], *[T.StructField(c, T.StringType()) for c in ("value", "status", "error")]]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                results = list(pool.map(lambda value: one_call(fn, value), batch[text]))
                out = pd.DataFrame(results, columns=["value", "status", "error"])
                out.insert(0, key, batch[key].to_numpy())
                yield out

    return slim.mapInPandas(run, schema)


def enrich_or_keep(rows: DataFrame, key: str, text: str, value: str, fn: Callable[[str], str], **how) -> DataFrame:
    """Like `enrich`, but rows that already have a value keep it with status `skipped`."""
    has = usable_text(F.col(value))
    skipped = rows.filter(has).select(
        key, F.col(value).alias("value"), F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error")
    )
    return enrich(rows.filter(~has), key, text, fn, **how).unionByName(skipped)


def _answer(value: Column) -> Column:
    found = json_in_text(value)
    return F.when(F.size(found) > 0, found)


def two_pass(
    posts: DataFrame,
    describe: Callable[[str], str],
    rate: Callable[[str], str],
    user_chars: int,
    community_chars: int,
) -> DataFrame:
    """One call per user on all posts, one per user and community on the posts there.

    `posts` has user_id, subreddit, first_seq, pos, post; a user's texts go by community in the
    order of the first post there. The result has one row per user and community with the user's
    description (a JSON object, `unknown` fields if there is none) and the vector of the
    community. A community whose answer holds no JSON is left out. An empty object is no answer.
    """
    order = ["first_seq", "pos"]
    people = corpus(posts, ["user_id"], order, "post", user_chars)
    both = F.concat_ws("\u0001", F.col("user_id").cast("string"), "subreddit")
    places = corpus(posts, ["user_id", "subreddit"], ["pos"], "post", community_chars)
    fields = ["age", "gender", "occupation", "location"]
    unknown = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.lit("unknown")] * 4))
    described = enrich(people, "user_id", "corpus", describe).select(
        "user_id", F.coalesce(_answer(F.col("value")), unknown).alias("anchor_demographics")
    )
    rated = enrich(places.withColumn("_key", both), "_key", "corpus", rate).select(
        F.split("_key", "\u0001")[0].cast(posts.schema["user_id"].dataType).alias("user_id"),
        F.split("_key", "\u0001")[1].alias("subreddit"),
        _answer(F.col("value")).alias("_map"),
    )
    vector = F.transform_values("_map", lambda k, v: v.try_cast("double"))
    return (
        rated.filter(F.col("_map").isNotNull())
        .join(described, "user_id")
        .select(
            "user_id", "subreddit", "anchor_demographics",
            vector.alias("shift_vector"), vector.alias("target_vector"),
        )
    )
