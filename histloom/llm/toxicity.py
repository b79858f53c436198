"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training reads a bounded, hash-chosen sample of the labelled rows, cut into shards that are
trained in parallel, each with per-coordinate rates and an L1 penalty that keeps most weights
at exactly zero; the shards' weights are then averaged. Rows and bytes of a shard are bounded. What is left is a short list of feature
numbers and weights, at most 2**FEATURE_BITS long, which every scoring task gets.

Texts are hashed as bytes, whole, without making a string per word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histloom.llm import hashing
from histloom.llm.memory import give_back

FEATURE_BITS = 21
BIAS = 1 << FEATURE_BITS
#: Words between the two words of a pair: 0 is a bigram, the others are skip-grams.
GAPS = (0, 1, 2)
#: At most about this many labelled rows are used to fit the model.
MAX_FIT_ROWS = 40_000
#: A shard has about so many rows, or fewer if their texts are longer.
ROWS_PER_SHARD = 8_000
BYTES_PER_SHARD = 128 << 20
TEXTS_AT_ONCE = 256
#: Beyond this, the logistic function is 0 or 1 to the last digit that matters.
FAR = 35.0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature number of every word, pair and skip-pair of a string array."""
    rows, words = hashing.words(texts, hashing.LETTERS)
    all_rows, all_keys = [rows], [words]
    for gap in GAPS:
        step = gap + 1
        left, right = words[:-step], words[step:]
        same = rows[:-step] == rows[step:]
        pair = hashing.mix(left * np.uint64(2 * gap + 3) + (right ^ (right << np.uint64(17))))
        all_rows.append(rows[:-step][same])
        all_keys.append(pair[same])
    keys = np.concatenate(all_keys) >> np.uint64(64 - FEATURE_BITS)
    return np.concatenate(all_rows), keys.astype(np.int64)


@dataclass(frozen=True)
class Ftrl:
    """FTRL-proximal: `alpha` and `beta` set the rate of each coordinate, `l1` and `l2` penalise.

    A feature enters the model of a shard once `min_rows` of its rows have it: features of one
    or two texts would otherwise learn those texts by heart.
    """

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.01
    passes: int = 4
    min_rows: int = 3

    def weights(self, z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and weights after `passes` over the rows; the bias is not penalised."""
        seen = np.zeros(BIAS, np.int32)
        for x in rows:
            seen[x] += 1
        common = seen >= self.min_rows
        rows = [x[common[x]] for x in rows]
        z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
        order = np.random.default_rng(seed)
        for _ in range(self.passes):
            for i in order.permutation(len(rows)):
                x = rows[i]
                w = self.weights(z[x], n[x], self.l1)
                bias = self.weights(z[BIAS:], n[BIAS:], 0.0)[0]
                g = _sigmoid(w.sum() + bias) - labels[i]
                for at, old in ((x, w), (BIAS, bias)):
                    before = n[at]
                    z[at] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / self.alpha * old
                    n[at] = before + g * g
        w = self.weights(z, n, self.l1)
        w[BIAS] = self.weights(z[BIAS:], n[BIAS:], 0.0)[0]
        kept = np.flatnonzero(w)
        return kept, w[kept]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -FAR, FAR)))


def held_out(id_col: str | Column = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is kept from training: CRC-32 of its id as text, modulo `folds`."""
    doc_id = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _share_of(number: Column, share: float) -> Column:
    """True for about `share` of all hashes, and always from a share of 1 on."""
    return F.pmod(number, F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    model: Ftrl = Ftrl(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_FIT_ROWS,
) -> dict[int, float]:
    """The weights by feature number, learned from the labelled rows that are not held out.

    With more than `max_rows` such ids, about that many are used, chosen by a hash of the id; if
    these ids stand in more rows than that, about `max_rows` of the rows, chosen by a hash of id and
    text. Rows with the same id and text count once. Rows without id, label or text teach nothing.
    An id with several labels counts as toxic if one of them says so. Without a toxic row to learn
    from, every score is 0.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
    )
    total, toxic = known.agg(F.count(F.lit(1)), F.sum("_y")).first()
    if not toxic:
        return {BIAS: -FAR}
    chosen = known.filter(_share_of(F.xxhash64(F.lit("fit"), "_id"), max_rows / total))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    rows = texts.filter(F.col("_text").isNotNull()).join(F.broadcast(chosen), "_id")  # about max_rows ids
    rows = rows.withColumn("_hash", F.xxhash64(F.lit("row"), "_id", "_text"))
    found, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("_text"))).first()
    share = min(1.0, max_rows / max(1, found))
    rows = rows.filter(_share_of(F.col("_hash"), share)).dropDuplicates(["_id", "_hash"])
    shards = max(1, round(found * share / ROWS_PER_SHARD), math.ceil((size or 0) * share / BYTES_PER_SHARD))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "_hash"), F.lit(shards)).cast("int")

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_id", "_text"])
        found: list[np.ndarray] = []
        for at in range(0, len(part), TEXTS_AT_ONCE):
            some = pa.array(part["_text"].iloc[at : at + TEXTS_AT_ONCE], pa.string())
            row, key = features(some)
            found += [np.unique(key[row == i]).astype(np.int32) for i in range(len(some))]
        keys, weights = model.fit(found, part["_y"].to_numpy(float), seed=int(part["shard"].iloc[0]))
        del found
        give_back()
        return pd.DataFrame({"key": keys, "weight": weights})

    learned = rows.withColumn("shard", shard).groupBy("shard").applyInPandas(train, "key long, weight double")
    mean = learned.groupBy("key").agg((F.sum("weight") / shards).alias("weight"))
    return {r["key"]: r["weight"] for r in mean.collect()} or {BIAS: -FAR}


def with_score(
    docs: DataFrame, weights: dict[int, float], text_col: str = "text", into: str = "_score"
) -> DataFrame:
    """`docs`, all columns, with the score (0 to 1) of every row from its whole text.

    A null text counts as empty, and an empty text has the score of the bias alone. Repeated
    rows are scored each. No other column can change a score.
    """
    bias = weights.get(BIAS, 0.0)
    keys = np.array(sorted(k for k in weights if k != BIAS), dtype=np.int64)
    values = np.array([weights[int(k)] for k in keys])
    shared = docs.sparkSession.sparkContext.broadcast((keys, values))
    names = docs.columns
    place = names.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        table = np.zeros(BIAS)
        table[keys] = values
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                rows, found = features(part.column(place).cast(pa.string()).fill_null(""))
                used = table[found] != 0.0
                once = np.unique(rows[used].astype(np.int64) << FEATURE_BITS | found[used])
                total = np.bincount(once >> FEATURE_BITS, table[once & (BIAS - 1)], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(_sigmoid(total + bias))], names=[*names, into]
                )
        del table
        give_back()

    return docs.mapInArrow(run, schema)


def score(
    docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id and score of every row; see `with_score`. Other columns are not read."""
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text"))
    return with_score(rows, weights, "_text", "score").select(id_col, "score")


def predictions(scored: DataFrame, threshold: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    return scored.select(
        id_col,
        held_out(id_col).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
