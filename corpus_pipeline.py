"""The corpus pipeline: stages of the training-data operators, one after the other.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns
a DataFrame that is written as Parquet and read again as the next one's docs. All but the last
return the columns of `docs`. Rows keep their doc_id; rows with a null id or text go through
every stage like others, and an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histloom.llm import chosen_path, exact_dedup, mixing, piece_codec, toxicity
from histloom.llm.names import free_name
from histloom.session import written

TOXIC_SCORE = 0.3
#: No source's rows come more often than this in the mix; every row comes at least once.
MAX_REPEATS = 2.0
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score TOXIC_SCORE or more. The model is trained on the labels of the
    tables and the texts of `docs`; rows are scored where they are, so a repeated or null id does
    not matter."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = toxicity.fit(docs, labels)
    score = free_name(docs, "_score")
    return toxicity.with_score(docs, weights, into=score).filter(F.col(score) < TOXIC_SCORE).drop(score)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group of equal texts, that with the smallest id."""
    return exact_dedup.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group of near copies (five-word shingles, similarity of 0.8 or
    more), that with the smallest id. Rows without words or id are no copies and stay. Rows are
    named by id and text: of two texts with one id only that goes which is a near copy, and of two
    near copies with one id one stays."""
    key = free_name(docs, "_row")
    digest = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    name = F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"), digest.alias("digest"))
    classes = chosen_path.near_classes(docs.withColumn(key, name), id_col=key)
    gone = classes.filter(~F.col("kept") & ~F.col(f"{key}.none"))
    dropped = gone.select(F.col(f"{key}.id").alias("_drop_id"), F.col(f"{key}.digest").alias("_drop_digest")).distinct()
    same = (docs["doc_id"] == dropped["_drop_id"]) & (digest == dropped["_drop_digest"])
    return docs.join(dropped, same, "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: every row comes once, and rows of small sources up to
    MAX_REPEATS times."""
    extra = [free_name(docs, name) for name in ("_epoch", "_place")]
    return mixing.mix(docs, max_repeats=MAX_REPEATS, epoch_col=extra[0], place_col=extra[1]).drop(*extra)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and agrees per row of the mix."""
    encoded = piece_codec.encode_decode(docs, PIECES)
    return piece_codec.digests(encoded)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", tokens_stage),
]

#: Training and the tokenizer's library have no SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the stage before it kept, written as Parquet in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
