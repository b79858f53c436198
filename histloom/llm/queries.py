"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histloom.llm import (
    arc_warc, chat_tree, chosen_path, mixing, near_vectors, pii, piece_codec, repeated_passages, spelling, sql,
    toxicity, url_trust, whitening,
)
from histloom.llm.exact_dedup import exact_classes
from histloom.session import written

#: The vocabulary that the tokenizing query and the pipeline use.
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
]

#: No source's rows come more often than this in the mix, and every row comes at least once.
MAX_REPEATS = 2.0

#: A conversation whose texts hold the signs of templates.
HARD_TEXT = r"\### Assistant: </turn> ok"


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op2_exact_dedup", sql.EXACT_DEDUP)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(_table(spark, sf_dir, "documents"))


@_query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return piece_codec.digests(piece_codec.encode_decode(docs, PIECES))


@_query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.predictions(toxicity.score(docs, weights))


@_query(
    "op5_url_trust",
    sql.url_trust(URL_RULES, url_trust.DAMPING_PERCENT, url_trust.TIE),
)
def op5_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_trust.rule_table(spark, URL_RULES)
    judged = url_trust.judge(_table(spark, sf_dir, "pages"), rules, precision=1.0)  # verdicts, no masses
    reached = [(F.col(kind) > 0).alias(f"{kind}ed") for kind in ("trust", "distrust")]
    return judged.select("page_id", "host", "path", "rule", "verdict", *reached)


@_query("op7_chosen_path")
def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_classes(_table(spark, sf_dir, "documents"), width=4)


@_query("op8_arc_warc", sql.ARCHIVES)
def op8_arc_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arc_warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op9_mixing", sql.mixing(MAX_REPEATS, "mix"))
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens"))
    taken = mixing.mix(written(counted, "counted"), max_repeats=MAX_REPEATS, tokens_col="n_tokens")
    return taken.select("doc_id", "source", F.col("_epoch").alias("epoch"), "n_tokens", F.col("_place").alias("place"))


@_query("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(_table(spark, sf_dir, "documents")))


@_query("op6_chat_tree", sql.CHAT)
def op6_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)]
    packed, leaves = chat_tree.pack(table.unionByName(spark.createDataFrame(rows, table.schema)))
    return chat_tree.digests(chat_tree.read_back(packed, leaves))


@_query("op1_near_vectors")
def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


@_query("op12_repeated_passages", sql.REPEATED_PASSAGES)
def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.without_passages(_table(spark, sf_dir, "documents"))


@_query("op13_spelling")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))
