"""Scoring of generated profiles: grounding, batch evaluation, worst traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histloom import constants as K
from histloom.functions.model_output import with_traits
from histloom.functions.text import normalize_text
from histloom.functions.vectors import grounded_alignment
from histloom.operators.ordering import bottom_k


def with_grounding(
    df: DataFrame, traits: str, excerpts: str, into: str, value_names: bool = False
) -> DataFrame:
    """Add how well the quotes of the traits are found in the excerpts they point to.

    Half of the score is the share of valid quotes, half the share of traits with one. Quotes
    under twelve characters are left out. With `value_names`, index -1 with the name of a value
    is a valid quote as well. Traits and excerpts of a user are in one row, so nothing moves.
    """
    names = [n.lower() for n in K.VALUE_NAMES]
    staged = df.withColumn("_excerpts", F.transform(excerpts, lambda x: normalize_text(x)))
    quotes = F.transform(
        traits,
        lambda t: F.transform(
            F.coalesce(t["evidence_quotes"], F.array().cast("array<struct<quote:string,source_index:int>>")),
            lambda q: F.struct(normalize_text(q["quote"]).alias("q"), q["source_index"].alias("at")),
        ),
    )
    staged = staged.withColumn("_quotes", quotes)

    def named(x):
        by_name = (x["at"] == -1) & x["q"].isin(names)
        return F.coalesce(by_name, F.lit(False)) if value_names else F.lit(False)

    def valid(x):
        source = F.when(x["at"] >= 0, F.try_element_at(F.col("_excerpts"), x["at"] + 1))
        return named(x) | F.coalesce(F.contains(source, x["q"]), F.lit(False))

    counted = F.transform(
        "_quotes",
        lambda qs: F.filter(qs, lambda x: (F.length(x["q"]) >= K.MIN_QUOTE_CHARS) | named(x)),
    )
    staged = staged.withColumn("_counted", counted).withColumn(
        "_valid", F.transform("_counted", lambda qs: F.size(F.filter(qs, lambda x: valid(x))))
    )
    total = F.aggregate("_counted", F.lit(0), lambda a, qs: a + F.size(qs))
    good = F.aggregate("_valid", F.lit(0), lambda a, n: a + n)
    covered = F.size(F.filter("_valid", lambda n: n > 0))
    score = F.try_divide(good, total) * 0.5 + F.try_divide(covered, F.size(traits)) * 0.5
    return staged.withColumn(into, F.coalesce(score, F.lit(0.0))).drop(
        "_excerpts", "_quotes", "_counted", "_valid"
    )


def evaluate(batch: DataFrame, outputs: DataFrame, key: str = "user_id", value_names: bool = False) -> DataFrame:
    """Score every row of a batch: `outputs` (key, raw, alignment) may lack rows that failed.

    `batch` has the key and `excerpts`. A failed row keeps score 0 and an empty description.
    """
    joined = batch.join(outputs.select(key, "raw", "alignment"), key, "left")
    parsed = with_grounding(with_traits(joined, "raw"), "traits", "excerpts", "grounding", value_names)
    ok = F.col("raw").isNotNull()
    score = grounded_alignment(F.col("grounding"), F.coalesce("alignment", F.lit(0.0)))
    return (
        parsed.withColumn("score", F.when(ok, score).otherwise(F.lit(0.0)))
        .withColumn("grounding", F.when(ok, F.col("grounding")).otherwise(F.lit(0.0)))
        .withColumn("alignment", F.coalesce("alignment", F.lit(0.0)))
    )


def worst_traces(scored: DataFrame, key: str, k: int, diagnosis: str | None = None) -> DataFrame:
    """Feedback records of the `k` lowest scores, earlier keys first on ties."""
    reason = F.col(diagnosis) if diagnosis else F.lit("none")
    feedback = F.concat(
        F.format_string("Evaluation Score: %.3f. ", "score"), F.lit("Diagnosis: "), F.coalesce(reason, F.lit("none"))
    )
    worst = bottom_k(scored, "score", key, k)
    return worst.select(key, F.col("persona_description").alias("generated"), feedback.alias("feedback"), "score")
