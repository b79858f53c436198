"""Named-value vectors (map<string,double>), questionnaire scores and small score formulas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from histloom import constants as K


def zero_if_missing(c: Column) -> Column:
    """0.0 for null and NaN."""
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0))


def literal_map(values: Mapping[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def flat_prior() -> Column:
    """The vector for a day without any signal."""
    return literal_map({name: K.FLAT_PRIOR for name in K.VALUE_NAMES})


def _values_sum(vector: Column) -> Column:
    return F.aggregate(F.map_values(vector), F.lit(0.0), lambda a, x: a + x)


def _map_values(vector: Column, fn) -> Column:
    return F.transform_values(vector, lambda k, v: fn(k, v))


def signal_vector() -> Column:
    """The value vector of a row of averaged signals, summing to about 1; null if all are 0.

    Four values are read directly. The five social values are read directly when security and
    universalism are present, else they come from the backup signals.
    """
    z = {name: zero_if_missing(F.col(name)) for name in K.SIGNAL_CODES}
    present = (z["val_security"] + z["val_universalism"]) > K.SOCIAL_PRESENT

    def social(direct: str, proxy: Column) -> Column:
        return F.when(present, z[direct]).otherwise(proxy)

    raw = {
        "POWER": z["val_power"],
        "ACHIEVEMENT": z["val_achievement"],
        "HEDONISM": z["val_hedonism"],
        "STIMULATION": z["val_stimulation"],
        "UNIVERSALISM": social("val_universalism", z["backup_social"] * 0.5),
        "BENEVOLENCE": social("val_benevolence", z["backup_social"] * 0.5),
        "TRADITION": social("val_tradition", z["backup_anger"] * 0.5),
        "CONFORMITY": social("val_conformity", z["backup_anger"] * 0.8),
        "SECURITY": social("val_security", z["backup_risk"]),
    }
    vector = F.map_from_arrays(F.array(*[F.lit(n) for n in raw]), F.array(*raw.values()))
    return share_of_total(vector)


def share_of_total(vector: Column) -> Column:
    """Each value as its share of the sum, three digits; null if the sum is 0."""
    total = _values_sum(vector)
    return F.when(total != 0, _map_values(vector, lambda k, v: F.round(v / total, 3)))


def calibrate_by_weights(vector: Column) -> Column:
    """Multiply by fixed weights (1 for other names) and bring the sum back to 1."""
    weights = literal_map(K.VALUE_WEIGHTS)
    weighted = _map_values(vector, lambda k, v: v * F.coalesce(weights[k], F.lit(1.0)))
    return F.coalesce(share_of_total(weighted), vector)


def calibrate_by_means(vector: Column) -> Column:
    """Divide by the population means and bring the sum back to 1."""
    means = literal_map(K.VALUE_MEANS)
    ratio = _map_values(vector, lambda k, v: v / F.coalesce(means[k], F.lit(K.DEFAULT_MEAN)))
    return F.coalesce(share_of_total(ratio), vector)


def top_trait(vector: Column) -> Column:
    """The entry (key, value) with the largest value, the first one on ties."""
    entries = F.map_entries(vector)
    return F.aggregate(
        F.slice(entries, 2, F.greatest(F.size(entries) - 1, F.lit(0))),
        F.try_element_at(entries, F.lit(1)),
        lambda best, e: F.when(e["value"] > best["value"], e).otherwise(best),
    )


def max_gap_trait(target: Column, actual: Column) -> Column:
    """The target entry farthest from the actual vector (struct trait, gap, target, actual).

    The first one on ties; `Unknown` when no value differs. A name without an actual value
    counts as 0 there.
    """
    gaps = F.transform(
        F.map_entries(target),
        lambda e: F.struct(
            e["key"].alias("trait"),
            F.abs(e["value"] - F.coalesce(F.try_element_at(actual, e["key"]), F.lit(0.0))).alias("gap"),
            e["value"].alias("target"),
            F.coalesce(F.try_element_at(actual, e["key"]), F.lit(0.0)).alias("actual"),
        ),
    )
    none = F.struct(
        F.lit("Unknown").alias("trait"),
        F.lit(0.0).alias("gap"),
        F.lit(0.0).alias("target"),
        F.lit(0.0).alias("actual"),
    )
    return F.aggregate(gaps, none, lambda best, g: F.when(g["gap"] > best["gap"], g).otherwise(best))


def vector_text(vector: Column) -> Column:
    """`NAME: 0.00, NAME: 0.00` in entry order."""
    return F.concat_ws(
        ", ",
        F.transform(F.map_entries(vector), lambda e: F.format_string("%s: %.2f", e["key"], e["value"])),
    )


def trait_scores(answers: Column) -> Column:
    """Mean answer per trait from a map of item number (as text) to answer.

    A 0 counts as not answered; a trait without answers scores 0.
    """

    items = max(i for listed in K.TRAIT_ITEMS.values() for i in listed)
    by_item = F.transform(
        F.sequence(F.lit(1), F.lit(items)),
        lambda i: F.nullif(F.try_element_at(answers, i.cast("string")).cast("double"), F.lit(0.0)),
    )

    def mean_of(values: Column, listed: list[int]) -> Column:
        given = F.array_compact(F.array(*[F.get(values, F.lit(i - 1)) for i in listed]))
        total = F.aggregate(given, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(given) > 0, total / F.size(given)).otherwise(F.lit(0.0))

    # the list of one binds the answers by item, so that they are looked up once for all traits
    means = F.transform(
        F.array(by_item), lambda v: F.array(*[mean_of(v, listed) for listed in K.TRAIT_ITEMS.values()])
    )
    return F.map_from_arrays(F.array(*[F.lit(t) for t in K.TRAIT_ITEMS]), F.get(means, F.lit(0)))


def alignment_grade(target: Column, scores: Column) -> Column:
    """How the score of the target's top trait compares: 1, 0.5 or 0; 0.5 without a target."""
    score = F.coalesce(F.try_element_at(scores, top_trait(target)["key"]), F.lit(0.0))
    empty = F.coalesce(F.size(target), F.lit(0)) <= 0
    return (
        F.when(empty, 0.5)
        .when(F.coalesce(F.size(scores), F.lit(0)) <= 0, 0.0)
        .when(score >= K.ALIGNED_FULL, 1.0)
        .when(score >= K.ALIGNED_HALF, 0.5)
        .otherwise(0.0)
    )


def grounded_alignment(grounding: Column, alignment: Column) -> Column:
    return grounding * 0.5 + alignment * 0.5


def faithful_coverage(faithfulness: Column, coverage: Column) -> Column:
    return faithfulness * 0.7 + coverage * 0.3


def faithfulness(new_claims: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(K.NEW_CLAIM_COST) * new_claims)


def gated_score(entailment: Column, judged: Column) -> Column:
    """The entailment score if it is below the gate, else the judged score."""
    return F.when(entailment < K.ENTAILMENT_GATE, entailment).otherwise(judged)


def softmax_at(logits: Column, index: int) -> Column:
    """The softmax probability at `index` (from 0)."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top).cast("double"))
    return F.exp(F.try_element_at(logits, F.lit(index + 1)) - top) / total


def rating_class(rating: Column) -> Column:
    """Rating 1..5 as class 0..4, rounding halves to even and clamping."""
    return (F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.rint(rating))) - 1).cast("int")


def unit(vector: Column) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def pair_features(a: Column, b: Column) -> Column:
    """Element-wise products of two vectors."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
