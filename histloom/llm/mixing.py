"""Mixing sources to target weights by a temperature.

A source's weight is its share of all tokens to the power of an exponent, normalised: 1 keeps
the shares, 0 makes all sources equal. The exponent is found by section: the smallest one that
keeps the entropy of the weights at or below a target (above 1 where the shares' own entropy is
higher), or the repetition of every source at or below a limit. Weights become token budgets, and a budget becomes whole passes over the source
and a last pass that stops where the budget ends. Every pass has its own pseudo-random order:
blocks by the first digits of a digest, and rows by the rest of it. Only the block in which a
budget ends is looked at row by row, so a source with a third of all rows is never in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histloom.llm.names import free_name
from histloom.session import written

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the digest that number a block: 4,096 blocks in each pass over a source.
BLOCK_DIGITS = 3
#: Exponents that one pass over the sources tries, and how often the section is repeated.
SECTIONS, PASSES = 64, 8
#: The largest exponent that is looked at for a target entropy.
MOST_EXPONENT = 16.0


def token_count(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A source as a key that is never null: rows without a source are a source of their own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def place(id_col: Column, epoch: Column, seed: str) -> Column:
    """Where a row stands in a pass: a digest of seed, pass and id."""
    name = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), name))


def _section(holds: Callable[[list[float]], list[bool]], most: float) -> float:
    """The smallest exponent in 0 to `most` for which `holds`, given that all larger ones do, too."""
    if holds([0.0])[0]:
        return 0.0
    low, high = 0.0, 1.0
    while not holds([high])[0]:
        if high >= most:
            raise ValueError(f"no exponent up to {most:g} meets the target")
        low, high = high, 2 * high
    for _ in range(PASSES):
        tries = [low + (high - low) * i / SECTIONS for i in range(1, SECTIONS)]
        first = next((i for i, ok in enumerate(holds(tries)) if ok), len(tries))
        bounds = [low, *tries, high]
        low, high = bounds[first], bounds[first + 1]
    return high


def exponent(
    sources: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None,
    budget: int | None = None,
) -> float:
    """The exponent for `sources` (share, null where there are no tokens).

    `target_entropy` is in bits; a target above the highest possible gives 0, one below the
    entropy of the shares themselves an exponent above 1, and one that no exponent up to
    MOST_EXPONENT meets is an error, as is a `budget` that repeats all rows more often than
    `max_repeats` on average. `max_repeats` limits how often a row of any source
    comes, with `budget` tokens in all, or else with the smallest budget that takes every source
    once.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give a target entropy or a limit of repetition")
    known = sources.filter("share > 0")
    total, least, most = known.agg(F.sum("tokens"), F.min("share"), F.max("share")).first()
    if not total:
        return 1.0

    def sums(tries: list[float]) -> list[tuple[float, float]]:
        powers = [F.pow("share", F.lit(a)) for a in tries]
        columns = [F.sum(p) for p in powers] + [F.sum(p * F.log("share")) for p in powers]
        row = known.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return list(zip(row[: len(tries)], row[len(tries) :]))

    def low_enough(tries: list[float]) -> list[bool]:
        bits = [(math.log(z) - a * s / z) / math.log(2) for a, (z, s) in zip(tries, sums(tries))]
        return [b <= target_entropy for b in bits]

    def rare_enough(tries: list[float]) -> list[bool]:
        if budget is None:
            return [(least / most) ** (a - 1) <= max_repeats for a in tries]
        most_often = max_repeats * (1 + 1e-12)  # shares add up to 1 but for rounding
        return [least ** (a - 1) / z * budget / total <= most_often for a, (z, _) in zip(tries, sums(tries))]

    if target_entropy is not None:
        return _section(low_enough, MOST_EXPONENT)
    return _section(rare_enough, 1.0)


def source_plan(
    rows: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None,
    budget: int | None = None, seed: str = "mix",
) -> DataFrame:
    """One row per source of `rows` (_id, _source, n_tokens): _source, tokens, share, weight,
    budget, passes (whole ones) and cut, the place up to which the last pass goes.

    Without `budget`, it is the smallest that takes every source once. A source without tokens
    has weight 0 and comes once.
    """
    totals = rows.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"))
    everything = totals.agg(F.sum("tokens").alias("all_tokens"))
    share = F.when(F.col("tokens") > 0, F.col("tokens") / F.col("all_tokens"))
    sources = written(totals.crossJoin(F.broadcast(everything)).withColumn("share", share), "sources")
    power = F.pow("share", F.lit(exponent(sources, target_entropy, max_repeats, budget)))
    norm = sources.agg(F.sum(power).alias("norm"), F.max(F.col("tokens") / power).alias("once"))
    given = F.lit(float(budget)) if budget is not None else F.col("once") * F.col("norm")
    planned = sources.crossJoin(F.broadcast(norm)).select(
        "_source", "tokens", "share",
        F.coalesce(power / F.col("norm"), F.lit(0.0)).alias("weight"),
        F.coalesce(F.floor(given * power / F.col("norm") + 0.5), F.lit(0)).cast("long").alias("budget"),
    )
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1))
    planned = written(planned.withColumn("passes", whole.cast("int")), "source-plan")
    return planned.join(_cuts(rows, planned, seed), "_source", "left").withColumn("cut", F.coalesce("cut", F.lit("")))


def _cuts(rows: DataFrame, planned: DataFrame, seed: str) -> DataFrame:
    """_source and cut: rows of the last pass stay up to this place, so long as their running
    sum of tokens is within what is left of the budget."""
    partial = planned.withColumn("left", F.expr("budget - passes * tokens")).filter("tokens > 0 and left > 0")
    placed = rows.join(partial.select("_source", "passes", "left"), "_source").select(
        "_source", "left", "n_tokens", place(F.col("_id"), F.col("passes"), seed).alias("place")
    ).withColumn("block", F.substring("place", 1, BLOCK_DIGITS))
    blocks = placed.groupBy("_source", "block").agg(F.max("left").alias("left"), F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_source").orderBy("block"))
    ends = (
        blocks.withColumn("upto", upto)
        .filter("upto > left")
        .groupBy("_source")
        .agg(F.min_by(F.struct("block", (F.col("left") - (F.col("upto") - F.col("n"))).alias("room")), "block").alias("e"))
        .select("_source", "e.block", "e.room")
    )
    inside = placed.join(ends, ["_source", "block"])
    running = F.sum("n_tokens").over(Window.partitionBy("_source", "block").orderBy("place", "n_tokens"))
    last = (
        inside.withColumn("running", running)
        .groupBy("_source", "block")
        .agg(F.max(F.when(F.col("running") <= F.col("room"), F.col("place"))).alias("last"))
    )
    return last.select("_source", F.coalesce("last", "block").alias("cut"))


def realise(
    docs: DataFrame, plan: DataFrame, id_col: str, source_col: str, seed: str = "mix",
    epoch_col: str = "_epoch", place_col: str = "_place",
) -> DataFrame:
    """`docs` with its pass and place, a row for each pass that takes it. Sorted by place, the
    passes of all sources are spread evenly over the mix."""
    key, whole, end, zero = (free_name(docs, n) for n in ("_mix_source", "_mix_passes", "_mix_cut", "_mix_zero"))
    plan = plan.select(F.col("_source").alias(key), F.col("passes").alias(whole), F.col("cut").alias(end))
    joined = docs.withColumn(key, source_key(F.col(f"`{source_col}`"))).join(plan, key)
    doc_id, passes = F.col(f"`{id_col}`"), F.col(whole)
    more = place(doc_id, passes, seed) <= F.col(end)
    times = F.array_repeat(F.lit(0), passes + more.cast("int"))
    taken = joined.select("*", F.posexplode_outer(times).alias(epoch_col, zero)).filter(F.col(epoch_col).isNotNull())
    return taken.withColumn(place_col, place(doc_id, F.col(epoch_col), seed)).drop(key, whole, end, zero)


def mix(
    docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None,
    budget: int | None = None, id_col: str = "doc_id", source_col: str = "source",
    text_col: str = "text", tokens_col: str | None = None, seed: str = "mix",
    epoch_col: str = "_epoch", place_col: str = "_place",
) -> DataFrame:
    """The rows of `docs` that the mix takes, all columns, with their pass and place (`epoch_col`
    and `place_col`, new names).

    Tokens are the words of `text_col`, or what `tokens_col` says. Null texts have no tokens and cost nothing. Rows without a source are one source. Rows with
    the same id stand at the same place. An empty table gives no rows.
    """
    tokens = token_count(F.col(f"`{text_col}`")) if tokens_col is None else F.col(f"`{tokens_col}`").cast("long")
    rows = written(
        docs.select(
            F.col(f"`{id_col}`").alias("_id"), source_key(F.col(f"`{source_col}`")).alias("_source"),
            tokens.alias("n_tokens"),
        ),
        "mix-rows",
    )
    plan = written(source_plan(rows, target_entropy, max_repeats, budget, seed), "mix-plan")
    return realise(docs, plan, id_col, source_col, seed, epoch_col, place_col)
