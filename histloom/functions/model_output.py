"""Values out of model answers: JSON in prose, verdicts, code blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom import constants as K
from histloom.functions.nested import valid_json
from histloom.functions.text import strip

FENCE, JSON_FENCE = "```", "```json"
# The first line of a fenced block: a language, if there is one, and the line end.
BLOCK_HEAD = f"^(?:[{K.SPACE}]*([A-Za-z0-9_+-]+))?\n"
_ANSWER = (
    "struct<traits:array<struct<trait:string,confidence:double,"
    "evidence_quotes:array<struct<quote:string,source_index:variant>>>>,persona_description:string>"
)


def _between(c: Column, opening: str, closing: str) -> Column:
    """The text after the first `opening`, up to the next `closing`; null without both."""
    at = F.instr(c, opening)
    rest = F.substring(c, at + len(opening), F.length(c))
    end = F.instr(rest, closing)
    return F.when((at > 0) & (end > 0), F.substring(rest, F.lit(1), end - 1))


def _braced(c: Column) -> Column:
    """From the first `{` to the last `}`; null without such."""
    first, last = F.instr(c, "{"), F.length(c) - F.instr(F.reverse(c), "}") + 1
    whole = (first > 0) & F.contains(c, F.lit("}")) & (first < last)
    return F.when(whole, F.substring(c, first, last - first + 1))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def with_traits(df: DataFrame, raw: str, traits: str = "traits", description: str = "persona_description") -> DataFrame:
    """Add the traits and the description of a model answer.

    The JSON is taken from a fenced block, else from the object that holds both fields, else
    from the whole text; without valid JSON there are no traits and the description is ''.
    A source index that is not an integer becomes null.
    """
    answer = F.col(raw)
    braced = _braced(answer)
    listed = F.instr(braced, '"traits"')
    described = F.locate('"persona_description"', F.substring(braced, listed + 8, F.length(braced)))
    both = F.when((listed > 0) & (described > 0), braced)
    text = F.coalesce(_filled(strip(_between(answer, JSON_FENCE, FENCE))), both, strip(answer))
    staged = df.withColumn("_json", text)
    staged = staged.withColumn("_parsed", F.when(valid_json(F.col("_json")), F.from_json("_json", _ANSWER)))

    def quote(q: Column) -> Column:
        index = F.when(
            F.schema_of_variant(q["source_index"]) == "BIGINT",
            F.try_variant_get(q["source_index"], "$", "int"),
        )
        return F.struct(q["quote"].alias("quote"), index.alias("source_index"))

    def trait(t: Column) -> Column:
        return F.struct(
            t["trait"].alias("trait"),
            t["confidence"].alias("confidence"),
            F.transform(t["evidence_quotes"], quote).alias("evidence_quotes"),
        )

    found = F.transform("_parsed.traits", trait)
    kind = "array<struct<trait:string,confidence:double,evidence_quotes:array<struct<quote:string,source_index:int>>>>"
    return (
        staged.withColumn(traits, F.coalesce(found, F.array().cast(kind)))
        .withColumn(description, F.coalesce("_parsed.persona_description", F.lit("")))
        .drop("_json", "_parsed")
    )


def json_in_text(c: Column) -> Column:
    """The object between the first `{` and the last `}` as map of texts; null if it is not valid."""
    found = _braced(c)
    return F.when(valid_json(found), F.from_json(found, "map<string,string>"))


def list_in_text(c: Column, n: int) -> Column:
    """Up to `n` entries of a fenced JSON list; an empty list if there is none."""
    found = _between(c, JSON_FENCE + "\n", "\n" + FENCE)
    listed = F.when(F.startswith(F.ltrim(found), F.lit("[")) & valid_json(found), F.from_json(found, "array<string>"))
    return F.slice(F.coalesce(listed, F.array().cast("array<string>")), 1, n)


def _verdict(c: Column, pattern: str, missing: bool) -> Column:
    found = F.upper(F.regexp_extract(c, pattern, 1))
    return F.when(found == "", F.lit(missing)).otherwise(found == "YES").cast("int")


def _verdict_score(c: Column, pattern: str, good: list[int], bad: list[int]) -> Column:
    """Good verdicts minus bad ones, scaled to 0..1. A missing verdict counts as the worse one."""
    plus = [_verdict(c, pattern.format(i=i), False) for i in good]
    minus = [_verdict(c, pattern.format(i=i), True) for i in bad]
    raw = sum(plus[1:], plus[0]) - sum(minus[1:], minus[0])
    score = (raw + len(bad)) / (len(good) + len(bad))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def verdict_score4(c: Column) -> Column:
    """Score of four numbered verdicts such as `1: YES`; 2 and 4 are good, 1 and 3 bad."""
    return _verdict_score(c, f"(?i){{i}}:[{K.SPACE}]*(YES|NO)", [2, 4], [1, 3])


def verdict_score5(c: Column, loose: bool = False) -> Column:
    """Score of five numbered verdicts with reasoning; 2, 4 and 5 are good, 1 and 3 bad.

    By default YES and NO must be words of their own. `loose` takes the first such letters,
    also inside another word ("not").
    """
    word = "(YES|NO)" if loose else r"\b(YES|NO)\b"
    return _verdict_score(c, f"(?is){{i}}[.:{K.SPACE}]+.*?{word}", [2, 4, 5], [1, 3])


def code_blocks(c: Column) -> Column:
    """The fenced code blocks of a text as array of (language, code).

    The text is cut at the fences. A piece between two fences is a block if its first line is
    empty or a language; then its closing fence is used up, and the piece after it is no block.
    """
    pieces = F.split(c, FENCE)
    kind = "array<struct<language:string,code:string>>"
    start = F.struct(F.array().cast(kind).alias("blocks"), F.lit(True).alias("open"))

    def step(state: Column, i: Column) -> Column:
        piece = F.get(pieces, i)
        block = F.struct(
            F.regexp_extract(piece, BLOCK_HEAD, 1).alias("language"), F.regexp_replace(piece, BLOCK_HEAD, "").alias("code")
        )
        is_block = state["open"] & F.rlike(piece, F.lit(BLOCK_HEAD))
        blocks = F.when(is_block, F.concat(state["blocks"], F.array(block))).otherwise(state["blocks"])
        return F.struct(blocks.alias("blocks"), (~is_block).alias("open"))

    inner = F.when(F.size(pieces) > 2, F.sequence(F.lit(1), F.size(pieces) - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(inner, start, step, lambda state: state["blocks"])
