"""Text expressions: sentences, sentence scores, excerpts, tags, sections, product lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom import constants as K

_BEFORE, _AFTER = f"(?<![{K.WORD}])", f"(?![{K.WORD}])"
SIGNAL_CLASSES = [f"{_BEFORE}(?:{w}){_AFTER}" for w in [*K.SIGNAL_WORDS, K.SIGNAL_NUMBER]]


def _by_first_letter(words: list[str]) -> str:
    """One alternation with the words grouped by first letter, so that a place in a text is
    compared with each first letter once, not with each word."""
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())


ANY_SIGNAL = (
    f"{_BEFORE}(?:{_by_first_letter('|'.join(K.SIGNAL_WORDS).split('|'))}|{K.SIGNAL_NUMBER}){_AFTER}"
)


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode spaces included."""
    return F.trim(c, F.lit(K.SPACES))


def squeeze(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends. Single blanks are no match, so
    most of a text is passed over."""
    return strip(F.regexp_replace(c, f"[{K.SPACE}]{{2,}}|(?! )[{K.SPACE}]", " "))


def normalize_text(c: Column, max_chars: int | None = None) -> Column:
    """Lower case with single blanks, cut to `max_chars`; '' for a missing text."""
    out = F.lower(squeeze(F.coalesce(c, F.lit(""))))
    return out if max_chars is None else F.left(out, F.lit(max_chars))


def first_nonempty(*cols: Column) -> Column:
    """The first value that is neither null nor ''. The last one is taken as it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def usable_text(c: Column) -> Column:
    """True for a text that is neither blank nor a word for a missing value."""
    return F.coalesce(~F.lower(strip(c)).isin(K.EMPTY_TEXTS), F.lit(False))


def sentences(c: Column) -> Column:
    """Sentences: cut at white space that follows `.`, `!` or `?`."""
    return F.filter(F.split(strip(c), f"(?<=[.!?])[{K.SPACE}]+"), lambda s: s != "")


def _length_bonus(s: Column) -> Column:
    return F.floor(F.least(F.length(s), F.lit(K.LENGTH_BONUS_CAP)) / K.LENGTH_BONUS_STEP).cast("int")


def sentence_score_by_class(s: Column) -> Column:
    """Two points for each of the six signal classes found, and up to two for length."""
    # one scan finds all signals; no word is in two classes, so the short list of hits tells which
    found = F.concat_ws(" ", F.regexp_extract_all(F.lower(s), F.lit(ANY_SIGNAL), F.lit(0)))
    hits = [found.rlike(p).cast("int") for p in SIGNAL_CLASSES]
    return sum(hits[1:], hits[0]) * K.SIGNAL_POINTS + _length_bonus(s)


def sentence_score_by_match(s: Column) -> Column:
    """Two points for each signal match, and up to two for length."""
    return F.regexp_count(F.lower(s), F.lit(ANY_SIGNAL)) * K.SIGNAL_POINTS + _length_bonus(s)


def with_excerpt(
    df: DataFrame,
    text: str,
    into: str,
    max_chars: int = K.EXCERPT_CHARS,
    min_sentences: int = K.EXCERPT_MIN_SENTENCES,
    score=sentence_score_by_match,
) -> DataFrame:
    """Add the best sentences of a text, in text order, within a budget of characters.

    A blank text gives ''; one of up to `min_sentences` sentences gives its first `max_chars`
    characters. Otherwise sentences are taken from the highest score down (later ones first
    on ties) while they fit, until 70% of the budget and `min_sentences` are reached. The
    budget bounds what the fold keeps, so each row stands alone: no shuffle, no Python.
    """
    budget = F.lit(max_chars)
    scored = F.transform(
        F.col("_sentences"), lambda s, i: F.struct(score(s).alias("score"), i.alias("at"), s.alias("s"))
    )
    start = F.struct(
        F.array().cast("array<string>").alias("chosen"),
        F.lit(0).alias("used"),
        F.lit(False).alias("done"),
    )

    def take(state: Column, x: Column) -> Column:
        used = state["used"] + F.length(x["s"]) + 1
        fits = ~state["done"] & (used <= budget)
        chosen = F.array_append(state["chosen"], x["s"])
        enough = (used >= F.lit(max_chars * K.EXCERPT_ENOUGH)) & (F.size(chosen) >= min_sentences)
        return F.when(
            fits, F.struct(chosen.alias("chosen"), used.alias("used"), enough.alias("done"))
        ).otherwise(state)

    many = F.size("_sentences") > min_sentences
    staged = df.withColumn("_sentences", sentences(F.col(text)))
    staged = staged.withColumn("_ranked", F.when(many, F.sort_array(scored, asc=False)))
    staged = staged.withColumn(
        "_chosen", F.when(many, F.aggregate("_ranked", start, take, lambda st: st["chosen"]))
    )
    kept = F.filter("_sentences", lambda s: F.array_contains(F.col("_chosen"), s))
    picked = F.left(F.concat_ws(" ", kept), budget)
    whole = F.left(F.col(text), budget)
    blank = F.coalesce(strip(F.col(text)) == "", F.lit(True))
    value = F.when(blank, F.lit("")).when(F.size("_chosen") > 0, picked).otherwise(whole)
    return staged.withColumn(into, value).drop("_sentences", "_ranked", "_chosen")


def item_ids(c: Column) -> Column:
    """Every word of ten capital letters and digits, in order."""
    return F.regexp_extract_all(
        F.coalesce(c, F.lit("")), F.lit(f"{_BEFORE}([A-Z0-9]{{10}}){_AFTER}"), F.lit(1)
    )


def first_tagged(c: Column, tag: str) -> Column:
    """Text inside the first pair of tags, else the whole text; trimmed."""
    found = F.regexp_extract_all(c, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return strip(F.coalesce(F.try_element_at(found, F.lit(1)), c))


def last_tagged(c: Column, tag: str) -> Column:
    """Text inside the last pair of tags, else the whole text; trimmed."""
    found = F.regexp_extract_all(c, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return strip(F.coalesce(F.try_element_at(found, F.lit(-1)), c))


def section_line(c: Column, heading: str) -> Column:
    """The line under a heading; the whole text, trimmed, if there is none or it is empty."""
    pattern = rf"(?d){heading}[{K.SPACE}]*\n(.*)"
    return first_nonempty(F.regexp_extract(c, pattern, 1), strip(c))


def without_keyword_sentences(c: Column, keywords: Sequence[str], fallback: str) -> Column:
    """Drop the sentences that contain a keyword; `fallback` if none is left.

    Each sentence is lower-cased once and searched for plain keywords, and the sentences left are
    read once: as none of them is blank, joined they are only empty if there is none.
    """
    parts = F.split(c, f"(?<=[.!?])[{K.SPACE}]+")
    both = F.transform(parts, lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))

    def free(p: Column) -> Column:
        return reduce(lambda no, k: no & ~F.contains(p["low"], F.lit(k)), keywords, strip(p["s"]) != "")

    return F.coalesce(F.nullif(F.concat_ws(" ", F.filter(both, free)["s"]), F.lit("")), F.lit(fallback))


def product_text(title: Column, category: Column, brand: Column, price: Column) -> Column:
    """One line for a product, `unknown` for a missing brand or price."""

    def clean(c: Column) -> Column:
        return strip(F.coalesce(c, F.lit("")))

    return F.concat(
        F.lit("Title: "), clean(title),
        F.lit(" | Category: "), clean(category),
        F.lit(" | Brand: "), first_nonempty(clean(brand), F.lit("unknown")),
        F.lit(" | Price: "), F.coalesce(price.cast("string"), F.lit("unknown")),
    )


def review_line(title: Column, rating: Column, review: Column) -> Column:
    """One line for a review."""
    body = strip(F.coalesce(review, F.lit("")))
    return F.concat(
        F.lit("- "), F.coalesce(title, F.lit("None")),
        F.lit(" | Rating: "), F.coalesce(rating.cast("string"), F.lit("None")),
        F.lit("/5 | Review: "), first_nonempty(body, F.lit("(No review provided)")),
    )


def history_text(history: Column) -> Column:
    """The review lines of a nested history, in order."""
    return F.concat_ws(
        "\n",
        F.transform(
            history, lambda r: review_line(r["product"]["title"], r["rating"], r["review_excerpt"])
        ),
    )


def bullet(label: Column, detail: Column) -> Column:
    return F.concat(F.lit("- "), label, F.lit(" ("), detail, F.lit(")"))


def answers_match(a: Column, b: Column) -> Column:
    return F.lower(strip(a)) == F.lower(strip(b))


def contains_reward(answer: Column, item_id: Column, title: Column) -> Column:
    """1.0 if the answer names the true item by id or title; empty ones never match."""
    low = F.lower(answer)

    def named(c: Column) -> Column:
        return F.coalesce((c != "") & F.contains(low, F.lower(c)), F.lit(False))

    return F.when(named(item_id) | named(title), F.lit(1.0)).otherwise(F.lit(0.0))


def strip_ansi(c: Column) -> Column:
    """Without terminal escape sequences."""
    return F.regexp_replace(c, K.ANSI_ESCAPE, "")


def first_lines(c: Column, n: int) -> Column:
    """The first `n` lines, and of those the ones that are not blank."""
    lines = F.slice(F.split(c, "\n"), 1, n)
    return F.concat_ws("\n", F.filter(lines, lambda x: strip(x) != ""))


def truncate_tokens(c: Column, n: int) -> Column:
    """The first `n` words. `n` = -1 keeps the text."""
    if n == -1:
        return c
    return F.concat_ws(" ", F.slice(F.split(strip(c), f"[{K.SPACE}]+", n + 1), 1, n))
