"""Documents cut into chunks, and search in them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from histloom import constants as K


def chunks(text: Column, size: int = K.CHUNK_CHARS) -> Column:
    """Consecutive pieces of at least `size` characters that end with white space, in order.

    The last piece may be shorter. An empty text is one empty piece.
    """
    gap = r" \t\r\n"
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{{size - 1}}}[^{gap}]*[{gap}]|.+"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(pieces)


def search_pattern(query: str) -> str | None:
    """The words of a query as pattern for normalised text; `*` stands for anything."""
    pattern = " "
    for token in re.findall(r"[\w*]+", query.lower()):
        if token == "*":
            pattern = pattern.removesuffix(" ") + ".* "
        else:
            pattern += token.replace("*", ".*") + " "
    return pattern if pattern.strip() else None


def words_only(c: Column) -> Column:
    """The words of a text in lower case with single blanks, one at each end. A single blank
    between words is no match, so most gaps are passed over."""
    gaps = f"[^{K.WORD}]{{2,}}|(?! )[^{K.WORD}]"
    return F.concat(F.lit(" "), F.lower(F.trim(F.regexp_replace(c, gaps, " "))), F.lit(" "))


def find_chunk(pieces: Column, query: str, start: Column) -> Column:
    """The index of the first piece with the query, from `start` on and then from the top."""
    pattern = search_pattern(query)
    if pattern is None:
        return F.lit(None).cast("int")
    n = F.size(pieces)
    steps = F.transform(
        pieces, lambda p, i: F.when(words_only(p).rlike(pattern), F.pmod(i - start, n))
    )
    return F.pmod(F.array_min(steps) + start, n).cast("int")
