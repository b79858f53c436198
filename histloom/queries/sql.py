"""SQL pieces shared by the comparison queries."""

from __future__ import annotations

from histloom import constants as K

WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_NOT_WORD = r"[^\p{L}\p{N}_]"
NUMBER = r"\p{Nd}+(?:\.\.\p{Nd}+)?"


def q(text: str) -> str:
    """A quoted SQL string."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def sentences(x: str) -> str:
    cut = f"regexp_replace({strip(x)}, '([.!?]){WS}+', '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({cut}, chr(1)), lambda s: s <> '')"


def _doubled(x: str) -> str:
    return f"regexp_replace(lower({x}), '({_NOT_WORD})', '\\1\\1', 'g')"


def _signal(words: str) -> str:
    words = words.replace("'", "''").replace(" ", "  ")
    return q(f"(?:^|{_NOT_WORD})(?:{words})(?:{_NOT_WORD}|$)")


def bonus(x: str) -> str:
    return f"(least(length({x}), 200) // 80)"


def score_by_class(x: str) -> str:
    hits = [f"regexp_matches({_doubled(x)}, {_signal(w)})::INT" for w in K.SIGNAL_WORDS]
    hits.append(f"regexp_matches({_doubled(x)}, {q(f'(?:^|{_NOT_WORD}){NUMBER}(?:{_NOT_WORD}|$)')})::INT")
    return f"(2 * ({' + '.join(hits)}) + {bonus(x)})::INT"


def score_by_match(x: str) -> str:
    # one alternation over all words and numbers; blanks and apostrophes stand doubled
    words = "|".join(w.replace("'", "''").replace(" ", "  ") for w in K.SIGNAL_WORDS)
    pattern = q(f"(?:^|{_NOT_WORD})(?:{words}|{NUMBER})(?:{_NOT_WORD}|$)")
    return f"(2 * len(regexp_extract_all({_doubled(x)}, {pattern})) + {bonus(x)})::INT"


def with_excerpt(
    source: str, text: str, score=score_by_match, max_chars: int = 900, least: int = 2
) -> str:
    """Common table expressions that add the column `review_excerpt` to table `source` as `cut`."""
    scored = (
        f"list_sort(list_transform(sents, lambda s, i: {{'score': {score('s')}, 'at': i, 's': s}}), 'DESC')"
    )
    state = "{'used': 0::BIGINT, 'n': 0::BIGINT, 'done': false, 'chosen': [e.s]}"
    used = "acc.used + length(e.chosen[1]) + 1"
    taken = (
        f"{{'used': {used}, 'n': acc.n + 1, "
        f"'done': {used} >= {max_chars * K.EXCERPT_ENOUGH} and acc.n + 1 >= {least}, "
        f"'chosen': list_concat(acc.chosen, e.chosen)}}"
    )
    start = "{'used': 0::BIGINT, 'n': 0::BIGINT, 'done': false, 'chosen': []::VARCHAR[]}"
    fold = (
        f"list_reduce(list_transform({scored}, lambda e: {state}), lambda acc, e: "
        f"case when not acc.done and {used} <= {max_chars} then {taken} else acc end, {start}).chosen"
    )
    picked = f"left(array_to_string(list_filter(sents, lambda s: list_contains(chosen, s)), ' '), {max_chars})"
    return f"""
split_ as materialized (select *, {sentences(text)} sents from {source}),
fold_ as materialized (select *, {fold} chosen from split_),
cut as (select * exclude (sents, chosen), case when {text} is null or {strip(text)} = '' then ''
  when len(sents) <= {least} or len(chosen) = 0 then left({text}, {max_chars}) else {picked} end review_excerpt from fold_)"""


def draw_key(seed: int, x: str) -> str:
    return f"md5('{seed}:' || {x}::VARCHAR)"
