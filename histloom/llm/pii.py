"""Personal data by weak supervision.

Patterns find the base spans of four kinds, which always stay, and candidates of two more kinds.
Labelers (patterns, word lists and the context) vote on every candidate; a vote is yes, no or
none. Expectation maximisation estimates from the votes alone how reliable each labeler is, and
its posteriors train a logistic classifier over the votes and the form of the span, which
decides. Votes and forms are few, so all candidates of the corpus are counted by pattern in
Spark and the models are fitted on those counts: exact, and bounded by the number of patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.session import written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "number")
ROWS_AT_ONCE = 512

_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: Starting only where a run of digits starts finds the same matches without trying each digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS_AFTER = re.compile(r"[A-Za-z0-9]*")
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_NUMBER = re.compile(r"[0-9](?:[\x20./-]?[0-9]){7,}")

#: Words in front of personal data, by kind, and words in front of other numbers.
HINTS = {
    "email": "mail email contact write to from cc".split(),
    "ip": "ip host server address addr from client".split(),
    "card": "card visa mastercard amex credit debit pan karte carte tarjeta".split(),
    "phone": "phone tel telephone call mobile fax cell telefon téléphone teléfono".split(),
    "secret": "password passwd pwd pass token secret key apikey bearer credential auth".split(),
    "number": "account acct iban ssn passport konto compte cuenta id number".split(),
}
OTHER = set("version v license licence isbn issn page chapter order section doi art no nr figure".split())
_SHAPES = {
    "email": re.compile(r"[A-Za-z0-9][^@]*@[^@]+\.[A-Za-z]{2,6}"),
    "ip": re.compile(r"[1-9][0-9]*(\.(0|[1-9][0-9]*)){3}"),
    "card": re.compile(r"[3-6][0-9 -]+"),
    "phone": re.compile(r"\+[1-9][0-9 ().-]+"),
    "secret": re.compile(r"(AKIA|ASIA)[0-9A-Z]{16}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|gh[pousr][A-Za-z0-9]{36}"),
    "number": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}([ -][0-9]{4}){2,}"),
}
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[\W_]*$")
LABELERS = ("shape", "hint", "other", "assigned", "mixture", "apart")
NONE, NO, YES = 0, 1, 2
LENGTHS = (8, 12, 16, 20, 32, 40, 64)
DIGIT_SHARES = (0.1, 0.3, 0.5, 0.7, 0.95)


def _emails(text: str) -> list[tuple[int, int]]:
    found, last_end, last_at = [], 0, 0
    for m in _AT_DOMAIN.finditer(text):
        at = m.start()
        begin = max(last_end, last_at)
        start = begin + len(text[begin:at].rstrip(_LOCAL))
        last_at = at + 1
        if start < at:
            found.append((start, m.end()))
            last_end = m.end()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _is_card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(text: str) -> bool:
    return 9 <= sum(c in "0123456789" for c in text) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base spans, by kind, then start, in code points."""
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for kind, pattern, ok in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if ok(m[0])]
    return found


def _free(spans: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Those of `spans` (in order of start) that overlap none of `taken`."""
    out, taken, i = [], sorted(taken), 0
    for kind, start, end in spans:
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i == len(taken) or taken[i][0] >= end:
            out.append((kind, start, end))
    return out


def candidate_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the two further kinds that overlap no base span: words of 12 or more ASCII
    letters and digits, with both, and digit groups of 8 or more digits."""
    if not _DIGITS.search(text):
        return []
    taken = [(s, e) for _, s, e in base]
    secrets, end = [], 0
    for m in _DIGITS.finditer(text):
        if m.start() < end:
            continue
        start = end + len(text[end : m.start()].rstrip(_ALNUM))
        end = _LETTERS_AFTER.match(text, m.end()).end()
        if end - start >= 12 and not text[start:end].isdigit():
            secrets.append(("secret", start, end))
    secrets = _free(secrets, taken)
    numbers = [("number", m.start(), m.end()) for m in _NUMBER.finditer(text)]
    return secrets + _free(numbers, taken + [(s, e) for _, s, e in secrets])


def votes(text: str, kind: str, start: int, end: int) -> list[int]:
    """The votes of LABELERS on one span."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    word = _WORD_BEFORE.search(before)
    word = word[1].lower() if word else ""
    digits = sum(c in "0123456789" for c in span)
    letters = sum(c.isalpha() for c in span)
    mixed = digits >= 3 and (kind != "secret" or (digits >= len(span) / 8 and letters >= 2))
    tight = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return [
        YES if _SHAPES[kind].fullmatch(span) else NONE,
        YES if word in HINTS[kind] else NONE,
        NO if word in OTHER else NONE,
        YES if re.search(r"[=:][\x20\"']*$", before[-4:]) else NONE,
        YES if mixed else NO,
        YES if tight else NO,
    ]


def pattern_of(text: str, kind: str, start: int, end: int) -> int:
    """Votes and form of a span as one number."""
    code = 0
    for v in votes(text, kind, start, end):
        code = code * 3 + v
    share = sum(c in "0123456789" for c in text[start:end]) / max(1, end - start)
    code = code * (len(LENGTHS) + 1) + int(np.searchsorted(LENGTHS, end - start, side="right"))
    return code * (len(DIGIT_SHARES) + 1) + int(np.searchsorted(DIGIT_SHARES, share, side="right"))


def unpack(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (rows x labelers) and form numbers of pattern numbers."""
    forms = (len(LENGTHS) + 1) * (len(DIGIT_SHARES) + 1)
    form, rest = code % forms, code // forms
    columns = []
    for _ in LABELERS:
        columns.append(rest % 3)
        rest = rest // 3
    return np.stack(columns[::-1], axis=1), form


def reliabilities(seen: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of true spans, the probability of each vote given the truth (truth x labeler x
    vote), and the posterior of each row, by expectation maximisation.

    It starts from the balance of votes. Each labeler is taken to be better than chance by a
    prior of a few votes, which also keeps probabilities off 0.
    """
    balance = (seen == YES).sum(1) - 1.5 * (seen == NO).sum(1) - 1.0
    posterior = 1.0 / (1.0 + np.exp(-balance.astype(float)))
    hot = (seen[:, :, None] == np.arange(3)).astype(float)
    prior = np.array([[2.0, 2.0, 1.0], [2.0, 1.0, 2.0]])  # false spans, true spans
    share, chances = 0.5, np.zeros((2, seen.shape[1], 3))
    for _ in range(rounds):
        for truth, mass in ((0, (1 - posterior) * counts), (1, posterior * counts)):
            total = np.einsum("i,ijv->jv", mass, hot) + prior[truth]
            chances[truth] = total / total.sum(1, keepdims=True)
        share = float((posterior * counts).sum() + 1) / (counts.sum() + 2)
        logs = [np.einsum("ijv,jv->i", hot, np.log(chances[t])) for t in (0, 1)]
        gap = np.log(share) - np.log1p(-share) + logs[1] - logs[0]
        posterior = 1.0 / (1.0 + np.exp(-np.clip(gap, -30, 30)))
    return share, chances, posterior


def _features(seen: np.ndarray, form: np.ndarray) -> np.ndarray:
    shares = len(DIGIT_SHARES) + 1
    length, share = form // shares, form % shares
    parts = [np.ones((len(seen), 1)), (seen[:, :, None] == np.array([NO, YES])).reshape(len(seen), -1)]
    parts += [length[:, None] == np.arange(len(LENGTHS) + 1), share[:, None] == np.arange(shares)]
    return np.concatenate([p.astype(float) for p in parts], axis=1)


def classify(seen: np.ndarray, form: np.ndarray, counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Probabilities from a logistic regression that is trained to `target` by Newton steps."""
    x = _features(seen, form)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (p - target)) + w
        hess = (x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))


def fit(counts: dict[tuple[str, int], int]) -> dict[tuple[str, int], float]:
    """The score of each (kind, pattern), from how often each occurs in the corpus."""
    scores = {}
    for kind in KINDS:
        rows = sorted((code, n) for (k, code), n in counts.items() if k == kind)
        if not rows:
            continue
        codes, n = np.array([c for c, _ in rows]), np.array([float(n) for _, n in rows])
        seen, form = unpack(codes)
        _, _, posterior = reliabilities(seen, n)
        for code, p in zip(codes, classify(seen, form, n, posterior)):
            scores[kind, int(code)] = float(p)
    return scores


_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,pattern:int>>"
_FOUND = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
_SPAN_TYPE = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id and spans (kind, start, end, base, pattern) of every row."""
    kind_of = pa.list_(pa.struct([*_SPAN_TYPE, ("pattern", pa.int32())]))

    def row(text: str) -> list[dict]:
        base = base_spans(text)
        spans = [(*s, True) for s in base] + [(*s, False) for s in candidate_spans(text, base)]
        return [
            {"kind": k, "start": s, "end": e, "base": b, "pattern": pattern_of(text, k, s, e)} for k, s, e, b in spans
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                spans = pa.array([row(t) for t in part.column(1).to_pylist()], kind_of)
                yield pa.RecordBatch.from_arrays([part.column(0), spans], names=["_id", "spans"])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("_id"), text).mapInArrow(run, f"_id {kind}, spans {_SPANS}")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id and spans (kind, start, end, base, score) of every row, by kind as in KINDS, then start.

    Positions are code points, ends exclusive. Base spans are in whatever their score; others
    from `threshold` on. Null and empty texts have no spans, repeated rows have theirs each,
    other columns are not read, and an empty table gives no rows. All texts are read once.
    """
    rows = written(candidates(docs, id_col, text_col), "pii-candidates")
    each = rows.select(F.explode("spans").alias("s")).select("s.kind", "s.pattern")
    counted = each.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n"))
    # at most len(KINDS) * 3**len(LABELERS) * forms rows, whatever the corpus
    scores = fit({(r["kind"], r["pattern"]): r["n"] for r in counted.collect()})
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    kind_of = pa.list_(pa.struct([*_SPAN_TYPE, ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                scored = [{**s, "score": known[s["kind"], s.pop("pattern")]} for s in spans]
                out.append([s for s in scored if s["base"] or s["score"] >= threshold])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind_of)], names=[id_col, "spans"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, spans {_FOUND}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    return found.select(id_col, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
