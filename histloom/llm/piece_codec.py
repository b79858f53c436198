"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs, ordered by the score of the piece they
would make and then by position, and merges the best pair until no pair makes a piece. Symbols
that are no piece fall back to their bytes. A text is first cut where no piece of the
vocabulary can reach across (between a word and what follows it), which leaves the result as it
is and lets repeated words be looked up. The words that an Arrow batch brings are also encoded
by the sentencepiece library, and `agrees` says for each text whether both gave the same ids for
all its words. `whole=True` compares the ids of whole texts as well, at the cost of encoding
everything twice.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histloom.llm.memory import give_back

SPACE = "▁"
#: A word or a run of other signs, each with the spaces before it. Cuts depend on two characters.
#: The square sign counts as another sign, since some vocabularies join it to a full stop.
WORDS = re.compile(rf"{SPACE}*[^\W\d_²{SPACE}]+|{SPACE}*(?:[\W\d_²](?<!{SPACE}))+|{SPACE}+")
#: If a piece holds signs of both kinds: only in front of spaces.
SPACED = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHED_WORDS = 400_000
CACHED_LENGTH = 48
#: Words up to this length have their agenda in a list, longer ones in a heap.
SHORT = 24
NO_PIECE = (math.inf, -1)
#: Texts are handed to the library in groups of this many, whatever the size of an Arrow batch.
TEXTS_AT_ONCE = 128


class PieceCodec:
    """One vocabulary: `encode` by agenda, `check` by the library, `decode` by the library."""

    def __init__(self, model_file: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.unknown = lib.unk_id()
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.pieces[piece] = (-lib.get_score(i), i)
        self.cut = self._cut()
        self._seen: dict[str, bytes] = {}  # ids as 32-bit numbers, which join and hold cheaply
        self._new_words: dict[str, bytes] = {}
        self.wrong: set[str] = set()

    def _cut(self):
        """The finest cut that no piece reaches across; None if there is none, or line ends merge."""
        if any("\n" in p for p in self.pieces) or "\n" not in self.library.normalize("a\nb"):
            return None
        for pattern in (WORDS, SPACED):
            if all(len(pattern.findall(p)) == 1 for p in self.pieces):
                return pattern
        return None

    def words(self, text: str) -> list[str]:
        shown = self.library.normalize(text)
        return self.cut.findall(shown) if self.cut else [shown]

    def encode(self, text: str) -> list[int]:
        return _numbers(self.encode_bytes(text)).tolist()

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        words, seen = self.words(text), self._seen
        try:
            return b"".join([seen[w] for w in words])
        except KeyError:
            return b"".join([seen.get(w) or self._new(w) for w in words])

    def _new(self, word: str) -> bytes:
        ids = self._new_words[word] = np.array(self.agenda(word), np.int32).tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self._seen) >= CACHED_WORDS:
                self._seen.clear()
            self._seen[word] = ids
        return ids

    def forget(self) -> None:
        """Give back the memory of the words seen; Python workers live on after a task."""
        self._seen, self._new_words = {}, {}

    def agenda(self, word: str) -> list[int]:
        """Merge the pair of the highest score, of equal ones the leftmost, until none is left.

        The agenda of a short word is a plain list, one place for each pair of neighbours.
        """
        if len(word) <= SHORT:
            return self._short_agenda(word)
        pieces, symbols, n = self.pieces, list(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = []
        for i in range(n - 1):
            if (found := pieces.get(word[i : i + 2])) is not None:
                pairs.append((found[0], i, i + 1, 2))
        heapq.heapify(pairs)
        while pairs:
            _, left, right, size = heapq.heappop(pairs)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one of the two has been merged since
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                self._offer(pairs, symbols, left, nxt)
            if (prev := before[left]) >= 0:
                self._offer(pairs, symbols, prev, left)
        return [i for s in symbols if s for i in self._ids(s)]

    def _short_agenda(self, word: str) -> list[int]:
        get, symbols = self.pieces.get, list(word)
        scores = [get(a + b, NO_PIECE)[0] for a, b in zip(symbols, symbols[1:])]
        while scores and (best := min(scores)) != math.inf:
            at = scores.index(best)
            symbols[at] += symbols.pop(at + 1)
            del scores[at]
            if at < len(scores):
                scores[at] = get(symbols[at] + symbols[at + 1], NO_PIECE)[0]
            if at:
                scores[at - 1] = get(symbols[at - 1] + symbols[at], NO_PIECE)[0]
        return [i for s in symbols for i in self._ids(s)]

    def _offer(self, pairs, symbols, left: int, right: int) -> None:
        joined = symbols[left] + symbols[right]
        if (found := self.pieces.get(joined)) is not None:
            heapq.heappush(pairs, (found[0], left, right, len(joined)))

    def _ids(self, symbol: str) -> list[int]:
        if (found := self.pieces.get(symbol)) is not None:
            return [found[1]]
        if self.bytes:
            return [self.bytes[b] for b in symbol.encode("utf-8")]
        return [self.unknown]

    def check(self, texts: list[str], ids: list[bytes], whole: bool) -> list[bool]:
        """Whether the library agrees, for each text: on every word since the last call, and on
        the ids of the whole text if asked."""
        self._check_words()
        agrees = [True] * len(texts)
        if whole or self.cut is None:
            found = self.library.encode(texts, num_threads=1)
            agrees = [a == _numbers(b).tolist() for a, b in zip(found, ids)]
        if self.wrong:
            agrees = [ok and self.wrong.isdisjoint(self.words(t)) for ok, t in zip(agrees, texts)]
        return agrees

    def _check_words(self) -> None:
        """One call of the library for all new words, with line ends in between: no piece holds a
        line end, so a word's ids are what stands between two of them."""
        words, self._new_words = self._new_words, {}
        if not words or self.cut is None:
            return
        end = self._ids("\n")
        text = "".join("\n" + w.replace(SPACE, " ") for w in words)
        first, gap = (np.array(x, np.int32).tobytes() for x in (self.agenda(SPACE), end))
        if self.library.encode(text) != _numbers(first + b"".join(gap + ids for ids in words.values())).tolist():
            one = lambda w: self.library.encode("\n" + w.replace(SPACE, " "))
            self.wrong |= {w for w, ids in words.items() if one(w) != _numbers(first + gap + ids).tolist()}

    def decode(self, ids: bytes) -> str:
        return self.library.decode(_numbers(ids).tolist()) if ids else ""


def _numbers(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.int32)


@lru_cache(maxsize=4)
def codec(model_file: str) -> PieceCodec:
    """One codec per Python worker and model, with its words."""
    return PieceCodec(model_file)


def _lists(rows: list[bytes]) -> pa.Array:
    ends = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_numbers(b"".join(rows))))


def encode_decode(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = False
) -> DataFrame:
    """id, ids (array of int), decoded (the library's text of those ids) and agrees.

    `model_file` must be at that path on every executor. Null and empty texts have no ids and
    decode to the empty text. Repeated rows are encoded each; other columns are not read. A long
    text is one row of work, and the memory of a task is bounded by the longest texts of
    TEXTS_AT_ONCE rows.
    """
    kind = docs.select(id_col).schema[0].dataType
    schema = T.StructType([
        T.StructField(id_col, kind),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
        T.StructField("agrees", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = part.column(1).to_pylist()
                ids = [own.encode_bytes(t) for t in texts]
                columns = [
                    part.column(0), _lists(ids), pa.array([own.decode(i) for i in ids], pa.string()),
                    pa.array(own.check(texts, ids, whole), pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded", "agrees"])
        own.forget()
        give_back()

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text")
    return docs.select(f"`{id_col}`", text).mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What identifies an encoding: the number of ids, and digests of the ids and the text."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )
