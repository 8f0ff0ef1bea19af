"""Token counts with a whole-token shortcut.

A sentencepiece BPE model whose pieces hold the space mark only in front never merges across the place where a
mark follows another character, nor across a character that no piece of several characters holds. So a text falls
apart, exactly, into pre-tokens. ``prove`` encodes every piece that can be a whole pre-token with the library itself
and keeps those that come back as that one token; texts then count such pre-tokens directly, and only the rest is
merged by the library, once for each distinct pre-token that a worker still remembers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy

MARK = "▁"
#: Distinct pre-tokens that a worker remembers, and the longest one that it keeps.
REMEMBERED, LONGEST = 250_000, 64


class _Counts(dict):
    """Pre-token -> tokens; asks the library for what is not known, and forgets all when it grows too large."""

    def __init__(self, known: dict, merge):
        super().__init__(known)
        self.known, self.merge, self.merged = known, merge, 0

    def __missing__(self, word: str) -> int:
        self.merged += 1
        n = self.merge(word)
        if len(word) <= LONGEST:
            if len(self) > len(self.known) + REMEMBERED:
                self.clear()
                self.update(self.known)
            self[word] = n
        return n


class TokenCounter:
    """Counts a text's tokens as the library's ``encode`` does, without begin or end tokens."""

    def __init__(self, model_file: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        self.splits = self._sound(pieces)
        # a new line stands alone if no longer piece holds it, and the library must give it one token
        self.lines = self.splits and not any("\n" in p and len(p) > 1 for p in pieces) and len(self.sp.encode("a\nb")) == len(self.sp.encode("a")) + 1 + self._bare("b")
        self.spaced = _Counts(self.prove(pieces), lambda w: len(self.sp.encode(w, num_threads=1)))
        self.bare = _Counts({}, self._bare)

    def _sound(self, pieces: list[str]) -> bool:
        """Whether pre-tokens are independent under this model: no mark behind another character, the text kept as it is."""
        as_is = all(self.sp.encode(t) == self.sp.encode(t.replace(" ", MARK)) for t in ("a b", "  a", "b  "))
        return as_is and not any(MARK in p.lstrip(MARK) for p in pieces) and self.sp.decode(self.sp.encode("a  b ")) == "a  b "

    def _bare(self, word: str) -> int:
        return len(self.sp.encode("\n" + word, num_threads=1)) - len(self.sp.encode("\n", num_threads=1))

    def prove(self, pieces: list[str]) -> dict[str, int]:
        """The pre-tokens (without their mark) that the library encodes as one token."""
        words = [p[1:] for p in pieces if p[0] == MARK and len(p) > 1 and MARK not in p[1:]]
        return {w: 1 for w, ids in zip(words, self.sp.encode(words), strict=True) if len(ids) == 1}

    def _slow(self, line: str, counts: _Counts) -> int:
        """A line with runs of spaces: each run goes with the word behind it."""
        total = 0
        for m in re.finditer(r"( *)([^ ]+)| +", line):
            run, word = m.group(1), m.group(2)
            if word is None:
                total += len(self.sp.encode(m.group()[1:])) if len(m.group()) > 1 else self._mark()
            elif not run:
                total += counts[word]
            elif len(run) == 1:
                total += self.spaced[word]
            else:
                total += len(self.sp.encode(run[1:] + word))
        return total

    @lru_cache(1)  # noqa: B019  one counter lives as long as its worker
    def _mark(self) -> int:
        """Tokens of a single mark, which the library never gives alone: behind a new line it stands by itself."""
        return len(self.sp.encode("\n ")) - len(self.sp.encode("\n"))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.lines:
            return len(self.sp.encode(text, num_threads=1))
        text = text.replace(MARK, " ")
        total, spaced = -1, self.spaced.__getitem__
        for k, line in enumerate(text.split("\n")):
            total += 1
            words = (line if k else " " + line).split(" ")
            if "" in words[1:] or len(words) == 2 and not words[0] and not words[1]:
                total += self._slow(line if k else " " + line, self.bare)
                continue
            if words[0]:
                total += self.bare[words[0]]
            total += sum(map(spaced, words[1:]))
        return total


@lru_cache(2)
def counter(model_file: str) -> TokenCounter:
    """One counter for each worker process, reused by its tasks."""
    return TokenCounter(model_file)


def token_counts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Tokens of every row's whole text: ``<id_col>, n_bytes, n_tokens, over_limit``.

    A null text counts as empty: 0 bytes, 0 tokens, not over. Null ids and repeated rows pass through, a row
    each; other columns are not read, whatever their names; an empty table gives an empty table. One narrow pass:
    no shuffle, and a worker holds an Arrow batch and its remembered pre-tokens.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file)
        for b in batches:
            n = [c.count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(tidy(count), f"id {id_type}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
