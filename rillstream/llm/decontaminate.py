"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton of all items is built once on the driver from a benchmark of checked size (in blocks beyond that) and
sent to the executors. Training texts stream through it: the state and the length of the longest suffix that
occurs in some item are tracked word by word. A word lies in a window of an item exactly if it lies in a
match at least as long as the window, so spans follow from the lengths alone.

Two exact filters keep most words out of the automaton: a word that no item has resets it, and a stretch in which two
neighbouring words are never neighbours in an item is cut there; a stretch shorter than the shortest window holds none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import Scratch, bound_batches, numbered

#: A-Z are lowered, and all but 0-9, a-z and bytes of other characters become spaces.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Words of benchmark items in one automaton; a larger benchmark is taken in blocks of this size, a pass each.
BLOCK_WORDS = 200_000


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


class Automaton:
    """Generalised suffix automaton of token lists, with the windows and items of each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: shortest window: what is shorter can't be hit
        self.shortest = min([window, *(len(w) for _, w in items if w)])
        pairs = set()
        ends: dict[int, list[int]] = {}
        for k, (_, item) in enumerate(items):
            state, ids = 0, [self.vocab.setdefault(w, len(self.vocab)) for w in item]
            pairs.update(zip(ids, ids[1:]))
            for w in ids:
                state = self._extend(state, w)
            ends[k] = ids
        self.bits = 1 << max(16, (4 * len(pairs)).bit_length())
        self.near = np.zeros(self.bits, bool)
        if pairs:
            p = np.array(sorted(pairs), np.uint64)
            self.near[self._pair(p[:, 0], p[:, 1])] = True
        self._mark(ends)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)) & np.uint64(self.bits - 1)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def _mark(self, ends: dict[int, list[int]]) -> None:
        """``whole``: states where an item shorter than the window ends, with its length; ``held``: the items whose windows a state's strings are."""
        whole: dict[int, list[tuple[int, int]]] = {}
        held: dict[int, set[int]] = {}
        for k, ids in ends.items():
            state = size = 0
            for w in ids:
                state, size = self.next[state][w], size + 1
                while self.length[self.link[state]] >= self.window:  # down to the state that holds the window's own string
                    state = self.link[state]
                    size = self.length[state]
                if size >= self.window:
                    held.setdefault(state, set()).add(k)
            if 0 < len(ids) < self.window:
                whole.setdefault(state, []).append((len(ids), k))
        self.held = {s: tuple(v) for s, v in held.items()}
        # a state ends every short item that a state up its links ends
        self.whole: dict[int, tuple[tuple[int, int], ...]] = {}
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if found := (*whole.get(s, ()), *self.whole.get(self.link[s], ())):
                self.whole[s] = found

    def spans(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Stretches of hit words (first, behind the last; ascending, apart) and the items with a window among them."""
        n = len(doc)
        if n < self.shortest or not self.vocab:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, doc, [-1] * n), np.int64, n)
        known = ids >= 0
        joined = known[1:] & known[:-1]
        at = np.flatnonzero(joined)
        if at.size:
            joined[at] = self.near[self._pair(ids[at].astype(np.uint64), ids[at + 1].astype(np.uint64))]
        # stretches: words joined to their neighbours, or alone if an item may be one word
        breaks = np.flatnonzero(~joined) + 1
        starts, stops = np.concatenate(([0], breaks)), np.concatenate((breaks, [n]))
        keep = (stops - starts >= self.shortest) & known[starts]
        out: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, b in zip(starts[keep].tolist(), stops[keep].tolist()):
            self._stream(ids[a:b].tolist(), a, out, items)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(out):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items

    def _stream(self, ids: list[int], at: int, out: list[tuple[int, int]], items: set[int]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for i, w in enumerate(ids, at + 1):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if (q := nxt[state].get(w)) is None:
                size = 0
                continue
            state, size = q, size + 1
            if size >= window:
                out.append((i - size, i))
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                items.update(self.held.get(s, ()))
            for short, k in self.whole.get(state, ()):
                if short <= size:
                    out.append((i - short, i))
                    items.add(k)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Automaton]:
    """Automata of at most ``BLOCK_WORDS`` words (one item may be longer); the items come to the driver a block at a time."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for name, text in benchmark.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        block.append((name if name is not None else "", words(text)))
        size += len(block[-1][1])
        if size >= BLOCK_WORDS:
            yield Automaton(block, window)
            block, size = [], 0
    if block:
        yield Automaton(block, window)


def _scan(spark: SparkSession, df: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int) -> DataFrame:
    """``id, text, rest..., spans, items`` of ``df``'s rows (columns id, text, ...): merged over the benchmark's blocks."""
    df = df.select("*", F.lit(None).cast("array<array<int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for automaton in blocks(benchmark, item_col, item_text_col, window):
        sent = spark.sparkContext.broadcast(automaton)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = pa.Table.from_batches([b])
                spans, items = [], []
                for text, old, had in zip(t["text"].to_pylist(), t["spans"].to_pylist(), t["items"].to_pylist()):
                    s, k = sent.value.spans(words(text))
                    names = {sent.value.names[i] for i in k}
                    spans.append(merge([*map(tuple, old or ()), *s]))
                    items.append(sorted(names.union(had or ())))
                for name, column, kind in (("spans", spans, pa.list_(pa.list_(pa.int32()))), ("items", items, pa.list_(pa.string()))):
                    t = t.set_column(t.column_names.index(name), name, pa.array(column, kind))
                yield from t.to_batches()

        df = df.mapInArrow(scan, df.schema)
    return df


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(
    spark: SparkSession, df: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Hits of every document: ``<id_col>, n_words, n_hit, n_items, items_sha256, contaminated, spans, items``.

    A null or wordless text has no words and no hits; a null item id counts as the empty name, and an item without
    words has no window. Repeated documents are judged one by one; repeated item ids count once. Without items nothing
    is hit. Spans are word positions, first and behind the last.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hit, hashed = [], [], []
            for text, spans, items in zip(b["text"].to_pylist(), b["spans"].to_pylist(), b["items"].to_pylist()):
                n.append(len(words(text)))
                hit.append(sum(y - x for x, y in spans or ()))
                hashed.append(hashlib.sha256(",".join(items or ()).encode()).hexdigest())
            spans = pa.array([x or [] for x in b["spans"].to_pylist()], pa.list_(pa.list_(pa.int32())))
            items = pa.array([x or [] for x in b["items"].to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(hashed), spans, items], ["id", "n_words", "n_hit", "items_sha256", "spans", "items"])

    id_type = df.schema[id_col].dataType.simpleString()
    scanned = _scan(spark, rows, benchmark, item_col, item_text_col, window)
    out = scanned.mapInArrow(count, f"id {id_type}, n_words long, n_hit long, items_sha256 string, spans array<array<int>>, items array<string>")
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans", "items")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return (b"".join(out) + raw[done:]).decode()


def decontaminate(
    spark: SparkSession, df: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.8, text_col: str = "text", n_chars_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Documents without benchmark passages, in the columns of ``df``.

    Spans of ``window`` matching words or more (or a whole shorter item) are cut out of the text, again and again until no
    window is left; a document of whose words more than ``coverage`` are hit goes as a whole. Clean documents,
    empty and null texts stay as they are, and so do null ids, repeated rows, each judged by itself, and other columns, whatever their
    names. ``n_chars_col``, if there, is set anew where a text is cut. Without items nothing is cut.

    One block of items is one narrow pass. Of more blocks the spans are gathered first, so that a text is judged and cut by all; rows that were
    cut, which are few, go through all blocks again until nothing is hit.
    """
    bound_batches(df.sparkSession)
    sent = [spark.sparkContext.broadcast(a) for a in blocks(benchmark, item_col, item_text_col, window)]
    if not sent:
        return df
    at = df.columns.index(text_col)
    n_at = df.columns.index(n_chars_col) if n_chars_col in df.columns else None
    rows = numbered(df)

    def cut(batches: Iterator[pa.RecordBatch], whole: bool = True) -> Iterator[pa.RecordBatch]:
        """Cuts by the spans of the last column, or of the only block until none is left, and says in its place whether a text was cut; ``whole``: documents may go."""
        for b in batches:
            columns = b.columns
            texts, found = columns[at].to_pylist(), columns[-1].to_pylist()
            sizes = columns[n_at].to_pylist() if n_at is not None else None
            keep, hit = [True] * len(texts), [False] * len(texts)
            for k, text in enumerate(texts):
                spans = [*map(tuple, found[k] or ())] if len(sent) > 1 else sent[0].value.spans(words(text))[0]
                if not spans:
                    continue
                if whole and sum(y - x for x, y in spans) > coverage * len(words(text)):
                    keep[k] = False
                    continue
                hit[k] = True
                while spans:
                    text = without(text, spans)
                    spans = sent[0].value.spans(words(text))[0] if len(sent) == 1 else []
                texts[k] = text
                if sizes is not None:
                    sizes[k] = len(text)
            if any(hit):
                columns[at] = pa.array(texts, columns[at].type)
                if sizes is not None:
                    columns[n_at] = pa.array(sizes, columns[n_at].type)
            columns[-1] = pa.array(hit)
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], "hit"]).filter(pa.array(keep))

    none = F.lit(None).cast("array<array<int>>").alias("spans")
    schema = StructType([*rows.schema.fields, StructField("hit", BooleanType())])
    if len(sent) == 1:
        return rows.select("*", none).mapInArrow(cut, schema).drop("hit").toDF(*df.columns)
    scratch, settled = Scratch(spark, "decontaminate"), []
    while True:
        spotted = rows.select("*", none)
        for one in sent:

            def spot(batches: Iterator[pa.RecordBatch], one=one) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    both = zip(b.columns[at].to_pylist(), b.columns[-1].to_pylist())
                    spans = [merge([*map(tuple, old or ()), *one.value.spans(words(text))[0]]) for text, old in both]
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(spans, pa.list_(pa.list_(pa.int32())))], b.schema.names)

            spotted = spotted.mapInArrow(spot, spotted.schema)
        first = not settled
        done = scratch.table(spotted.mapInArrow(lambda batches, whole=first: cut(batches, whole), schema), f"round-{len(settled)}")
        settled.append(done.where("NOT hit").drop("hit"))
        rows = done.where("hit").drop("hit")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, settled).toDF(*df.columns)
