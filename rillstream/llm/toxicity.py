"""Toxicity by a factorisation machine over hashed terms.

A document's terms are its words and their first four and five letters, hashed into a fixed number of slots. Features are the
slots that go with the label in a bounded sample of labelled rows, each by itself, and those that do so only in pairs: the common
slots whose occurring together, more or less than their shares say, differs most between the classes, where a machine with them does
better on a fifth of the sample that it did not learn from. A factorisation machine gives each a
weight and a vector, so that a pair of terms (an insult with the mention of a group) can weigh more than both alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, bound_batches, numbered, quoted, tidy
from .decontaminate import _WORDS

#: Hash slots; labelled rows of each class that a fit takes at most; features and the least chi-square of one.
SLOTS, SAMPLE, FEATURES, CHI2 = 1 << 18, 6000, 4096, 15.0
#: Of pairs: the most common slots that are looked at, each in a share of the sample, the features taken, the least squared deviation of a
#: pair, and the least difference of the classes' correlations: small ones come of texts' lengths and topics.
COMMON, SHARE, PAIRED, DEVIATION2, APART = 2048, 0.005, 256, 36.0, 0.4
#: Distinct words that a worker remembers.
REMEMBERED = 150_000


def terms(word: bytes) -> list[int]:
    """Hash slots of a word's terms: itself and its first four and five letters."""
    w = word.decode()
    return [xxhash.xxh32_intdigest(t) & (SLOTS - 1) for t in (w, *(w[:n] + "*" for n in (4, 5) if len(w) >= n))]


def _words(text: str | None) -> set[bytes]:
    return set(text.lower().encode().translate(_WORDS).split()) if text else set()


class _Slots(dict):
    """Word -> features, asking ``of`` for unknown words and forgetting all when it grows too large."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: bytes):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = self.of(word)
        return out


@dataclass
class Machine:
    """Features by slot, bias, weights and vectors."""

    slots: dict[int, int]
    bias: float
    w: np.ndarray
    v: np.ndarray

    def features(self, word: bytes) -> tuple[int, ...]:
        return tuple(self.slots[s] for s in terms(word) if s in self.slots)

    def score(self, features: list[int]) -> float:
        z = self.bias
        if features:
            v = self.v[features]
            z += self.w[features].sum() + 0.5 * float(np.square(v.sum(0)).sum() - np.square(v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(slots: list[int], docs: list[list[int]], labels: list[int], dim: int = 8, epochs: int = 30, rate: float = 0.1, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Adagrad over mini-batches; ``docs`` hold feature numbers. Without both classes the machine says the share of label 1."""
    y = np.array(labels, float)
    rng = np.random.default_rng(seed)
    n = len(slots)
    w, v, bias = np.zeros(n + 1), rng.normal(0, 0.05, (n + 1, dim)), 0.0
    v[n] = 0  # the last feature is every document's: it keeps reduceat's segments full and carries the bias
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Machine({}, float(np.log((share + 1e-9) / (1 - share + 1e-9))), w[:n], v[:n])
    gw, gv = np.full(n + 1, 1e-6), np.full((n + 1, dim), 1e-6)
    rows = [np.array([*d, n]) for d in docs]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            idx = np.concatenate([rows[i] for i in batch])
            size = np.array([len(rows[i]) for i in batch])
            ptr = np.concatenate(([0], np.cumsum(size)[:-1]))
            vi = v[idx]
            total = np.add.reduceat(vi, ptr)
            z = np.add.reduceat(w[idx], ptr) + 0.5 * (np.square(total).sum(1) - np.add.reduceat(np.square(vi).sum(1), ptr))
            g = np.repeat((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch), size)
            dw, dv = np.zeros(n + 1), np.zeros((n + 1, dim))
            np.add.at(dw, idx, g)
            np.add.at(dv, idx, g[:, None] * (np.repeat(total, size, 0) - vi))
            dw[:n] += decay * w[:n]
            dv[:n] += decay * v[:n]
            dv[n] = 0
            gw += dw * dw
            gv += dv * dv
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
    return Machine({s: k for k, s in enumerate(slots)}, float(w[n]), w[:n], v[:n])


def _remainder(col: str, mod: int):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def teachers(labels: DataFrame, mod: int = 5, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """``id, y`` of the labels that may be learned from: rows whose crc32 remainder is not 0, but null ids and null labels; an id with both labels counts as 1."""
    taught = labels.where(quoted(id_col).isNotNull() & quoted(label_col).isNotNull()).select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("y"))
    return taught.where(_remainder("id", mod) != 0).groupBy("id").agg(F.max("y").alias("y"))


def sample(taught: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` ids of each class, the first by hash."""
    return reduce(DataFrame.unionByName, [taught.where(f"y = {c}").orderBy(F.xxhash64("id"), "id").limit(most) for c in (0, 1)])


def interacting(slot: np.ndarray, row: np.ndarray, y: np.ndarray) -> list[int]:
    """Slots that tell the classes in pairs: of the ``COMMON`` most frequent those in pairs whose covariance differs most between the classes, at most ``PAIRED``.

    ``slot`` and ``row`` are the places of ones in the sample's matrix; slots are numbered from 0.
    """
    n = np.bincount(slot)
    often = np.argsort(-n, kind="stable")[:COMMON]
    often = often[n[often] >= max(20, SHARE * len(y))]
    if not len(often) or y.min() == y.max():
        return []
    number = np.full(len(n), -1)
    number[often] = np.arange(len(often))
    ones = np.zeros((len(y), len(often)), bool)
    mine = number[slot] >= 0
    ones[row[mine], number[slot[mine]]] = True
    apart, spread, each = np.zeros((len(often), len(often)), np.float32), ones.mean(0), 0.0
    for c in (0, 1):
        own = ones[y == c].astype(np.float32)
        share = own.mean(0)
        apart += (2 * c - 1) * (own.T @ own / len(own) - np.outer(share, share))
        each += 1 / len(own)
    spread = spread * (1 - spread) + 1e-12
    apart2 = np.triu(np.square(apart) / np.outer(spread, spread), 1)
    z2 = apart2 / each
    a, b = np.nonzero((z2 >= DEVIATION2) & (apart2 >= APART**2))
    out: dict[int, None] = {}
    for k in np.argsort(-z2[a, b], kind="stable"):
        if len(out) >= PAIRED:
            break
        out |= dict.fromkeys((int(often[a[k]]), int(often[b[k]])))
    return list(out)


def _unseen_loss(slots: list[int], docs: list[list[int]], y: np.ndarray, fold: int = 5) -> float:
    """Mean logarithmic loss on every ``fold``-th row of a machine that learned from the others."""
    own = [k for k in range(len(docs)) if k % fold]
    m = train(slots, [docs[k] for k in own], y[own].tolist())
    said = [(m.score(docs[k]), y[k]) for k in range(0, len(docs), fold)]
    return float(np.mean([-np.log(max(p if t else 1 - p, 1e-12)) for p, t in said]))


def fit(
    spark: SparkSession, df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE, label_id_col: str | None = None
) -> Machine:
    """Learn from at most ``2 * most`` labelled rows; the bias is set right for the share of each class that was taken.

    What comes to the driver is bounded: counts of ``SLOTS`` slots, and the features of the sample. Null ids, null labels and labels of documents that are not there
    teach nothing; repeated rows count as often as they are there. Without both classes the machine says the share of label 1.
    """
    bound_batches(df.sparkSession)
    scratch = Scratch(spark, "toxicity")
    taught = scratch.table(teachers(labels, id_col=label_id_col or id_col, label_col=label_col), "labels")
    # at most 2 * most rows of two numbers: a broadcast of proven size
    chosen = sample(taught, most)
    rows = df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "y")
    rows = scratch.table(rows, "sample")
    by_class = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = by_class.get(0, 0), by_class.get(1, 0)
    if not n0 or not n1:
        return train([], [], [0] * n0 + [1] * n1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Slots(terms)
        n = np.zeros((2, SLOTS), np.int64)
        for b in batches:
            for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist()):
                found = {s for w in _words(text) for s in of[w]}
                n[int(y > 0), list(found)] += 1
        at = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[0, at]), pa.array(n[1, at])], ["slot", "n0", "n1"])

    found = rows.mapInArrow(tidy(count), "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b = F.col("n1"), F.col("n0")
    with_, n = a + b, n0 + n1
    chi2 = F.pow(a * n0 - b * n1, F.lit(2.0)) * n / (F.lit(float(n0)) * n1 * with_ * F.greatest(F.lit(n) - with_, F.lit(1)))
    found = scratch.table(found.select("slot", with_.alias("n"), chi2.alias("c")), "slots")
    alone = {r.slot for r in found.where(f"c >= {CHI2}").orderBy(F.desc("c"), "slot").limit(FEATURES).collect()}
    common = {r.slot for r in found.orderBy(F.desc("n"), "slot").limit(COMMON).collect()}
    slots = sorted(alone | common)
    number = {s: k for k, s in enumerate(slots)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Slots(lambda w: [number[s] for s in terms(w) if s in number])
        for b in batches:
            out = [sorted({f for w in _words(text) for f in of[w]}) for text in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"].cast(pa.string()), pa.array(out, pa.list_(pa.int32())), b["y"]], ["id", "f", "y"])

    got = rows.mapInArrow(tidy(features), "id string, f array<int>, y int").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    lists = got["f"].combine_chunks()
    ends, flat, y = lists.offsets.to_numpy(), lists.values.to_numpy(), got["y"].to_numpy()
    row = np.repeat(np.arange(len(y)), np.diff(ends))

    def restricted(kept: set[int]) -> tuple[list[int], list[list[int]]]:
        """The slots of some features, and the documents in them."""
        mine = np.array(sorted(kept), np.int64)
        new = np.full(len(slots), -1)
        new[mine] = np.arange(len(mine))
        return [slots[k] for k in mine], [f[f >= 0].tolist() for f in np.split(new[flat], ends[1:-1])]

    kinds = [restricted({number[s] for s in alone})]
    if more := set(interacting(flat, row, y)) - {number[s] for s in alone}:
        kinds.append(restricted({number[s] for s in alone} | more))
    used, docs = min(kinds, key=lambda x: _unseen_loss(*x, y)) if len(kinds) > 1 else kinds[0]
    machine = train(used, docs, y.tolist())
    everyone = {r.y: r.n for r in taught.groupBy("y").agg(F.count("*").alias("n")).collect()}
    taken = {r.y: r.n for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    machine.bias += float(np.log(everyone[1] / taken[1]) - np.log(everyone[0] / taken[0]))
    del got, lists, ends, flat, y, row, kinds, docs
    scratch.release()
    return machine


def _scored(spark: SparkSession, rows: DataFrame, machine: Machine) -> DataFrame:
    """``rows`` (the last column is the text) with ``score`` in place of the text. One narrow pass with a broadcast machine."""
    bound_batches(rows.sparkSession)
    sent = spark.sparkContext.broadcast(machine)
    names = [*rows.columns[:-1], "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        of = _Slots(m.features)
        for b in batches:
            out = [m.score(sorted({f for w in _words(text) for f in of[w]})) for text in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], names)

    return rows.mapInArrow(tidy(score), StructType([*rows.schema.fields[:-1], StructField("score", DoubleType())]))


def toxicity(spark: SparkSession, df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, held_out, score, predicted`` of every row.

    Scores read the whole text and nothing else; a null or empty text gets the bias. A null id counts as the
    empty string for ``held_out``. Repeated rows score alike; an empty table gives an empty table; other columns are not read.
    """
    scored = _scored(spark, df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")), machine)
    return scored.select(F.col("id").alias(id_col), (_remainder("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, df: DataFrame, machine: Machine, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score under ``limit``, with all their columns, whatever their names. Null and empty texts are judged by the bias; repeated rows share their fate."""
    rows = numbered(df)
    scored = _scored(spark, rows.select("*", F.col(f"c{df.columns.index(text_col)}").alias("text")), machine)
    return scored.where(F.col("score") < limit).drop("score").toDF(*df.columns)
