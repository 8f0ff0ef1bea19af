"""Scores of a word-pair language model, kept in sharded Elias-Fano tries.

The model: ``P(w | v) = (c(v w) - d) / c(v)`` for pairs seen in training; else the weight that this leaves to ``v``,
``d * kinds(v) / c(v)``, times the base probability ``P(w) = (c(w) + 1) / (N + V + 1)``; the base alone behind a word that was never seen.

1. One pass counts words; from it come N, V, every word's count, and the hot words, of which there can be only a few a shard.
2. Another pass packs every text's pairs by shard of the first word (hot words: of both) and shuffles them once. A shard's task builds
   the trie of its training pairs, maps it into memory, and looks up all its pairs, training or not. It returns sums for each
   document, and the unseen pairs of held-out texts with the weight of their context.
3. Unseen pairs meet the counts of their second word in a join; sums are added up by document.

Whatever is collected is bounded by the number of shards; everything else grows with the text and is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, give_back, tidy
from .elias_fano import Trie

#: Pairs that a shard should hold, tokens that a worker packs at a time, and words that it remembers.
PAIRS, CHUNK, REMEMBERED = 2_000_000, 1_000_000, 150_000
DISCOUNT = 0.7
_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(1)
def _hashes() -> _Hashes:
    return _Hashes()


#: What stands before the first word and behind the last; no word holds a space.
BEGIN, END = xxhash.xxh3_64_intdigest(b" begin"), xxhash.xxh3_64_intdigest(b" end")


def hashed(text: str | None) -> np.ndarray:
    words = text.encode().lower().split() if text else []
    return np.fromiter(map(_hashes().__getitem__, words), _U, len(words))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(_U).view(np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(33))


def _pack(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(1).compress(head + b"".join(a.tobytes() for a in arrays))


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (hash), ``c`` (in training), ``n`` (in all): the end of each text included. Added up in a worker, then shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [[], []]
        size = 0

        def out():
            both = [np.unique(np.concatenate(h) if h else np.empty(0, _U), return_counts=True) for h in held]
            words = np.union1d(both[0][0], both[1][0])
            n = [np.zeros(len(words), np.int64) for _ in held]
            for k, (own, c) in enumerate(both):
                n[k][np.searchsorted(words, own)] = c
            return pa.RecordBatch.from_arrays([pa.array(_signed(words)), pa.array(n[0]), pa.array(n[0] + n[1])], ["word", "c", "n"])

        for b in batches:
            for text, held_out in zip(b["text"].to_pylist(), b["held_out"].to_pylist()):
                h = hashed(text)
                held[int(held_out)] += [h, np.array([END], _U)]
                size += len(h) + 1
                if size >= 4 * CHUNK:
                    yield out()
                    held, size = [[], []], 0
        if size:
            yield out()

    found = docs.select("text", "held_out").mapInArrow(tidy(count), "word long, c long, n long")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def pack_pairs(docs: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """``shard, pairs``: packed (contexts, their number of pairs, kinds of second words, which of them, which document, the documents' keys and folds)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            first, second = np.concatenate(firsts), np.concatenate(seconds)
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            own = np.array(keys, np.int64)
            fold = np.array(folds, np.uint8)
            is_hot = hot[np.minimum(np.searchsorted(hot, first), len(hot) - 1)] == first
            shard = (_mixed(np.where(is_hot, first ^ _mixed(second), first)) % _U(shards)).astype(np.int32)
            order = np.lexsort((first, shard))  # stable: documents stay in order
            first, second, doc, shard = first[order], second[order], doc[order], shard[order]
            bounds = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))).tolist() + [len(shard)]
            rows = []
            for a, b in zip(bounds, bounds[1:]):
                f = first[a:b]
                new = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
                kinds, which = np.unique(second[a:b], return_inverse=True)
                docs_, local = np.unique(doc[a:b], return_inverse=True)
                rows.append((int(shard[a]), _pack([f[new], np.diff(np.append(new, b - a)).astype(np.uint32), kinds, which.astype(np.uint32), local.astype(np.uint16 if len(docs_) < 65536 else np.uint32), own[docs_], fold[docs_]])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "pairs"])

        firsts, seconds, sizes, keys, folds, total = [], [], [], [], [], 0
        for b in batches:
            for key, text, held_out in zip(b["key"].to_pylist(), b["text"].to_pylist(), b["held_out"].to_pylist()):
                h = hashed(text)
                firsts += [np.array([BEGIN], _U), h]
                seconds += [h, np.array([END], _U)]
                sizes.append(len(h) + 1)
                keys.append(key)
                folds.append(held_out)
                total += len(h) + 1
                if total >= CHUNK or len(sizes) >= 60_000:
                    yield out()
                    firsts, seconds, sizes, keys, folds, total = [], [], [], [], [], 0
        if sizes:
            yield out()

    return docs.select("key", "text", "held_out").mapInArrow(tidy(pack), "shard int, pairs binary")


def score_shard(packed: list[bytes], hot: np.ndarray, hot_count: np.ndarray, discount: float) -> dict[str, np.ndarray]:
    """All that one shard knows: for each document sums (score, base, known words, tokens); unseen pairs; kinds of hot contexts."""
    firsts, seconds, docs, keys, folds, n_docs = [], [], [], [], [], 0
    for data in packed:
        f, n, kinds, which, local, own, fold = _unpack_pairs(data)
        firsts.append(np.repeat(f, n))
        seconds.append(kinds[which])
        docs.append(local.astype(np.int32) + np.int32(n_docs))
        keys.append(own)
        folds.append(fold)
        n_docs += len(own)
    first, second, doc, key = np.concatenate(firsts), np.concatenate(seconds), np.concatenate(docs), np.concatenate(keys)
    train_doc = np.concatenate(folds) == 0
    del firsts, seconds, docs, keys, folds
    order = np.lexsort((second, first))
    first, second, doc = first[order], second[order], doc[order]
    del order
    train = train_doc[doc]

    # contexts, and the pairs below them
    new_context = np.concatenate(([True], first[1:] != first[:-1]))
    pair = np.flatnonzero(new_context | np.concatenate(([True], second[1:] != second[:-1])))
    context = np.flatnonzero(new_context)
    contexts, of_pair = first[context], np.cumsum(new_context)[pair] - 1
    own_count, pair_count = np.add.reduceat(train.astype(np.int64), context), np.add.reduceat(train.astype(np.int64), pair)
    place = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
    is_hot = hot[place] == contexts
    # a context's own count: it stands as often before another token as it stands at all; a hot one's is spread over shards
    total = np.where(is_hot, hot_count[place], own_count).astype(float)
    kept, seen_pair = own_count > 0, pair_count > 0
    rank = np.cumsum(kept) - 1
    trie = Trie.of_counts(contexts[kept], total[kept], rank[of_pair[seen_pair]], second[pair[seen_pair]], pair_count[seen_pair], discount).mapped()

    found_rank, known = trie.look_up(contexts)
    value, seen = np.zeros(len(pair)), np.zeros(len(pair), bool)
    at = np.flatnonzero(known[of_pair])
    value[at], seen[at] = trie.score(found_rank[of_pair[at]], second[pair[at]])
    # the weight that a hot context leaves is known only when the kinds of all its shards are added up
    value[~seen & is_hot[of_pair]] = 0.0
    word = contexts != _U(BEGIN)
    times = np.diff(np.append(pair, len(first)))
    each = {"score": value, "base": np.where(word, np.log10(total + 1), 0.0)[of_pair], "known": ((total > 0) & word)[of_pair].astype(float)}
    out = {"key": key} | {name: np.bincount(doc, np.repeat(v, times), n_docs) for name, v in each.items()}
    out["tokens"] = np.bincount(doc, minlength=n_docs)
    un = np.flatnonzero(np.repeat(~seen, times))
    out |= {"un_key": key[doc[un]], "un_word": second[un], "un_hot": np.repeat(np.where(is_hot, place, -1)[of_pair], times)[un]}
    mine = np.flatnonzero(is_hot & known)
    return out | {"hot": place[mine], "kinds": trie.kinds(found_rank[mine])}


def _unpack_pairs(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, np.int64, 7).tolist()
    kinds = [_U, np.uint32, _U, np.uint32, np.uint16 if sizes[5] < 65536 else np.uint32, np.int64, np.uint8]
    out, at = [], 56
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw[at : at + n * np.dtype(kind).itemsize], kind))
        at += out[-1].nbytes
    return out


def lm_scores(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, held: int = 2, discount: float = DISCOUNT, pairs_each: int = PAIRS) -> DataFrame:
    """Scores of every text: ``<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are words parted by white space, A-Z lowered, and one end. Rows whose id's crc32 leaves ``held`` by ``mod`` are held out
    of training; a null id counts as the empty string. A null text counts as empty and has the end alone. Repeated rows (of one id and
    text) all train and get the same scores. Without training rows every probability is the base's. An empty table gives an empty table. Words are
    told apart by 64-bit hashes, a context's successors by 40 bits.
    """
    bound_batches(df.sparkSession)
    scratch = Scratch(spark, "lm")
    text = F.coalesce(F.col(text_col), F.lit(""))
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == held
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"), held_out.alias("held_out"))

    words = scratch.table(count_words(docs), "words")
    total = words.agg(F.sum("c").alias("N"), F.count_if(F.col("c") > 0).alias("V"), F.sum("n").alias("all")).first()
    n, v, everything = total["N"] or 0, total["V"], total["all"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(everything / pairs_each))
    # words that hold more than an eighth of a shard: at most 8 a shard
    hot_rows = words.where(F.col("n") >= max(1, everything // (8 * shards))).select("word", "c").collect()
    ends = [r.c for r in words.where(F.col("word") == int(_signed(np.array([END], _U))[0])).collect()]
    own = {int(np.array([r.word], np.int64).view(_U)[0]): r.c for r in hot_rows} | {BEGIN: ends[0] if ends else 0}
    hot = np.array(sorted(own), _U)
    hot_count = np.array([own[int(h)] for h in hot.tolist()], np.int64)
    end_known = bool(ends and ends[0])
    end_base = math.log10((ends[0] if ends else 0) + 1)

    schema = "kind byte, key long, word long, hot int, score double, base double, n long, tokens long"

    def score(table: pa.Table) -> pa.Table:
        r = score_shard(table["pairs"].to_pylist(), hot, hot_count, discount)
        give_back()
        a, b, c = len(r["key"]), len(r["un_key"]), len(r["hot"])
        none = lambda k: np.zeros(k, np.int64)
        columns = {
            "kind": np.repeat(np.array([0, 1, 2], np.int8), [a, b, c]),
            "key": np.concatenate((r["key"], r["un_key"], none(c))),
            "word": np.concatenate((none(a), _signed(r["un_word"]), none(c))),
            "hot": np.concatenate((none(a), r["un_hot"], r["hot"])).astype(np.int32),
            "score": np.concatenate((r["score"], none(b + c))),
            "base": np.concatenate((r["base"], none(b + c))),
            "n": np.concatenate((r["known"].astype(np.int64), none(b), r["kinds"])),
            "tokens": np.concatenate((r["tokens"].astype(np.int64), none(b + c))),
        }
        return pa.table({k: pa.array(x) for k, x in columns.items()})

    found = scratch.table(pack_pairs(docs, shards, hot).repartition(shards, "shard").groupBy("shard").applyInArrow(score, schema), "found")
    # at most 8 rows a shard
    kinds = {r.hot: r.n for r in found.where("kind = 2").groupBy("hot").agg(F.sum("n").alias("n")).collect()}
    weight = {int(k): math.log10(discount * m / hot_count[k]) for k, m in kinds.items() if hot_count[k]}
    weights = F.create_map(*(F.lit(x) for pair in weight.items() for x in pair)) if weight else F.lit(None).cast("map<int,double>")

    floor = math.log10(n + v + 1)
    unseen = found.where("kind = 1").groupBy("key", "word", "hot").agg(F.count("*").alias("times"))
    unseen = unseen.join(words.select("word", "c"), "word", "left").select(
        "key",
        ((F.coalesce(F.element_at(weights, F.col("hot")), F.lit(0.0)) + F.log10(F.coalesce("c", F.lit(0)) + 1.0) - floor) * F.col("times")).alias("score"),
        F.lit(0.0).alias("base"),
        F.lit(0).cast("long").alias("n"),
        F.lit(0).cast("long").alias("tokens"),
    )
    parts = ["score", "base", "n", "tokens"]
    sums = found.where("kind = 0").select("key", *parts).unionByName(unseen).groupBy("key").agg(*(F.sum(c).alias(c) for c in parts))
    rows = scratch.table(docs.select("id", "key", "held_out"), "rows")
    times = rows.groupBy("key").agg(F.count("*").alias("rows"))
    each = sums.join(times, "key").select("key", *((F.col(c) / F.col("rows")).alias(c) for c in parts))
    return rows.join(each, "key").select(
        F.col("id").alias(id_col),
        "held_out",
        F.col("tokens").cast("long").alias("n_tokens"),
        (F.col("n").cast("long") + int(end_known)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + end_base - F.col("tokens") * floor).alias("base_score"),
        "score",
    )
