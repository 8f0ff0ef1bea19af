"""Sampled segmentations over the piece lattice, by forward filtering and backward sampling.

The lattice of a text has a node at every character border and an edge for every vocabulary piece that fits; a character that is
no piece of its own has an edge of byte pieces instead. Pieces weigh by Zipf's law in the rank that the model
gives them, to the power ``theta``. The forward sums give every node the chances of its incoming edges; walking back from the end
and drawing one edge at each node gives a segmentation with exactly its chance under the model.

Where no piece holds two neighbouring characters side by side, every path passes the border between them. So the lattice is
a chain of the lattices of the parts between such borders; a space behind another character always is one (checked when a model is
loaded). Forward sums are worked out once for each distinct part that a worker remembers; all parts of a batch are then walked
back together. Each draw is a hash of the seed, the row's key and the place in the text, and chances are integers that are added up
node by node, so a segmentation depends neither on batches nor on partitions, nor on what a worker remembers.

Decoding joins the pieces' bytes and drops the space put in front. A space mark in the text itself is written as bytes, and so
comes back as it was.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy

MARK = "▁"
#: Lattice nodes that a worker remembers (and a word for every six), the longest part among them (a longer one is walked by itself), and the longest whose sums may need no scaling.
NODES, LONGEST, SHORT = 4_000_000, 256, 40
#: Chances are counted in these parts; the largest power of Zipf's law under which no sum vanishes.
WHOLE, THETA = 1 << 31, 7.0
#: Zipf's offset, and the rank at which bytes and pieces without a rank weigh.
OFFSET, LAST = 2.7, 60_000.0
_CHUNKS = re.compile(r" *[^ ]+| +")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Uniform integers under ``WHOLE``, of a row's key and a place in its text."""
    return (_mix(key + place.astype(np.uint64) * _GOLDEN) >> np.uint64(33)).astype(np.uint32)


def _shares(chances: list[float]) -> list[int]:
    """Chances added up from the first on, in parts of ``WHOLE``; the last is the whole."""
    out, total = [], 0.0
    for p in chances:
        total += p
        out.append(min(int(total * WHOLE), WHOLE))
    out[-1] = WHOLE
    return out


def _summed(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch the sum, and the sums up to each of its values: one value after the other, so that other stretches play no part."""
    total, upto = np.zeros(len(first)), np.empty(len(values))
    live = np.arange(len(first))
    for k in range(int(size.max())):
        live = live[size[live] > k]
        total[live] += values[first[live] + k]
        upto[first[live] + k] = total[live]
    return total, upto


class _Words(dict):
    """Word -> number; a new word is split into parts, and kept unless it is long."""

    def __init__(self, split):
        super().__init__()
        self.split = split

    def __missing__(self, word: str) -> int:
        n = self.split(word)
        if len(word) <= LONGEST:
            self[word] = n
        return n


class _Trie:
    """The pieces' trie; many steps are taken at once through a table of (state, character), probed in a row."""

    def __init__(self, ids: dict[str, int], weight: dict[str, float]):
        states = {"": 0}
        for piece in ids:
            for k in range(1, len(piece) + 1):
                states.setdefault(piece[:k], len(states))
        self.piece = np.full(len(states), -1)
        self.weight = np.zeros(len(states))
        for piece, i in ids.items():
            self.piece[states[piece]], self.weight[states[piece]] = i, weight[piece]
        self.bits = (4 * len(states)).bit_length()
        self.key, self.next = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        keys = np.array([(states[p[:-1]] << 21) | ord(p[-1]) for p in states if p])
        for key, state, slot in zip(keys.tolist(), range(1, len(states)), self._slot(keys).tolist()):
            while self.key[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.key[slot], self.next[slot] = key, state

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next states, 0 where there is none."""
        key = (state << 21) | char
        slot = self._slot(key)
        out = np.zeros(len(key), np.int64)
        live = np.arange(len(key))
        while live.size:
            held = self.key[slot[live]]
            same = held == key[live]
            out[live[same]] = self.next[slot[live[same]]]
            live = live[~same & (held >= 0)]
            slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)
        return out


class Lattice:
    """A model's pieces with their weights, and the remembered forward sums of words."""

    def __init__(self, model_file: str, theta: float = 1.0, remember: int = NODES):
        if not 0 <= theta <= THETA:
            raise ValueError(f"theta must be from 0 to {THETA}")
        self.remember = remember
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.size = n
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = {}
        self.weight: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.bytes[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} has a space mark behind another character")
                own = piece.replace(MARK, " ")
                self.bytes[i] = own.encode()
                self.id[own] = i
                rank = -sp.get_score(i)
                self.weight[own] = (min(rank, LAST) + OFFSET) ** -theta
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte pieces")
        self.byte_weight = (LAST + OFFSET) ** -theta
        #: weights of a character without a piece, by its number of bytes
        self.byte_weights = [self.byte_weight**n for n in range(5)]
        #: the longest part whose sums stay far from the least number
        self.short = min(SHORT, int(280 / max(theta * math.log10(LAST + OFFSET), 1e-9)))
        self.longest = max(map(len, self.id))
        #: characters that are side by side in some piece
        self.pairs = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        #: pieces and their beginnings, to stop looking early
        self.begins = {p[:k] for p in self.id for k in range(1, len(p) + 1)}
        self.trie = _Trie(self.id, self.weight)
        self.forget()

    def forget(self) -> None:
        self.words = _Words(self._split)  # a word without the space in front -> its number
        self.parts: dict[str, int] = {}  # part -> its last node
        self.share, self.before, self.piece = array("I"), array("i"), array("i")  # edges, by the node where they end
        self.head = array("i")  # of a node: its first edge
        self.nodes = 0
        self.first = array("q", [0])  # of a word: its first entry in the two below
        self.node, self.end = array("q"), array("q")  # of its parts: the last node, the end's place in the word
        self.new: list[str] = []  # parts whose nodes have no edges yet
        self.long: list[str] = []  # parts that are not remembered; their entry in node is -1 - number

    def _split(self, key: str) -> int:
        """Number of a new word, given without its space: its parts are looked up or learned."""
        word, pairs, a = " " + key, self.pairs, 0
        if pairs.issuperset(map(add, word, key)):
            borders = (len(word),)
        else:
            borders = [b for b in range(1, len(word) + 1) if b == len(word) or word[b - 1 : b + 1] not in pairs]
        for b in borders:
            part, a = word[a:b], b
            if len(part) > LONGEST:
                self.long.append(part)
                node = -len(self.long)
            elif (node := self.parts.get(part, -1)) < 0:
                node = self._learn(part)
            self.node.append(node)
            self.end.append(b)
        self.first.append(len(self.node))
        return len(self.first) - 2

    def _edges(self, word: str) -> list[list[tuple[int, int, float]]]:
        """For each border behind the first: the edges (start, piece, weight) that end there.

        A character without a piece of its own gets the number ``size`` + its code point; ``_spell`` writes it as bytes.
        """
        out: list[list[tuple[int, int, float]]] = [[] for _ in word]
        n, begins, ids, weight = len(word), self.begins, self.id, self.weight
        for a in range(n):
            for b in range(a + 1, min(n, a + self.longest) + 1):
                part = word[a:b]
                if part not in begins:
                    break
                if part in ids:
                    out[b - 1].append((a, ids[part], weight[part]))
            if word[a] not in ids:
                c = word[a]
                out[a].append((a, self.size + ord(c), self.byte_weights[len(c.encode())]))
        return out

    def _forward(self, edges: list[list[tuple[int, int, float]]]) -> list[list[float]]:
        """For each border the chances of its edges."""
        sums, out = [1.0], []
        for end in edges:
            part = [sums[a] * w for a, _, w in end]
            total = 0.0
            for x in part:
                total += x
            out.append([x / total for x in part])
            sums.append(total)
            if total < 2.0**-500:  # only the last few sums are used again
                low = max(0, len(sums) - self.longest - 1)
                sums[low:] = [x * 2.0**500 for x in sums[low:]]
        return out

    def _learn(self, part: str) -> int:
        """Give a new part's borders the next nodes, ``first .. last``, and return the last; its edges are worked out with those of other new parts."""
        if len(part) > self.short:
            self._learn_new()
            edges = self._edges(part)
            for end, chances in zip(edges, self._forward(edges)):
                self.head.append(len(self.share))
                self.share.extend(_shares(chances))
                self.before.extend(self.nodes + a - 1 if a else -1 for a, _, _ in end)
                self.piece.extend(piece for _, piece, _ in end)
        else:
            self.new.append(part)
        self.nodes += len(part)
        self.parts[part] = self.nodes - 1
        return self.nodes - 1

    def _learn_new(self) -> None:
        """Forward sums of all new parts at once, none of them so long that they could vanish."""
        if not self.new:
            return
        size = np.array([len(p) for p in self.new])
        chars = np.frombuffer("".join(self.new).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(chars)
        self.new = []
        first = np.repeat(np.cumsum(size) - size, size)
        stop = first + np.repeat(size, size)
        # pieces that start at each character: all starts go down the trie together
        starts, ends, pieces, weights = [], [], [], []
        at, state = np.arange(n), np.zeros(n, np.int64)
        for k in range(self.longest):
            state = self.trie.step(state, chars[at + k])
            at, state = at[state > 0], state[state > 0]
            hit = self.trie.piece[state] >= 0
            starts.append(at[hit])
            ends.append(at[hit] + k)
            pieces.append(self.trie.piece[state[hit]])
            weights.append(self.trie.weight[state[hit]])
            if not k:
                odd = np.ones(n, bool)
                odd[at[hit]] = False
                odd = np.flatnonzero(odd)
            more = at + k + 1 < stop[at]
            at, state = at[more], state[more]
            if not at.size:
                break
        c = chars[odd]
        width = 1 + (c >= 0x80).astype(int) + (c >= 0x800) + (c >= 0x10000)
        start, end = np.concatenate([*starts, odd]), np.concatenate([*ends, odd])
        piece, weight = np.concatenate([*pieces, self.size + c]), np.concatenate([*weights, np.array(self.byte_weights)[width]])
        # sums behind each character, in the order of places within the parts
        place = end - first[end]
        order = np.lexsort((start, end, place))
        start, end, piece, weight, place = start[order], end[order], piece[order], weight[order], place[order]
        sums = np.empty(n)
        new = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
        chance = np.empty(len(start))
        bounds = np.searchsorted(place, np.arange(place[-1] + 2))
        groups = np.searchsorted(new, bounds)
        size = np.diff(np.append(new, len(start)))
        for p in range(len(bounds) - 1):
            a, b = bounds[p], bounds[p + 1]
            own = weight[a:b] * np.where(start[a:b] > first[end[a:b]], sums[start[a:b] - 1], 1.0)
            g, n_edges = new[groups[p] : groups[p + 1]] - a, size[groups[p] : groups[p + 1]]
            total, _ = _summed(own, g, n_edges)
            sums[end[a:b][g]] = total
            chance[a:b] = own / np.repeat(total, n_edges)
        # by node: the shares up to each edge, the last of a node's exactly the whole
        order = np.lexsort((start, end))
        start, end, piece, chance = start[order], end[order], piece[order], chance[order]
        head = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
        size = np.diff(np.append(head, len(end)))
        share = np.minimum((_summed(chance, head, size)[1] * WHOLE).astype(np.uint32), WHOLE)
        share[head + size - 1] = WHOLE
        base = self.nodes - n
        self.head.frombytes((len(self.share) + head).astype(np.int32).tobytes())
        self.share.frombytes(share.astype(np.uint32).tobytes())
        self.before.frombytes(np.where(start > first[end], base + start - 1, -1).astype(np.int32).tobytes())
        self.piece.frombytes(piece.astype(np.int32).tobytes())

    def _walk_long(self, word: str, key: np.uint64, place: int) -> list[int]:
        """Pieces of a word that is not remembered, last first."""
        edges = self._edges(word)
        chances = self._forward(edges)
        at, out = len(word), []
        while at:
            u = int(draws(np.array([key], np.uint64), np.array([place + at], np.uint64))[0])
            a, piece, _ = edges[at - 1][bisect_right(_shares(chances[at - 1]), u)]
            out.append(piece)
            at = a
        return out

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """A segmentation of each text, as piece ids; ``keys`` are the rows' keys, mixed with the seed."""
        if self.nodes > self.remember or max(len(self.words), len(self.long)) > self.remember // 6:
            self.forget()
        known, counts, sizes = [], [], []
        number = self.words.__getitem__
        for text in texts:
            words = text.split(" ") if text else []
            if "" in words:
                words = [w[1:] for w in _CHUNKS.findall(" " + text)]
            known.extend(map(number, words))
            counts.append(len(words))
            sizes.extend(map(len, words))
        if not known:
            return [np.empty(0, np.int32)] * len(texts)
        self._learn_new()
        # words to parts: the last node, the place where it ends, the text
        word, n = np.array(known), np.array(counts)
        owner = np.repeat(np.arange(len(texts)), n)
        size = np.array(sizes) + 1
        start = np.cumsum(size) - size
        text_at = np.concatenate(([0], np.cumsum(n)))[:-1]
        start -= np.repeat(np.append(start, 0)[text_at], n)
        first = np.frombuffer(self.first, np.int64)
        parts = first[word + 1] - first[word]
        entry = np.repeat(first[word] - np.concatenate(([0], np.cumsum(parts)[:-1])), parts) + np.arange(int(parts.sum()))
        ends = np.frombuffer(self.end, np.int64)[entry] + np.repeat(start, parts)
        return self._walk(np.frombuffer(self.node, np.int64)[entry], ends, np.repeat(owner, parts), keys, len(texts))

    def _walk(self, last: np.ndarray, ends: np.ndarray, owner: np.ndarray, keys: np.ndarray, n_texts: int) -> list[np.ndarray]:
        head, share, before, piece = (np.frombuffer(x, t) for x, t in ((self.head, np.int32), (self.share, np.uint32), (self.before, np.int32), (self.piece, np.int32)))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        size = np.zeros(len(last), np.int64)
        live = np.flatnonzero(last >= 0)
        node = last[live]
        key = keys[owner]
        shift = ends - last  # a node's place in the text lies as far before the part's end as the node before the last
        while live.size:
            u = draws(key[live], shift[live] + node)
            e = head[node]
            over = np.flatnonzero(u >= share[e])
            while over.size:
                e[over] += 1
                over = over[u[over] >= share[e[over]]]
            steps.append((live, piece[e]))
            size[live] += 1
            node = before[e]
            go = node >= 0
            live, node = live[go], node[go].astype(np.int64)
        long = {}
        for k in np.flatnonzero(last < 0).tolist():
            part = self.long[-1 - int(last[k])]
            long[k] = self._walk_long(part, key[k], int(ends[k]) - len(part))
            size[k] = len(long[k])
        stop = np.cumsum(size)
        out = np.empty(int(stop[-1]), np.int32)
        for k, (live, p) in enumerate(steps):
            out[stop[live] - 1 - k] = p
        for k, pieces in long.items():
            out[stop[k] - size[k] : stop[k]] = pieces[::-1]
        each = np.zeros(n_texts + 1, np.int64)
        np.add.at(each, owner + 1, size)
        return np.split(*self._spell(out, np.cumsum(each)))[:n_texts]

    def _spell(self, out: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Write characters without a piece as their bytes' pieces; returns the ids and where texts end."""
        odd = np.flatnonzero(out >= self.size)
        if not odd.size:
            return out, bounds[1:]
        bytes_of = [[self.byte_id[b] for b in chr(c - self.size).encode()] for c in out[odd].tolist()]
        width = np.ones(len(out), np.int64)
        width[odd] = [len(b) for b in bytes_of]
        start = np.concatenate(([0], np.cumsum(width)))
        full = np.repeat(out, width)
        flat = np.concatenate([np.arange(start[k], start[k + 1]) for k in odd.tolist()])
        full[flat] = [x for b in bytes_of for x in b]
        return full, start[bounds][1:]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()[1:]


@lru_cache(2)
def lattice(model_file: str, theta: float, remember: int) -> Lattice:
    """One for each worker process, reused by its tasks."""
    return Lattice(model_file, theta, remember)


def row_keys(ids: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(str(i) if i is not None else "", seed) for i in ids], np.uint64)


def sampled_pieces(df: DataFrame, model_file: str, seed: int = 17, theta: float = 1.0, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 500_000, remember: int = NODES) -> DataFrame:
    """A sampled segmentation of every row's whole text, decoded again: ``<id_col>, n_pieces, pieces, decoded_sha256, lossless``.

    Draws depend on the seed, the row's id (null: the empty string) and the text alone, so rows that share id and
    text get the same pieces. A null or empty text has no pieces and decodes to the empty text. ``lossless`` is whether the
    decoded text is the given one (null counts as empty). Other columns are not read. One narrow pass; texts
    are taken in groups of about ``batch_chars`` characters, and a worker remembers ``remember`` lattice nodes (about 60 bytes each).
    """
    kind = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model_file, theta, remember)
        try:
            for b in batches:
                yield from segment(lat, b)
        finally:
            lat.forget()  # what is remembered would fill the worker in other stages

    def segment(lat: Lattice, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in b["text"].to_pylist()]
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= batch_chars):
                chars += len(texts[stop])
                stop += 1
            ids = b["id"][at:stop]
            found = lat.sample(texts[at:stop], row_keys(ids.to_pylist(), seed))
            back = [lat.decode(f) for f in found]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                    pa.array([x == y for x, y in zip(back, texts[at:stop])]),
                ],
                ["id", "n_pieces", "pieces", "decoded_sha256", "lossless"],
            )
            at = stop

    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(tidy(encode), f"id {kind}, n_pieces long, pieces array<int>, decoded_sha256 string, lossless boolean")
    return out.withColumnRenamed("id", id_col)
