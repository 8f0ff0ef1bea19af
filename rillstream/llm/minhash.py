"""Near-duplicates by b-bit MinHash.

1. One pass over the texts gives each document the size and a 128-bit key of its shingle set, keys of its bands (of whole
   minima) and its signature: two bits of every minimum, packed into longs.
2. Documents of one set key form a class; from here on only its smallest id is worked with.
3. In every band bucket the members are paired with the smallest one, the hub, not with one another. Similarity is estimated from the
   signatures by bit counts, corrected for chance collisions; pairs that may reach the threshold are confirmed on the full sets.
4. Members that are near some hub form clusters. In a small one all that are in different components meet; a large one is told by how its
   members differ from the most typical one, and those that are no links of it meet others through an index of the rarest
   differences, which loses no link (see ``_strays``). Members far from their hub are no link of the hub's own links, by the
   triangle inequality, and meet those whose distance to the hub is not too different. Where many are far, the bucket is first
   split by each of the other bands, through which a similar pair passes as surely as through the first ones.
5. Connected components of the confirmed links give the groups.

Bands are chosen so that a pair at the threshold shares no bucket with a probability under ``MISS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, components, numbered, quoted, tidy

#: Hash functions, kept bits of each minimum, and the chance to miss a pair at the threshold.
HASHES, BITS, MISS = 384, 2, 1e-8
#: Estimated similarity to the hub from which a member counts as near; far members of a bucket that its others meet directly (a bucket
#: with more is split first, ``DEPTH`` times at most); ids up to which a selection of texts is broadcast.
NEAR, OUTSIDE, DEPTH, BROADCAST_IDS = 0.45, 64, 3, 1_000_000
#: Standard deviations that an estimate may lie under the threshold before the pair goes.
SIGMAS = 6.0
#: Largest standard deviation of an estimate.
SIGMA = 2 / 3 / HASHES**0.5
REMEMBERED = 100_000

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
_MIX = _RNG.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(threshold: float) -> tuple[int, int]:
    """Rows and bands: the longest bands that still miss a pair at the threshold with a chance under ``MISS``."""
    for rows in range(12, 0, -1):
        if (1 - threshold**rows) ** (HASHES // rows) < MISS:
            return rows, HASHES // rows
    return 1, HASHES


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(1)
def _hashes() -> _Hashes:
    return _Hashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words the whole sequence is one."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, words), np.uint64, n)
    k = min(size, n)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(35)
        out += h[i : n - k + 1 + i]
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(hashed: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    x = (hashed ^ (hashed >> np.uint64(29))).astype(np.uint32)
    out = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 1024):
        np.minimum(out, (_A[:, None] * x[None, at : at + 1024] + _B[:, None]).min(1), out=out)
    return out


def signature(least: np.ndarray) -> np.ndarray:
    """Bits of the minima, packed into 64-bit words: the minima are mixed first, as multiplying by odd numbers keeps their own low bits apart or alike in all functions at once."""
    mixed = (least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)
    low = (mixed >> np.uint32(32 - BITS)).astype(np.uint64).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def band_keys(least: np.ndarray, rows: int, bands: int) -> np.ndarray:
    v = least[: rows * bands].reshape(bands, rows).astype(np.uint64)
    k = (v * _MIX[:rows]).sum(1, dtype=np.uint64) ^ (np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    k ^= k >> np.uint64(31)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(29))


def similarity(a, b):
    """Estimated similarity of two packed signatures (columns): equal low bits, less those that are equal by chance."""
    words = HASHES * BITS // 64
    odd = F.lit(0x5555555555555555)
    unequal = None
    for k in range(words):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
        unequal = n if unequal is None else unequal + n
    chance = 2.0**-BITS
    return (1 - unequal / float(HASHES) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - SIGMAS * math.sqrt(p * (1 - p) / HASHES) / (1 - chance)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


class _Groups:
    """The state of one run: scratch tables of classes and links."""

    def __init__(self, spark: SparkSession, docs: DataFrame, size: int, threshold: Fraction):
        self.spark, self.docs, self.size, self.threshold = spark, docs, size, threshold
        self.scratch = Scratch(spark, "minhash")
        self.rows, self.bands = bands_for(float(threshold))
        self.kind = docs.schema["id"].dataType.simpleString()

    def sketch(self) -> DataFrame:
        size, rows, bands = self.size, self.rows, self.bands
        none = np.empty(0, np.uint64)

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, key, band, sig = [], [], [], []
                for text in b["text"].to_pylist():
                    s = shingles(text, size)
                    n.append(len(s))
                    if not len(s):
                        key.append(None)
                        band.append(none)
                        sig.append(none)
                        continue
                    least = minima(s)
                    key.append(xxhash.xxh3_128_digest(s.tobytes()))
                    band.append(band_keys(least, rows, bands))
                    sig.append(signature(least))
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), pa.array(key, pa.binary()), _lists(band), _lists(sig)], ["id", "n", "key", "bands", "sig"])
            _hashes().clear()

        return self.docs.mapInArrow(tidy(sketch), f"id {self.kind}, n long, key binary, bands array<long>, sig array<long>")

    def pick(self, df: DataFrame, nodes: DataFrame) -> DataFrame:
        """Rows of ``df`` whose id is among ``nodes``: by a broadcast where that is small, checked by a count, else by a shuffle."""
        return df.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes, "id", "left_semi")

    def sets(self, nodes: DataFrame, name: str) -> DataFrame:
        """Full sets of the documents whose ids are ``nodes.id``, as the table ``name``."""
        size = self.size

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts = b["id"], b["text"].to_pylist()
                for at in range(0, len(texts), 64):  # sets are larger than texts
                    yield pa.RecordBatch.from_arrays([ids[at : at + 64], _lists([shingles(t, size) for t in texts[at : at + 64]])], ["id", "s"])

        nodes = self.scratch.table(nodes.distinct(), f"{name}-ids")
        return self.scratch.table(self.pick(self.docs, nodes).mapInArrow(tidy(make), f"id {self.kind}, s array<long>"), name)

    def is_link(self, sizes: Column, both: Column) -> Column:
        return both * self.threshold.denominator >= (sizes - both) * self.threshold.numerator

    def confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs ``a, b`` that are links, on full sets."""
        pairs = self.scratch.table(pairs.distinct(), f"{name}-pairs")
        if pairs.isEmpty():
            return pairs
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), f"{name}-sets")
        both = F.size(F.array_intersect("s_a", "s_b")).cast("long")
        links = (
            pairs.join(sets.toDF("a", "s_a"), "a")
            .join(sets.toDF("b", "s_b"), "b")
            .select("a", "b", (F.size("s_a") + F.size("s_b")).cast("long").alias("sizes"), both.alias("both"))
            .where(self.is_link(F.col("sizes"), F.col("both")))
            .select("a", "b")
        )
        links = self.scratch.table(links, f"{name}-links")
        self.scratch.drop(f"{name}-sets")
        return links

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs ``a, b`` with ``est``, their estimated similarity."""
        sig = self.classes.select("rep", "sig")
        both = pairs.distinct().join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
        return both.select("a", "b", similarity(F.col("sig_a"), F.col("sig_b")).alias("est"))

    def labelled(self, links: DataFrame, name: str) -> DataFrame:
        return components(self.scratch, links, name).select(F.col("node").alias("rep"), "root")

    def groups(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Sketches, classes (key, rep) and components (rep, root; none where nothing is linked)."""
        sketches = self.scratch.table(self.sketch(), "sketches")
        known = sketches.where("n > 0 AND id IS NOT NULL")
        self.classes = self.scratch.table(known.groupBy("key").agg(F.min("id").alias("rep"), F.min_by(F.struct("bands", "sig"), "id").alias("x")).select("key", "rep", "x.*"), "classes")
        buckets = self.classes.select("rep", F.explode("bands").alias("bucket"))
        shared, links, roots = self.scratch.table(self._shared(buckets), "shared-0"), None, None
        for depth in range(DEPTH + 1):
            links, roots, large = self._level(shared, links, roots, depth)
            if large is None:
                break
            bands = self.classes.select("rep", "bands")
            finer = large.join(bands, "rep").select("rep", "bucket", F.explode("bands").alias("band")).where("band <> bucket")
            finer = finer.select("rep", F.xxhash64(F.least("bucket", "band"), F.greatest("bucket", "band")).alias("bucket")).distinct()
            shared = self.scratch.table(self._shared(finer), f"shared-{depth + 1}")
        return sketches, self.classes.select("key", "rep"), roots

    def _shared(self, buckets: DataFrame) -> DataFrame:
        """``bucket, rep, hub`` of buckets with several members. The smallest member is pre-aggregated; a hot bucket's rows meet it in a join that Spark can split."""
        hubs = buckets.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
        return buckets.join(hubs, "bucket")

    def _rooted(self, pairs: DataFrame, roots: DataFrame | None, *names: str) -> DataFrame:
        """Adds ``root_<name>`` for columns that hold documents: their component so far."""
        for n in names:
            if roots is None:
                pairs = pairs.withColumn(f"root_{n}", F.col(n))
            else:
                pairs = pairs.join(roots.toDF(n, f"root_{n}"), n, "left").withColumn(f"root_{n}", F.coalesce(f"root_{n}", n))
        return pairs

    def _add(self, links: DataFrame | None, roots: DataFrame | None, more: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        if links is not None and more.isEmpty():
            return links, roots
        links = more if links is None else links.unionByName(more)
        links = self.scratch.small(links, f"links-{name}", links.count())
        roots = self.labelled(links, f"cc-{name}")
        self.scratch.release()
        return links, roots

    def _level(self, shared: DataFrame, links: DataFrame | None, roots: DataFrame | None, depth: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """All links of the pairs in these buckets, but for pairs of large buckets that are returned to be split."""
        cut, tag = least_estimate(float(self.threshold)), str(depth)
        est = self.scratch.table(self.estimated(shared.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))), f"est-{tag}")

        # a member and its smallest likely hub first: for most copies that is one pair in all
        likely = est.where(F.col("est") >= cut)
        apart = self._rooted(likely, roots, "a", "b").where("root_a <> root_b")
        links, roots = self._add(links, roots, self.confirm(apart.groupBy("a").agg(F.min("b").alias("b")), f"first-{tag}"), f"first-{tag}")

        # clusters of near members and hubs: small ones meet directly, a large one around its most typical member
        near = est.where(F.col("est") >= NEAR)
        cluster = components(self.scratch, near.select("a", "b"), f"near-cc-{tag}").toDF("rep", "cluster")
        cluster = cluster.unionByName(cluster.select(F.col("cluster").alias("rep"), "cluster").distinct())
        score = est.select("a", "est").unionByName(est.select(F.col("b").alias("a"), "est")).groupBy(F.col("a").alias("rep")).agg((F.sum("est") / (F.count("est") + 1)).alias("score"))
        sized = cluster.join(score, "rep").groupBy("cluster").agg(F.count("*").alias("size"), F.max_by("rep", F.struct("score", "rep")).alias("center"))
        cluster = self.scratch.table(cluster.join(sized, "cluster"), f"clusters-{tag}")
        open_ = self._rooted(cluster, roots, "rep").withColumnRenamed("root_rep", "root")
        mixed = open_.groupBy("cluster").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("cluster")
        open_ = self.scratch.table(open_.join(mixed, "cluster", "left_semi"), f"mixed-{tag}")
        small = open_.where(F.col("size") <= OUTSIDE)
        x, y = (small.select("cluster", F.col("rep").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
        pairs = x.join(y, "cluster").where("a > b AND root_a <> root_b").select("a", "b")
        large = self._centered(open_.where(F.col("size") > OUTSIDE), tag)
        about = large.where("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b"))
        again = self.estimated(pairs.unionByName(about)).where(F.col("est") >= cut).select("a", "b").unionByName(likely.select("a", "b"))
        again = self._rooted(again, roots, "a", "b").where("root_a <> root_b").select("a", "b")
        links, roots = self._add(links, roots, self.confirm(again, f"again-{tag}"), f"again-{tag}")
        links, roots = self._add(links, roots, self._strays(large.where("rep <> center"), roots, f"near-{tag}"), f"strays-{tag}")

        far = shared.join(est.toDF("rep", "hub", "est"), ["rep", "hub"], "left").withColumn("est", F.coalesce("est", F.lit(1.0)))
        far = self._rooted(far, roots, "rep").withColumn("far", F.col("est") < NEAR)
        some = far.where("far").groupBy("bucket").agg(F.count("*").alias("n_far"), F.max("est").alias("most"))
        reach = 1 - float(self.threshold) + SIGMAS * 2**0.5 * SIGMA
        far = far.join(some, "bucket").where(F.col("est") <= F.col("most") + reach)
        mixed = far.groupBy("bucket").agg(F.min("root_rep").alias("lo"), F.max("root_rep").alias("hi")).where("lo <> hi").select("bucket")
        far = self.scratch.table(far.join(mixed, "bucket", "left_semi"), f"far-{tag}")
        small = far.where((F.col("n_far") <= OUTSIDE) | F.lit(depth == DEPTH))
        x = small.where("far").select("bucket", F.col("rep").alias("x"), F.col("root_rep").alias("x_root"), F.col("est").alias("x_est"))
        y = small.select("bucket", F.col("rep").alias("y"), F.col("root_rep").alias("y_root"), F.col("est").alias("y_est"))
        pairs = x.join(y, "bucket").where((F.col("x_root") != F.col("y_root")) & (F.abs(F.col("x_est") - F.col("y_est")) <= reach))
        pairs = self.estimated(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).where(F.col("est") >= cut).select("a", "b")
        links, roots = self._add(links, roots, self.confirm(pairs, f"far-c-{tag}"), f"far-{tag}")
        large = far.where(F.col("n_far") > OUTSIDE).select("bucket", "rep")
        return links, roots, None if depth == DEPTH or large.isEmpty() else large

    def _centered(self, members: DataFrame, tag: str) -> DataFrame:
        """``rep, center`` of large clusters (``cluster, rep, size, center``): the member that is most like what more than half of them hold."""
        members = self.scratch.table(members.select("cluster", "rep", "size", F.col("center").alias("first")), f"large-{tag}")
        if members.isEmpty():
            return members.select("rep", F.col("first").alias("center"))
        sets = self.sets(members.select(F.col("rep").alias("id")), f"large-sets-{tag}").toDF("rep", "s")
        each = members.join(sets, "rep").select("cluster", "rep", "size", F.size("s").alias("n"), F.explode("s").alias("v"))
        most = each.groupBy("cluster", "v").agg(F.count("*").alias("often"), F.first("size").alias("size")).where("2 * often > size").select("cluster", "v")
        held = each.join(most, ["cluster", "v"]).groupBy("cluster", "rep", "n").agg(F.count("*").alias("both"))
        held = held.join(most.groupBy("cluster").agg(F.count("*").alias("m")), "cluster").withColumn("like", F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
        centers = held.groupBy("cluster").agg(F.max_by("rep", F.struct("like", "rep")).alias("center"))
        return self.scratch.table(members.join(centers, "cluster", "left").select("rep", F.coalesce("center", "first").alias("center")), f"centered-{tag}")

    def _strays(self, members: DataFrame, roots: DataFrame, name: str) -> DataFrame:
        """Links between members of large clusters (``rep, center``) that are in different components.

        A member is told by what it lacks of the center's set, and what it has besides: ``D``. Of a stray ``x``, which is no link of
        the center, and any other member ``y`` the sets' common size follows from the size of ``D(x)`` and ``D(y)`` together, and a link needs
        more of ``D(y)`` in common than ``(1 - c) * lacking + c * besides``, with ``c = t / (1 + t)``. So some common element is among the rarest of
        ``D(y)``, as many as leave no more than that outside: an index of those, looked up with the whole of ``D(x)``, loses no link,
        and copies that differ from the center in words of their own never meet.
        """
        num, den = self.threshold.numerator, self.threshold.denominator
        near = self._rooted(members, roots, "rep", "center").select("rep", "center", F.col("root_rep").alias("root"), (F.col("root_rep") != F.col("root_center")).alias("stray"))
        near = self.scratch.table(near.join(near.where("stray").select("center").distinct(), "center", "left_semi"), name)
        if near.isEmpty():
            return near.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        sets = self.sets(near.select(F.explode(F.array("rep", "center")).alias("id")), f"{name}-sets")
        both = near.join(sets.toDF("rep", "s"), "rep").join(sets.toDF("center", "s_center"), "center")
        lacking, besides = F.array_except("s_center", "s"), F.array_except("s", "s_center")
        lacks = F.transform(lacking, lambda v: v.bitwiseXOR(F.lit(0x5DEECE66D1234567)))
        diff = self.scratch.table(both.select("rep", "center", "root", "stray", F.size("s_center").cast("long").alias("n_center"), F.size(lacking).cast("long").alias("lacking"), F.size(besides).cast("long").alias("besides"), F.concat(lacks, besides).alias("d")), f"{name}-d")
        self.scratch.drop(f"{name}-sets")
        outside = F.floor((F.col("lacking") * den + F.col("besides") * num) / (den + num))
        each = diff.select("center", "rep", "root", "stray", (F.size("d") - outside).alias("keep"), F.explode("d").alias("v"))
        often = each.groupBy("center", "v").agg(F.count("*").alias("f")).where("f > 1")
        # an element of one member alone comes first in its order, and meets nothing: only its number counts
        alone = F.col("lacking") + F.col("besides") - F.count("*").over(Window.partitionBy("center", "rep"))
        size = F.col("n_center") - F.col("lacking") + F.col("besides")
        like = (F.col("n_center") - F.col("lacking")) / (F.col("n_center") + F.col("besides")).cast("double")
        shared = each.join(often, ["center", "v"]).join(diff.select("center", "rep", "lacking", "besides", size.alias("size"), like.alias("like")), ["center", "rep"])
        place = F.row_number().over(Window.partitionBy("center", "rep").orderBy("f", "v"))
        shared = self.scratch.table(shared.select("center", "rep", "root", "stray", "v", "size", "like", (place + alone <= F.col("keep")).alias("indexed")), f"{name}-each")
        index = shared.where("indexed").select("center", "v", F.col("rep").alias("y"), F.col("root").alias("y_root"), F.col("size").alias("y_size"), F.col("like").alias("y_like"))
        probe = shared.where("stray").select("center", "v", F.col("rep").alias("x"), F.col("root").alias("x_root"), F.col("size").alias("x_size"), F.col("like").alias("x_like"))
        # links are of like size, and by the triangle inequality of like distance to the center
        fits = (F.least("x_size", "y_size") * den >= F.greatest("x_size", "y_size") * num) & (F.abs(F.col("x_like") - F.col("y_like")) <= 1 - num / den + 1e-9)
        met = probe.join(index, ["center", "v"]).where((F.col("x_root") != F.col("y_root")) & fits).select("center", "x", "y").distinct()
        part = diff.select("center", "rep", "n_center", "lacking", "besides", "d")
        xs, ys = (part.select("center", F.col("rep").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("n_center", "lacking", "besides", "d"))) for c in ("x", "y"))
        n = lambda c: F.col(f"n_center_{c}") - F.col(f"lacking_{c}") + F.col(f"besides_{c}")
        common = F.col("n_center_x") - F.col("lacking_x") - F.col("lacking_y") + F.size(F.array_intersect("d_x", "d_y"))
        found = met.join(xs, ["center", "x"]).join(ys, ["center", "y"]).where(self.is_link(n("x") + n("y"), common))
        return self.scratch.table(found.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), f"{name}-links")


def near_duplicates(spark: SparkSession, df: DataFrame, size: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near-duplicates: ``<id_col>, n_shingles, component_id, kept``, a row for each row of ``df``.

    Words are what white space (space, tab to carriage return) parts, A-Z lowered; a document's set holds its distinct
    shingles of ``size`` words, or all its words as one where they are fewer. Two documents are linked if
    the similarity of their sets is ``threshold`` or more. ``component_id`` is the smallest id reachable, ``kept`` is whether it is
    the document's own. Null, empty and wordless texts are linked with nothing. A null id is kept, linked with nothing and has
    a null component. Rows that share an id count as one document linked with all of whose texts are similar;
    identical rows get identical results. An empty table gives an empty table; other columns are not read.
    """
    bound_batches(df.sparkSession)
    run = _Groups(spark, df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), size, Fraction(threshold))
    sketches, classes, roots = run.groups()
    found = classes.join(roots, "rep", "left").select("key", F.coalesce("root", "rep").alias("component"))
    out = sketches.select("id", "n", "key").join(found, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(spark: SparkSession, df: DataFrame, size: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without all but one document of each group; of rows that share an id one stays. Rows with null ids stay.

    Other columns come along, whatever their names; an empty table gives an empty table.
    """
    scratch = Scratch(spark, "kept")
    found = near_duplicates(spark, df, size, threshold, id_col, text_col).select(quoted(id_col).alias("kept_id"), "kept").where("kept_id IS NOT NULL")
    found = scratch.table(found, "ids")
    rows, at = numbered(df), f"c{df.columns.index(id_col)}"

    def among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col(at) == F.col("kept_id"), how)

    # what goes is named, not what stays: texts are not shuffled where the names are few
    left = among(rows, scratch.table(found.where("NOT kept").select("kept_id").distinct(), "gone"), "left_anti")
    again = scratch.table(found.where("kept").groupBy("kept_id").agg(F.count("*").alias("rows")).where("rows > 1").select("kept_id"), "again")
    if not again.isEmpty():
        left = among(left, again, "left_anti").unionByName(among(left, again, "left_semi").dropDuplicates([at]))
    return left.toDF(*df.columns)
