"""Document fingerprints from closed syncmers, in DataFrame functions only.

Tokens are stretches of up to sixteen characters without white space, and single characters of scripts that do not part words.
Of the k-mers of neighbouring tokens those are anchors whose least inner s-mer, by hash, is the first or the last. That depends on
the k-mer alone, so a passage keeps its anchors wherever it stands, and anchors of two texts can be matched by place. The fingerprint
holds every anchor, with its place. Texts are alike as far as neighbouring anchors of one stand in the other at the same distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Tokens of a k-mer and of its inner s-mers, and the longest token.
K, S, LONGEST = 5, 2, 16
_LONE = r"\p{IsIdeographic}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
_TOKEN = rf"[{_LONE}]|[^{_LONE}]{{1,{LONGEST}}}"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, though the body uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def _hashed_tokens(text: Column) -> Column:
    """Hashes of a text's tokens: its words, but a word that is long or has characters of scripts that do not part words is cut."""

    def odd(word: Column) -> Column:
        # such characters take three bytes or more: only words with as many are searched for them
        return (F.length(word) > LONGEST) | ((F.octet_length(word) > F.length(word) + 1) & word.rlike(f"[{_LONE}]"))

    def hashed(words: Column) -> Column:
        pieces = F.flatten(F.transform(words, lambda w: F.when(odd(w), F.regexp_extract_all(w, F.lit(_TOKEN), F.lit(0))).otherwise(F.array(w))))
        each = lambda tokens: F.transform(tokens, lambda t: F.xxhash64(t))
        return F.when(F.exists(words, odd), each(pieces)).otherwise(each(words))

    return _let(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), ""), hashed)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors of a text, as an array of (place of the first token, hash); tokens without a closed k-mer are one anchor, none are none."""
    inner = k - s + 1

    def of(h: Column) -> Column:
        smers = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(s))))

        def chosen(m: Column) -> Column:
            def anchor(first: Column, i: Column) -> Column:
                at = [first, *(F.get(m, i + j) for j in range(1, inner))]
                kmer = F.xxhash64(*(at[j] for j in [*range(0, inner, s), inner - 1]))
                closed = F.least(at[0], at[-1]) <= reduce(F.least, at[2:-1], at[1]) if inner > 2 else F.lit(True)
                return F.when((i < F.size(m) - (inner - 1)) & closed, F.struct(i.cast("int").alias("place"), kmer.alias("hash")))

            return F.filter(F.transform(m, anchor), lambda a: a.isNotNull())

        whole = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(F.array_join(F.transform(h, lambda x: F.hex(x)), " ")).alias("hash")))
        none = F.array().cast("array<struct<place:int,hash:bigint>>")
        found = F.when(F.size(h) >= k, _let(smers, chosen)).otherwise(none)
        return _let(found, lambda a: F.when((F.size(a) > 0) | (F.size(h) == 0), a).otherwise(whole))

    return _let(_hashed_tokens(text), of)


def written(found: Column) -> Column:
    """A fingerprint as a string: place and hash of each anchor in hexadecimal digits, as ``place:hash``, by commas."""
    return F.lower(F.array_join(F.transform(found, lambda x: F.concat(F.hex(x["place"]), F.lit(":"), F.hex(x["hash"]))), ","))


def steps(found: Column) -> Column:
    """What texts are matched by: each anchor with the next one and how far on it stands, as a hash; a lone anchor stands for itself.

    Two texts share a step where two neighbouring anchors of one stand in the other with the same distance: their places agree in shift.
    The step that a text repeats is numbered: the second with the second of another text, and so on, so that steps are distinct.
    """

    def numbered(all_: Column) -> Column:
        def runs(v: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))

            def each(starts: Column) -> Column:
                def run(start: Column, j: Column) -> Column:
                    last = F.coalesce(F.get(starts, j + 1), F.size(v)) - start - 1
                    return F.transform(F.sequence(F.lit(0), last), lambda n: F.when(n == 0, F.get(v, start)).otherwise(F.xxhash64(F.get(v, start), n)))

                return F.flatten(F.transform(starts, run))

            return _let(starts, each)

        return F.when(F.size(F.array_distinct(all_)) == F.size(all_), all_).otherwise(_let(F.sort_array(all_), runs))

    def of(a: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            return _let(F.get(a, i + 1), lambda y: F.xxhash64(x["hash"], y["hash"], y["place"] - x["place"]))

        moves = F.slice(F.transform(a, step), F.lit(1), F.size(a) - 1)
        return _let(F.when(F.size(a) > 1, moves).otherwise(F.transform(a, lambda x: x["hash"])), numbered)

    return _let(found, of)


def likeness(a: Column, b: Column) -> Column:
    """Similarity of two texts by their ``steps``: the common ones as a share of all. Two empty ones are alike, an empty one is like no other."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(_let(F.size(F.array_intersect(a, b)), lambda n: n / (both - n).cast("double")))


def following(scratch: Scratch, keys: DataFrame) -> DataFrame:
    """For distinct ``id, th`` the next one in descending order (null ids last), after the last the first: ``id, th, next_id, next_th``.

    A range partitioning sorts the keys; the first key of each partition, one small row, closes the gaps between them.
    """
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").desc_nulls_last(), F.col("th").desc()]
    ranged = scratch.table(keys.repartitionByRange(parts, *order).select("*", F.spark_partition_id().alias("part")), "ranged")
    here = F.struct("id", "th")
    firsts = ranged.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy(*order))).where("row = 1").select("part", here.alias("first"))
    all_parts = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(all_parts), F.first("first").over(all_parts)).alias("after"))
    led = ranged.withColumn("next", F.lead(here).over(Window.partitionBy("part").orderBy(*order)))
    both = led.join(F.broadcast(firsts), "part").withColumn("next", F.coalesce("next", "after"))
    return both.select("id", "th", F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th"))


def edited_fingerprints(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last third (rounded down) replaced by as many first characters, or all, of the next document in
    descending order of ids. Returns ``<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    A null text counts as empty and has an empty fingerprint. Rows that repeat id and text are one document in the order, and all get
    its results; texts that share an id, null ids too, are ordered by hash, null ids last. One document alone is its own next.
    Texts are shuffled by id twice, once for themselves and once as the next of another; anchors are worked out where both texts are.
    """
    scratch = Scratch(spark, "fingerprints")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    heads = scratch.table(docs.select("id", "th"), "heads")
    keys = heads.distinct()
    repeated = keys.count() < heads.count()

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of ``left`` with those of ``right`` of the same id (null included) and text hash."""
        right = right.withColumnsRenamed({"id": "id_", "th": "th_"})
        return left.join(right, F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_"))).drop("id_", "th_")

    asked = following(scratch, keys)
    wanted = asked.select(F.col("id").alias("to_id"), F.col("th").alias("to_th"), F.col("next_id").alias("id"), F.col("next_th").alias("th"))
    nexts = joined(docs, wanted).select(F.col("to_id").alias("id"), F.col("to_th").alias("th"), F.col("text").alias("next"))
    if repeated:
        nexts = nexts.dropDuplicates(["id", "th"])
    n = F.length("text")
    m = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - m), F.substring("next", F.lit(1), m))
    out = joined(docs, nexts).select("id", n.cast("long").alias("n_chars"), "text", "next", edited.alias("edited"))
    out = out.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *(anchors(F.col(c)).alias(c) for c in ("text", "edited", "next")))
    out = out.select("id", "n_chars", "edited_sha256", "text", "edited", *(steps(F.col(c)).alias(f"{c}_steps") for c in ("text", "edited", "next")))
    return out.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        written(F.col("text")).alias("fingerprint"),
        written(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("text_steps"), F.col("edited_steps")).alias("near_edited"),
        likeness(F.col("text_steps"), F.col("next_steps")).alias("near_next"),
    )
