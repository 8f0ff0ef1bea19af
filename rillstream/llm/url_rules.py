"""URL filters: given rules first, then association rules mined from labelled urls.

A url's tokens are its scheme, its host and that host's parents, its path's segments, its file type, and the names in its
query; digits are one sign, so that urls that differ in a number alone have the same tokens. There are two sources of labels, each mined by
itself, so that one that goes with no url token does not dilute the other: the verdicts of the given rules, and a label table for other urls.
Spark's FP-growth mines the labelled urls; combinations that conclude ``block`` with enough support and confidence become rules for the urls
that no given rule fits. They are matched through an inverted index: each rule is filed under its rarest token, and looked up by
the tokens of every distinct token set, a few rows however many urls share one.

Tokens that occur in exactly the same labelled urls, such as a host and the parents that it alone has, are mined as one, and a rule
names them all: combinations of them would say the same in exponentially many ways.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

BLOCKED = "=block"
#: The longest name that a host can have, and the parents that what is longer has; token sets up to which verdicts are broadcast.
NAME, PARENTS, BROADCAST_SETS = 253, 5, 100_000


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The filter's given rules; of those that fit, the longest wins.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def parts(url):
    """Host (A-Z lowered) and path of a url column; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url, host, path):
    """Sorted distinct tokens of a url. Every parent of a host is one; of what is too long to be a host's name only itself and the last ``PARENTS``. Empty segments are none."""
    labels = F.split(host, r"\.")
    n = F.when(F.length(host) <= NAME, F.size(labels)).otherwise(F.least(F.size(labels), F.lit(PARENTS)))
    parents = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("h:"), F.concat_ws(".", F.slice(labels, -k, k))))
    parents = F.concat(parents, F.array(F.concat(F.lit("h:"), host)))
    signs = F.regexp_replace(path, r"[0-9]+", "#")
    segments = F.transform(F.filter(F.split(signs, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("p:"), s))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), F.split_part(s, F.lit("="), F.lit(1))))
    kind = F.regexp_extract(signs, r"\.([A-Za-z]{1,8})$", 1)
    rest = F.array(F.concat(F.lit("s:"), F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.concat(F.lit("e:"), kind))
    return F.array_sort(F.array_distinct(F.concat(parents, segments, names, rest)))


def given(rules: tuple[Rule, ...], host, path):
    """The longest given rule that fits (``rule, verdict``; ties: the first in byte order), else null."""
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def labelled(urls: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> dict[str, DataFrame]:
    """``id, tokens, bad`` of labelled urls (``id, tokens, won``) by source: ``given``, which a given rule judges, and ``table``, others of whose id ``labels`` has a row.

    The table blocks an id if any of its rows says toxic 1 or quality 0. Null ids have no label; a url without one teaches nothing.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")).alias("bad"))
    return {
        "given": urls.where("won IS NOT NULL").select("id", "tokens", (F.col("won.verdict") == "block").cast("int").alias("bad")),
        "table": urls.where("won IS NULL").select("id", "tokens").join(marks, "id").select("id", "tokens", "bad"),
    }


def mine_all(spark: SparkSession, sources: dict[str, DataFrame], support: float, confidence: float) -> tuple[DataFrame, DataFrame]:
    """Rules of all sources, and the counts of their single tokens."""
    mined = [mine(Scratch(spark, f"urls-{name}"), marked, support, confidence) for name, marked in sources.items()]
    rules, singles = (reduce(DataFrame.unionByName, [m[k] for m in mined]) for k in (0, 1))
    return rules.groupBy("rule").agg(F.max("confidence").alias("confidence")), singles.groupBy("token").agg(F.sum("freq").alias("freq"))


def mine(scratch: Scratch, marked: DataFrame, support: float, confidence: float, least_rows: int = 20) -> tuple[DataFrame, DataFrame]:
    """Rules ``rule (tokens), confidence`` that conclude ``block``, and single tokens with their counts ``token, freq``.

    ``marked`` has ``tokens, bad``; columns beside them are not read. A rule stands on a share ``support`` of the labelled urls and ``least_rows`` of them (a share of 0:
    on ``least_rows`` alone). The share bounds the number of frequent tokens, which FP-growth holds on the driver, whatever the size of the input.
    """
    marked = scratch.table(marked.select("tokens", "bad", F.monotonically_increasing_id().alias("row")), "marked")
    least = max(least_rows, math.ceil(support * marked.count()))
    each = marked.select("row", F.explode("tokens").alias("token"))
    told = each.groupBy("token").agg(F.count("*").alias("freq"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")).where(F.col("freq") >= least)
    told = scratch.table(told, "tokens")
    alike = scratch.table(told.groupBy("freq", "x", "y").agg(F.min("token").alias("name"), F.array_sort(F.collect_set("token")).alias("all")).select("name", "all"), "alike")
    baskets = each.join(alike.select(F.col("name").alias("token")), "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    baskets = marked.select("row", "bad").join(baskets, "row", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.when(F.col("bad") == 1, F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))).alias("items"))
    baskets = scratch.table(baskets, "baskets")
    n = max(1, baskets.count())
    parts_ = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    # half a row less: the count that FP-growth makes of the share must not round up
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=confidence, numPartitions=parts_).fit(baskets)
    sets = scratch.table(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "sets")
    blocked = sets.where(F.array_contains("items", BLOCKED) & (F.size("items") > 1)).select(F.array_remove("items", BLOCKED).alias("items"), F.col("freq").alias("both"))
    rules = blocked.join(sets, "items").select("items", (F.col("both") / F.col("freq")).alias("confidence")).where(F.col("confidence") >= confidence)
    named = rules.select("items", "confidence", F.explode("items").alias("name")).join(alike, "name")
    rules = named.groupBy("items", "confidence").agg(F.array_sort(F.flatten(F.collect_list("all"))).alias("rule")).select("rule", "confidence")
    return scratch.table(rules, "rules"), told.select("token", "freq")


def match(sets: DataFrame, rules: DataFrame, singles: DataFrame) -> DataFrame:
    """``tokens, confidence`` of the distinct token sets (``tokens``) that some rule fits, with the best rule's confidence."""
    rarest = rules.select("rule", "confidence", F.explode("rule").alias("token")).join(singles, "token").groupBy("rule", "confidence").agg(F.min_by("token", F.struct("freq", "token")).alias("token"))
    looked_up = sets.select("tokens", F.explode("tokens").alias("token")).join(rarest, "token")
    return looked_up.where(F.size(F.array_except("rule", "tokens")) == 0).groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def held_out_quality(spark: SparkSession, marked: DataFrame, support: float = 0.001, confidence: float = 0.8, fold: int = 5) -> dict[str, int]:
    """What mined rules say of labelled urls (``id, tokens, bad``) that they did not learn from, those whose id's hash leaves 0 by ``fold``: counts ``tp, fp, fn, tn`` of blocked urls."""
    scratch = Scratch(spark, "urls-held")
    marked = scratch.table(marked, "all")
    out = F.pmod(F.xxhash64("id"), F.lit(fold)) == 0
    mined, singles = mine(scratch, marked.where(~out), support, confidence)
    asked = marked.where(out)
    fits = match(asked.select("tokens").distinct(), mined, singles)
    said = asked.join(fits, "tokens", "left").select((F.col("bad") == 1).alias("bad"), F.col("confidence").isNotNull().alias("blocked"))
    names = {(True, True): "tp", (False, True): "fp", (True, False): "fn", (False, False): "tn"}
    return dict.fromkeys(names.values(), 0) | {names[r.bad, r.blocked]: r["count"] for r in said.groupBy("bad", "blocked").count().collect()}


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, tokens, won`` of every url."""
    host, path = parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    return urls.select("id", "host", "path", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), given(rules, F.col("host"), F.col("path")).alias("won"))


def judge(
    spark: SparkSession, pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, support: float = 0.001, confidence: float = 0.8, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Verdict on every url: ``<id_col>, host, path, rule, verdict, mined_confidence``.

    ``rule`` is the longest given rule that fits (ties: the first in byte order), else null; its verdict holds. Else a url that a
    mined rule fits is blocked and any other is allowed. A null url, or one without ``://``, has an empty host
    and path, and is allowed unless mined rules say otherwise. Repeated rows get the same verdict; without labels and given rules nothing
    is mined. ``mined_confidence`` is the best fitting mined rule's, null where none fits.
    """
    scratch = Scratch(spark, "urls")
    urls = scratch.table(judged(pages, rules, id_col, url_col), "urls")
    mined, singles = mine_all(spark, labelled(urls, labels), support, confidence)
    fits = scratch.table(match(urls.select("tokens").distinct(), mined, singles), "fits")
    out = urls.join(F.broadcast(fits) if fits.count() <= BROADCAST_SETS else fits, "tokens", "left")
    method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", method).alias("verdict"), F.col("confidence").alias("mined_confidence"))
