"""The registered queries of this subpackage: thin calls of the operators on their whole tables."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, lattice, lm, minhash, sharding, token_counts, toxicity, url_rules, warc
from .common import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.sampled_pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.drop("spans", "items")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(spark, _read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _read(spark, sf_dir, "documents"), size=3, threshold=Fraction(85, 100))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(spark, _read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Scratch(spark, "warc").path("archives")
    warc.write_archives(spark, _read(spark, sf_dir, "pages"), archives)
    found = warc.revisited(warc.read_archives(spark, archives))
    return found.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return toxicity.toxicity(spark, documents, toxicity.fit(spark, documents, _read(spark, sf_dir, "labels")))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(spark, _read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(spark, _read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sentencepiece, op3_decontamination, op4_url_rules, op5_minhash, op6_fingerprints, op7_warc, op8_toxicity, op9_lm_scores, op10_sharding)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op3_decontamination"] = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
    SELECT item, w, least(10, len(w)) AS size FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item, size, list_slice(w, i, i + size - 1) AS win FROM (SELECT item, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM sized)
), sizes AS (
    SELECT DISTINCT size FROM windows
), placed AS (
    SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS win
    FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM docs, sizes WHERE len(w) >= size)
), found AS (
    SELECT p.doc_id, p.size, p.i, v.item FROM placed p JOIN windows v ON p.size = v.size AND p.win = v.win
), hits AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS pos FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

ORACLE_SQL["op5_minhash"] = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 2)) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
    SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS both FROM sets p JOIN sets q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
    JOIN sizes m ON m.doc_id = x.a JOIN sizes n ON n.doc_id = x.b WHERE 100 * x.both >= 85 * (m.n + n.n - x.both)
), reach AS (
    SELECT doc_id AS node, doc_id AS root FROM docs UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
), least AS (
    SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, l.root AS component_id, l.root = d.doc_id AS kept
FROM docs d LEFT JOIN sizes n ON n.doc_id = d.doc_id JOIN least l ON l.node = d.doc_id
"""

ORACLE_SQL["op7_warc"] = r"""
WITH heads AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex, coalesce(html, '') AS html FROM pages
), digits AS (
    SELECT *, [CAST('0x' || substr(hex, 1 + 5 * k, 5) AS BIGINT) FOR k IN range(8)] AS v FROM heads
), named AS (
    SELECT page_id, payload_bytes, html, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[1 + k // 4] >> (15 - 5 * (k % 4))) & 31) + 1, 1) FOR k IN range(32)], 'string_agg', '') AS payload_digest FROM digits
), largest AS (
    SELECT html, max(page_id) AS page FROM named GROUP BY html
)
SELECT n.page_id, n.payload_bytes, n.payload_digest, CASE WHEN n.page_id = l.page THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN n.page_id <> l.page THEN l.page END AS refers_to
FROM named n JOIN largest l ON l.html = n.html
"""

ORACLE_SQL["op10_sharding"] = r"""
WITH rows AS (
    SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) + 8 AS size, coalesce(text, '') AS text FROM documents
), nibbles AS (
    -- the check sum's table, a byte at a time: eight steps of the reversed polynomial for each of 256 values
    SELECT v, list_reduce(list_prepend(CAST(v AS BIGINT), range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) g(v)
), tab AS (
    SELECT list(t ORDER BY v) AS t FROM nibbles
), bytes AS (
    SELECT DISTINCT text, list_transform(range(CAST(strlen(text) AS BIGINT)), lambda k: CAST('0x' || substr(hex(encode(text)), 2 * k + 1, 2) AS BIGINT)) AS b FROM rows
), sums AS (
    SELECT text, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM bytes, tab
), placed AS (
    SELECT doc_id, size, crc, (24 * (sum(size) OVER w - size)) // sum(size) OVER () AS shard FROM rows JOIN sums USING (text)
    WINDOW w AS (ORDER BY doc_id NULLS FIRST, crc, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed
"""
