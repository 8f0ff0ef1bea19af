"""WARC archives with revisit records, written and read by Spark's text source.

Headers (id, digest, size) are shuffled by payload digest, never payloads: the row with the largest id of each digest
becomes the response, the others revisit it. A record is one string, HTTP head and payload behind its WARC head, and ends
with an empty line, so the text writer's line end completes it: archives are plain ``.warc`` content in gzip files, on any
file system that Spark writes, committed by Spark. Reading streams the files' lines through a parser that follows
``Content-Length``, so payloads may hold anything, and memory holds one record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEX, _B32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(text):
    """Bare upper-case base32 of a string column's SHA-1: 20 bits, five hex and four base32 digits, at a time."""
    digest = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _HEX, _B32)


def _uuid(text):
    h = F.md5(text.cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def headers(df: DataFrame, id_col: str, text_col: str, url_col: str) -> DataFrame:
    payload = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("id"),
        F.octet_length(payload).cast("long").alias("bytes"),
        base32_sha1(payload).alias("digest"),
        # one line of printable characters: a url may hold none of the others
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"),
        payload.alias("payload"),
    )


def resolve(heads: DataFrame, least_bytes: int) -> DataFrame:
    """``heads`` (id, bytes, digest, url) with ``original`` and ``original_url``: the id and url of the response that a row revisits, null for responses.

    The largest id of a digest is pre-aggregated before the shuffle; a hot digest's rows meet it in a join that Spark can
    split. Rows of the largest id itself (repeated rows) are all responses.
    """
    largest = heads.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max(F.struct("id", "url")).alias("largest"))
    both = heads.join(largest, ["digest", "bytes"], "left")
    revisit = F.col("id") < F.col("largest.id")
    return both.withColumns({"original": F.when(revisit, F.col("largest.id")), "original_url": F.when(revisit, F.col("largest.url"))}).drop("largest")


def records(rows: DataFrame, date: str) -> DataFrame:
    """The record of every row (id, bytes, digest, url, payload, original, original_url), without the last line end.

    A response's record id follows from its digest and id, so that revisits can name it; what no other record names, a revisit or a response without
    an id, is numbered by its place in the plan.
    """
    crlf, name = "\r\n", F.coalesce(F.col("id").cast("string"), F.lit(""))
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("bytes").cast("string"), F.lit(crlf * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    of_original = F.concat(
        F.lit(f"WARC-Profile: {_PROFILE}{crlf}WARC-Refers-To: <"),
        _uuid(F.concat_ws(":", F.lit("response"), F.col("digest"), F.col("original").cast("string"))),
        F.lit(f">{crlf}WARC-Refers-To-Target-URI: "),
        F.col("original_url"),
        F.lit(f"{crlf}WARC-Refers-To-Date: {date}{crlf}"),
    )
    unnamed = F.when(revisit | F.col("id").isNull(), F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string"))).otherwise(F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{crlf}WARC-Record-ID: <"),
        _uuid(F.concat_ws(":", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.col("digest"), F.concat(name, unnamed))),
        F.lit(f">{crlf}WARC-Date: {date}{crlf}WARC-Target-URI: "),
        F.col("url"),
        F.lit(f"{crlf}X-Source-Id: "),
        name,
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit(crlf),
        F.when(revisit, of_original).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{crlf}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(crlf * 2),
    )
    return rows.select(F.concat(head, block, F.lit("\r\n\r")).alias("value"))


def write_archives(
    spark: SparkSession, df: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Write deduplicated archives of the rows' payloads (null: empty) to the folder ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest id is the response; smaller payloads and
    rows with null ids are responses. Rows that repeat the largest id of a payload are all responses, with one record id. An empty table gives an empty folder.
    """
    rows = headers(df, id_col, text_col, url_col)
    # digests are resolved on ids and sizes; payloads then move once, to their own id's outcome
    heads = resolve(rows.select("id", "bytes", "digest", "url"), least_bytes).where("original IS NOT NULL")
    heads = heads.select("id", "digest", "original", "original_url").distinct()
    whole = rows.join(heads, ["id", "digest"], "left")
    records(whole, date).write.option("compression", "gzip").option("lineSep", "\n").text(path)


class _Parser:
    """Reads records from the lines of one archive."""

    def __init__(self):
        self.head: dict[str, str] | None = None
        self.body: list[bytes] | None = None
        self.missing = 0

    def feed(self, line: bytes) -> tuple[dict[str, str], bytes] | None:
        """Take a line without its ``\\n``; returns the head and block of the record that it completes."""
        if self.body is not None:
            self.body.append(line)
            self.missing -= len(line) + 1
            if self.missing > 0:
                return None
            block = b"\n".join([*self.body, b""])
            if self.missing or not block.endswith(b"\r\n\r\n"):
                raise ValueError(f"{self.head['warc-record-id']}: the record does not end where its head says")
            out = self.head, block[:-4]
            self.head = self.body = None
            return out
        text = line.rstrip(b"\r")
        if self.head is None:
            if not text.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {text[:40]!r}")
            self.head = {}
        elif text:
            name, _, value = text.decode().partition(":")
            self.head[name.strip().lower()] = value.strip()
        else:  # the block, and the two line ends behind it
            self.missing, self.body = int(self.head["content-length"]) + 4, []
        return None

    def close(self) -> None:
        """The archive ends here: no record may be open."""
        if self.head is not None:
            raise ValueError(f"{self.head.get('warc-record-id', 'a record')}: the archive ends within the record")


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """``id, record_type, record_id, refers_to_id, bytes, digest`` of the archives' records; what a response's digest says is checked on its payload.

    An archive that ends within a record, a record that does not end where its head says, and a payload that is not what its digest
    says are errors, never skipped. An empty folder gives an empty table.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsers: dict[str, _Parser] = {}
        for b in batches:
            out = []
            for file, line in zip(b["file"].to_pylist(), b["value"].to_pylist()):
                if file not in parsers:
                    for before in parsers.values():
                        before.close()
                    parsers = {file: _Parser()}  # a file's lines come together, and files are not split
                if (got := parsers[file].feed(line)) is None:
                    continue
                head, block = got
                http, _, payload = block.partition(b"\r\n\r\n")
                digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length:")).partition(":")[2])
                if kind == "response":
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                        raise ValueError(f"{head['warc-record-id']}: the payload is not what its head says")
                out.append((head["x-source-id"] or None, kind, head["warc-record-id"], head.get("warc-refers-to"), size, digest))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k == 4 else pa.string()) for k in range(6)], ["id", "record_type", "record_id", "refers_to_id", "bytes", "digest"])
        for last in parsers.values():
            last.close()

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    out = lines.mapInArrow(read, "id string, record_type string, record_id string, refers_to_id string, bytes long, digest string")
    return out.withColumn("id", F.col("id").cast(id_type))


def revisited(read: DataFrame) -> DataFrame:
    """Join revisit records to the responses that they refer to: adds ``refers_to``, the response's id. A hot response's records meet it in a join that Spark can split."""
    originals = read.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("id").alias("refers_to"))
    return read.join(originals, "refers_to_id", "left")
