import base64
import gc
import gzip
import hashlib
import time
import zlib

import pytest
from pyspark.ml.fpm import FPGrowth  # noqa: F401
from pyspark.sql import functions as F

from rillstream.llm import sharding, url_rules, warc
from rillstream.llm.common import Scratch, components


def test_shards_are_contiguous_and_even(spark):
    rows = [(k, "é" * (k * 37 % 400), "x") for k in range(500)] + [(None, None, "y"), (None, "", "y"), (7, "same", "z"), (7, "same", "z"), (1000, "long " * 3000, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, size string").repartition(7)
    got = sharding.byte_shards(spark, d, shards=8).collect()
    assert len(got) == len(rows)
    total = [0] * 8
    for r in got:
        total[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    largest = max(r.size for r in got)
    assert max(total) - min(total) <= 2 * largest
    for k in range(8):
        mine = sorted((r for r in got if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        ids = [r.doc_id for r in mine if r.doc_id is not None]
        assert ids == sorted(ids)
    sizes = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == sizes
    assert sharding.byte_shards(spark, d.limit(0)).collect() == []


def test_shards_are_written_in_order(spark, tmp_path):
    d = spark.createDataFrame([(k, "t" * k) for k in range(40)], "doc_id long, text string")
    sharding.write_shards(d, sharding.byte_shards(spark, d, shards=4), str(tmp_path / "s"))
    read = spark.read.parquet(str(tmp_path / "s"))
    assert read.count() == 40 and read.select("shard").distinct().count() == 4


def expected(rows, least=0):
    largest = {}
    for i, html, _ in rows:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    out = []
    for i, html, _ in rows:
        raw = (html or "").encode()
        revisit = i is not None and len(raw) >= least and largest[html or ""] != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", largest[html or ""] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 20])
def test_archives_round_trip(spark, tmp_path, least):
    tricky = ["", None, "\r\n\r\n", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "\n" * 50, "é中😀" * 300, "x" * 200_000, "line\rline\nline", "\x00\x01", "same page that is long enough", "tail\r\n"]
    rows = [(k, tricky[k % len(tricky)], f"http://h/{k} é\r\nx") for k in range(40)] + [(None, "same page that is long enough", None), (3, tricky[3], "twice"), (5, "own", None)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, html string, url string, digest string")
    warc.write_archives(spark, d, str(tmp_path / "w"), least_bytes=least)
    read = warc.revisited(warc.read_archives(spark, str(tmp_path / "w")))
    got = sorted([(r.id, r.bytes, r.digest, r.record_type, r.refers_to) for r in read.collect()], key=str)
    assert got == expected(rows, least)


def test_archive_is_well_formed(spark, tmp_path):
    d = spark.createDataFrame([(1, "<p>é</p>", "http://a/"), (2, "<p>é</p>", "http://b/")], "page_id long, html string, url string")
    warc.write_archives(spark, d.coalesce(1), str(tmp_path / "w"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    at, kinds = 0, []
    while at < len(raw):
        head, _, rest = raw[at:].partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
        kinds.append(fields["WARC-Type"])
        at += len(head) + 4 + size + 4
    assert sorted(kinds) == ["response", "revisit"]
    warc.write_archives(spark, d.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).collect() == []


def test_a_cut_off_archive_is_an_error(spark, tmp_path):
    d = spark.createDataFrame([(k, f"<p>{k}</p>\n" * 9, f"http://a/{k}") for k in range(5)], "page_id long, html string, url string")
    warc.write_archives(spark, d.coalesce(1), str(tmp_path / "w"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz")))
    lines = raw.split(b"\n")
    for cut in (len(lines) // 2, len(lines) - 5, 3):
        where = tmp_path / f"cut{cut}"
        where.mkdir()
        (where / "a.gz").write_bytes(gzip.compress(raw))
        (where / "b.gz").write_bytes(gzip.compress(b"\n".join(lines[:cut])))
        with pytest.raises(Exception, match="ends within the record|does not end where"):
            warc.read_archives(spark, str(where)).collect()


def test_revisits_name_their_originals(spark, tmp_path):
    d = spark.createDataFrame([(1, "same", "http://a/1"), (2, "same", "http://a/2"), (None, "same", "http://a/3"), (None, "same", "http://a/4"), (1, "same", "http://a/1")], "page_id long, html string, url string")
    warc.write_archives(spark, d, str(tmp_path / "w"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz")).decode()
    heads = [dict(x.split(": ", 1) for x in r.split("\r\n\r\n")[0].split("\r\n")[1:]) for r in raw.split("\r\n\r\nWARC/1.1")]
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 2 and {(h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"]) for h in revisits} == {("http://a/2", "2024-01-01T00:00:00Z")}
    assert len({h["WARC-Record-ID"] for h in heads}) == 5
    assert {h["WARC-Refers-To"] for h in revisits} == {h["WARC-Record-ID"] for h in heads if h["X-Source-Id"] == "2"}


URLS = [
    ("https://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/123?x#y", "example.org", "/en/123", "example.org/en/1", "block"),
    ("https://EXAMPLE.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.com/fr/1#top", "x.com", "/fr/1", "com/fr/", "allow"),
    ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    ("http://x.com/en/1", "x.com", "/en/1", None, "allow"),
    ("http://x.org", "x.org", "", None, "allow"),
    ("no url", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c/d?e", "b:", "//c/d", None, "allow"),
    ("", "", "", None, "allow"),
]


def test_given_rules(spark):
    d = spark.createDataFrame([(k, u[0], "x") for k, u in enumerate(URLS)] + [(None, "http://x.com/de/1", "x"), (5, "http://x.com/de/1", "x")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_rules.judge(spark, d, labels).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:]
    assert url_rules.judge(spark, d.limit(0), labels).collect() == []


def brute_rules(sets, bad, support, confidence):
    """All token combinations that conclude the label, by counting."""
    from itertools import combinations

    n, out = len(sets), {}
    seen = {c for s in sets for k in range(1, 5) for c in combinations(sorted(s), k)}
    for c in seen:
        has = [b for s, b in zip(sets, bad) if set(c) <= set(s)]
        if sum(has) >= support * n and sum(has) / len(has) >= confidence:
            out[c] = sum(has) / len(has)
    return out


def test_mined_rules_equal_counting(spark):
    urls, labels = [], []
    for k in range(240):
        host, kind = ("spam.net", "good.net")[k % 2], ("win", "news", "about")[k % 3]
        urls.append((k, f"http://{host}/{kind}/{k}.html" + ("?ref=1" if k % 5 == 0 else "")))
        labels.append((k, 1, int(host == "spam.net" and kind == "win" and k % 30 != 0)))
    labels += [(1, None, None), (None, 0, 1), (3, 1, 0)]
    d = spark.createDataFrame(urls, "page_id long, url string")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.mined_confidence) for r in url_rules.judge(spark, d, l, rules=(), support=0.05).collect()}
    host, path = url_rules.parts(F.col("url"))
    sets = {r.page_id: r.t for r in d.select("page_id", url_rules.tokens(F.col("url"), host, path).alias("t")).collect()}
    bad = {i: y for i, _, y in labels if i is not None and y is not None}
    rules = brute_rules([sets[k] for k in range(240)], [bad[k] for k in range(240)], 0.05, 0.8)
    assert rules
    for k in range(240):
        fits = [c for r, c in rules.items() if set(r) <= set(sets[k])]
        assert got[k][0] == ("block" if fits else "allow")
        if fits:
            assert got[k][1] == pytest.approx(max(fits))


def test_rules_are_learned_from_given_verdicts(spark):
    urls = []
    for k in range(1200):
        host = ("a.example.org", "b.com", "c.net")[k % 3]
        urls.append((k, f"http://{host}/{('es', 'fr', 'de', 'it')[k // 3 % 4]}/{('x', 'y', 'z')[k % 5 % 3]}{k}"))
    d = spark.createDataFrame(urls, "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judge(spark, d, none).collect()}
    # block/de comes of com/de/, block/es of example.org/es/: nothing else is labelled under these segments, so .net follows
    for k, url in urls:
        if ".net/" in url:
            assert got[k].rule is None and got[k].verdict == ("block" if "/es/" in url else "allow"), url
    held = url_rules.held_out_quality(spark, url_rules.labelled(url_rules.judged(d), none)["given"])
    assert held["tp"] > 0 and held["fp"] == held["fn"] == 0


def test_long_hosts_have_all_their_parents(spark):
    deep = ".".join(f"l{k}" for k in range(9)) + ".net"
    odd = ".".join(f"q{k}" for k in range(200)) + ".net"
    urls = [(k, f"http://{deep if k % 2 else 'good.l3.net'}/p{'abc'[k % 3]}/{k}") for k in range(200)] + [(1000, f"http://{odd}/a"), (1001, f"http://x.{deep}/other"), (1002, "http://l5.l6.l7.l8.net/a b"), (1003, "http://h.net/" + "s/" * 20_000)]
    d = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(200)], "doc_id long, quality int, toxic int")
    host, path = url_rules.parts(F.col("url"))
    sets = {r.page_id: r.t for r in d.select("page_id", url_rules.tokens(F.col("url"), host, path).alias("t")).collect()}
    assert f"h:{deep}" in sets[1] and "h:l4.l5.l6.l7.l8.net" in sets[1] and f"h:{odd}" in sets[1000]
    got = {r.page_id: r.verdict for r in url_rules.judge(spark, d, labels, rules=()).collect()}
    assert all(got[k] == ("block" if k % 2 else "allow") for k in range(200))
    assert got[1001] == "block" and got[1002] == got[1003] == "allow"


def test_tokens_with_spaces_are_not_taken_apart(spark):
    urls = [(k, "http://n.net/a p:b" if k % 2 else "http://n.net/a/b") for k in range(100)]
    d = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(100)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judge(spark, d, labels, rules=()).collect()}
    assert all(got[k] == ("block" if k % 2 else "allow") for k in range(100))


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(500, 500), (7, 3), (3, 7)]
    d = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in components(Scratch(spark, "t"), d).collect()}
    want = {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 160)}
    assert {k: v for k, v in got.items() if k != v} == want


def test_a_table_leaves_no_large_garbage_in_the_drivers_heap(spark):
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    most = int(0.35 * heap.maxMemory())
    gc.disable()  # what follows goes only when garbage is collected in Python, and then in Java
    held = [spark.sparkContext._jvm.java.util.ArrayList(most // 4)]
    held.append(held)
    del held
    scratch, few = Scratch(spark, "test-heap"), spark.range(3).toDF("id")
    assert scratch.table(few, "few").count() == 3
    time.sleep(3)  # Python tells Java from a thread
    scratch.table(few, "few")
    gc.enable()
    assert heap.totalMemory() - heap.freeMemory() < most


def test_components_without_links_stop_after_a_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, f=Scratch.table: made.append(name) or f(self, df, name))
    none = spark.createDataFrame([(1, 1), (2, None)], "a long, b long")
    assert components(Scratch(spark, "test-none"), none).isEmpty() and made == ["cc-0", "cc-1"]
