import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstream.llm import fingerprints as fp


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, th string, n int")
    return {(r.doc_id, r.n_chars, r.edited_sha256): r for r in fp.edited_fingerprints(spark, df).collect()}


def edited(rows):
    """By the contract, a document at a time; ids are unique."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        out[i] = (len(t), hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest())
    return out


def test_edited_texts_and_likeness(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}é" for k in range(900)]
    rows = [(int(i), " ".join(rng.choice(words, 300))) for i in rng.permutation(60)]
    rows += [(100, ""), (101, None), (102, "ab"), (103, "日本語のテキスト" * 30), (None, "one two three four five six seven")]
    got = run(spark, rows)
    assert {(k[0], k[1], k[2]) for k in got} == {(i, n, h) for i, (n, h) in edited(rows).items()}
    long = [r for r in got.values() if r.doc_id is not None and r.doc_id < 60]
    assert np.mean([r.near_edited for r in long]) == pytest.approx(0.5, abs=0.08)
    assert max(r.near_next for r in long if r.doc_id not in (0,)) < 0.05
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_equal_texts_and_repeated_rows(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words here to be read by all"), (3, "other words here to be read by all"), (3, "third")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fp.edited_fingerprints(spark, df).collect()
    assert len(got) == 5
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert fp.edited_fingerprints(spark, df.limit(0)).collect() == []
    alone = fp.edited_fingerprints(spark, df.limit(1)).collect()[0]
    assert alone.near_next == 1.0




def test_anchors_are_closed_syncmers(spark):
    rng = np.random.default_rng(4)
    tokens = [f"t{x}" for x in rng.integers(0, 50, 200)]
    df = spark.createDataFrame([(" ".join(tokens),)], "text string")
    smers = [f"xxhash64(xxhash64('{a}'), xxhash64('{b}'))" for a, b in zip(tokens, tokens[1:])]
    values = df.selectExpr(f"array({','.join(smers)}) AS v").first().v
    w = fp.K - fp.S + 1
    want = [i for i in range(len(tokens) - fp.K + 1) if min(values[i : i + w]) in (values[i], values[i + w - 1])]
    got = [a.place for a in df.select(fp.anchors(F.col("text")).alias("a")).first().a]
    assert got == want and 0.3 < len(got) / len(tokens) < 0.7


def plain_steps(anchors):
    """Counter of (hash, next hash, distance), or of the lone anchor."""
    if len(anchors) == 1:
        return Counter([anchors[0].hash])
    return Counter((x.hash, y.hash, y.place - x.place) for x, y in zip(anchors, anchors[1:]))


def plain_likeness(a, b):
    a, b = plain_steps(a), plain_steps(b)
    both = (a & b).total()
    return both / (a.total() + b.total() - both) if a or b else 1.0


def test_anchors_and_steps_move_with_their_passage(spark):
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{x}" for x in rng.integers(0, 10**6, 80))
    rows = [("x y z " + passage + " end", "start " * 40 + passage)]
    df = spark.createDataFrame(rows, "a string, b string")
    both = [fp.anchors(F.col(c)) for c in "ab"]
    r = df.select(*both, F.array_intersect(*(fp.steps(x) for x in both))).first()
    place = [{x.hash: x.place for x in side} for side in r[:2]]
    shared = [h for h in place[0] if h in place[1]]
    assert len(shared) > 20 and {place[1][h] - place[0][h] for h in shared} == {37}
    assert len(shared) - 3 <= len(r[2]) <= len(shared)
    # the same anchors in another order agree in no shift
    words = passage.split()
    turned = " ".join(w for k in range(0, 80, 10) for w in words[70 - k : 80 - k])
    near = spark.createDataFrame([(passage, turned)], "a string, b string").select(fp.likeness(*(fp.steps(fp.anchors(F.col(c))) for c in "ab"))).first()[0]
    assert near < 0.6


def test_texts_without_a_closed_kmer_are_one_anchor(spark):
    rng = np.random.default_rng(6)
    texts = sorted({" ".join(f"s{x}" for x in rng.integers(0, 1000, n)) for n in (5, 6, 7) for _ in range(40)})
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fp.anchors(F.col("text")).alias("a")).collect()
    assert all(len(r.a) > 0 for r in rows)
    assert len({tuple(x.hash for x in r.a) for r in rows}) == len(texts)


def test_long_texts_keep_every_anchor_and_its_place(spark):
    rng = np.random.default_rng(7)
    shared = [f"p{x}" for x in rng.integers(0, 10**6, 200)]
    one, two = ([f"{c}{x}" for x in rng.integers(0, 10**6, 6000)] for c in "ab")
    rows = [(2, " ".join(one[:3000] + shared + one[3000:])), (1, " ".join(two[:100] + shared + two[100:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: [(x.place, x.hash % 2**64) for x in r.a] for r in df.select("doc_id", fp.anchors(F.col("text")).alias("a")).collect()}
    got = {r.doc_id: r for r in fp.edited_fingerprints(spark, df).collect()}
    read = {i: [tuple(int(v, 16) for v in x.split(":")) for x in r.fingerprint.split(",")] for i, r in got.items()}
    assert read == kept and len(kept[2]) > 2000
    anchors = {r.doc_id: r.a for r in df.select("doc_id", fp.anchors(F.col("text")).alias("a")).collect()}
    want = plain_likeness(anchors[1], anchors[2])
    assert want > 0.01 and got[2].near_next == got[1].near_next == pytest.approx(want, abs=1e-12)


def test_likeness_is_that_of_plain_multisets_of_steps(spark):
    rng = np.random.default_rng(8)
    line = " ".join(f"q{x}" for x in range(12))
    texts = [" ".join([line] * n) + tail for n in (1, 2, 5, 40) for tail in ("", " other end of it all")]
    texts += [" ".join(f"r{x}" for x in rng.integers(0, 3, n)) for n in (1, 4, 5, 9, 60, 400)] + ["", "日本語のテキストを読む" * 9, "x" * 200 + " " + "日本" * 4]
    pairs = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    x, y = fp.anchors(F.col("a")), fp.anchors(F.col("b"))
    for r in df.select(x.alias("x"), y.alias("y"), fp.likeness(fp.steps(x), fp.steps(y)).alias("n")).collect():
        assert r.n == pytest.approx(plain_likeness(r.x, r.y), abs=1e-12)


def test_tokens_are_those_of_one_pattern(spark):
    lone = r"\p{IsIdeographic}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
    texts = ["", " ", "a  b\tc\n", "x" * 50, "é" * 17 + " ü", "日本 語テキスト mixed日本x", "ab–cd … ef", "ไทย ภาษา", "a" * 16 + " " + "b" * 17, "  lead and trail  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.regexp_extract_all(F.lower("t"), F.lit(rf"[{lone}]|[^\s{lone}]{{1,16}}"), F.lit(0))
    for r in df.select("t", fp._hashed_tokens(F.col("t")).alias("got"), F.transform(whole, lambda x: F.xxhash64(x)).alias("want")).collect():
        assert r.got == r.want, r.t
