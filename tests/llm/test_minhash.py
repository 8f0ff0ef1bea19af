import re
from fractions import Fraction

import numpy as np
import pytest

from rillstream.llm import minhash as mh


def brute(rows, size, threshold):
    """Smallest id reachable, by all pairs."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        k = min(size, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both * threshold.denominator >= (len(sets[a]) + len(sets[b]) - both) * threshold.numerator:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


def got(spark, rows, size, threshold):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, key string, rep int")
    return {tuple(r) for r in mh.near_duplicates(spark, df, size, threshold).collect()}


def copies(rng, words, n, most):
    """Copies of one text with none to ``most`` words changed."""
    out = []
    for _ in range(n):
        w = list(words)
        for at in rng.choice(len(w), rng.integers(0, most + 1), replace=False):
            w[at] = f"x{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size,threshold", [(3, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_groups_equal_brute_force(spark, size, threshold):
    rng = np.random.default_rng(11)
    texts = copies(rng, [f"a{rng.integers(500)}" for _ in range(150)], 120, 12)
    texts += copies(rng, [f"b{rng.integers(500)}" for _ in range(60)], 30, 4)
    # a passage that many share, in texts of their own
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [passage + " " + " ".join(f"q{rng.integers(10**6)}" for _ in range(rng.integers(5, 60))) for _ in range(90)]
    texts += ["", None, " \t\n", "One", "one", "two words", "TWO words", "two words", "Öl öl", "öl öl"]
    texts += [texts[0]] * 40 + [texts[5].upper()]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    assert got(spark, rows, size, threshold) == brute(rows, size, threshold)


def test_large_buckets_are_split_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(mh, "OUTSIDE", 3)
    rng = np.random.default_rng(12)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [passage + " " + " ".join(f"q{rng.integers(10**6)}" for _ in range(70)) for _ in range(60)]
    texts += [t + " tail" for t in texts[:30]]
    rows = list(enumerate(texts))
    assert got(spark, rows, 3, Fraction(85, 100)) == brute(rows, 3, Fraction(85, 100))


def test_empty_tables_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert mh.near_duplicates(spark, df).collect() == []
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(map(tuple, mh.near_duplicates(spark, df).collect()), key=str)
    assert out == sorted([(None, 2, None, True)] * 2 + [(7, 2, 7, True)] * 2 + [(9, 2, 7, False)], key=str)
    kept = [r.doc_id for r in mh.drop_near_duplicates(spark, df).collect()]
    assert sorted(kept, key=str) == [7, None, None]


def test_signatures_estimate_similarity(spark):
    rng = np.random.default_rng(13)
    pairs = []
    for share in (0.3, 0.6, 0.9):
        for _ in range(20):
            a = rng.integers(0, 2**63, 400).astype(np.uint64)
            b = a.copy()
            n = int(400 * (1 - share) / (1 + share))
            b[:n] = rng.integers(0, 2**63, n)
            true = (400 - n) / (400 + n)
            pairs.append((*(mh.signature(mh.minima(x)).view(np.int64).tolist() for x in (a, b)), true))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>, t double")
    off = [r.e - r.t for r in df.select(mh.similarity(df.a, df.b).alias("e"), "t").collect()]
    assert max(map(abs, off)) < 0.15 and abs(np.mean(off)) < 0.02


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.85, 0.95])
def test_bands_miss_hardly_a_pair(threshold):
    rows, bands = mh.bands_for(threshold)
    assert rows * bands <= mh.HASHES and (1 - threshold**rows) ** bands < mh.MISS


def test_clashing_columns_come_along(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 7, True, 1, "a"), (2, text, 8, False, 2, "b"), (3, "else " + text[:9], 9, None, 3, "c"), (3, "else again", 1, None, 3, "c"), (None, text, 2, None, 4, "d")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _id long, kept boolean, kept_id long, c0 string")
    got = mh.drop_near_duplicates(spark, d)
    assert got.columns == d.columns and sorted(r.c0 for r in got.collect()) == ["a", "c", "d"]
    assert mh.drop_near_duplicates(spark, d.limit(0)).collect() == []


@pytest.mark.parametrize("n,threshold", [(4, 0.8), (6, 0.85)])
def test_estimates_of_small_sets_stay_within_their_margin(n, threshold):
    rng = np.random.default_rng(3)
    kept = []
    for _ in range(3000):
        s = rng.integers(0, 1 << 63, n + 1, np.uint64) * np.uint64(2)
        x = mh.signature(mh.minima(s[:n])) ^ mh.signature(mh.minima(s))
        unequal = sum(bin(int(v | (v >> np.uint64(1))) & 0x5555555555555555).count("1") for v in x)
        kept.append((1 - unequal / mh.HASHES - 0.25) / 0.75)
    assert min(kept) > mh.least_estimate(threshold)
    assert np.std(kept) < 1.1 * mh.SIGMA  # no wider than independent bits
    assert abs(np.mean(kept) - n / (n + 1)) < 0.005
