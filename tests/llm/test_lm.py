import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rillstream.llm import lm
from rillstream.llm.elias_fano import EliasFano, Trie


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(rows, discount):
    """The model by dictionaries, a row at a time."""
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows]
    count, pairs, kinds = Counter(), Counter(), defaultdict(set)
    for (_, text), out in zip(rows, held):
        if not out:
            w = words(text)
            count.update([*w, None])
            for a, b in zip(["<", *w], [*w, None]):
                pairs[a, b] += 1
                kinds[a].add(b)
    n, v = sum(count.values()), len(count)
    begin = count[None]
    result = []
    for (i, text), out in zip(rows, held):
        w = words(text)
        p = lambda x: (count[x] + 1) / (n + v + 1)
        base = sum(math.log10(p(x)) for x in [*w, None])
        score = 0.0
        for a, b in zip(["<", *w], [*w, None]):
            total = begin if a == "<" else count[a]
            if pairs[a, b]:
                score += math.log10((pairs[a, b] - discount) / total)
            elif total:
                score += math.log10(discount * len(kinds[a]) / total) + math.log10(p(b))
            else:
                score += math.log10(p(b))
        result.append((i, out, len(w) + 1, sum(count[x] > 0 for x in [*w, None]), n, base, score))
    return result


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, key string, score double")
    got = [tuple(r) for r in lm.lm_scores(spark, df, **options).collect()]
    want = brute(rows, lm.DISCOUNT)
    assert len(got) == len(want)
    order = lambda r: (r[0] is None, r[0] or 0, r[5], r[6])
    for g, w in zip(sorted(got, key=order), sorted(want, key=order)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert g[6] == pytest.approx(w[6], rel=2e-3, abs=2e-3)


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = ["The", "the", "a", "Öl", "öl", *(f"w{k}" for k in range(60))]
    rows = [(int(i), " ".join(rng.choice(vocab, rng.integers(1, 60), p=None)) + "\n") for i in range(120)]
    rows += [(200, ""), (201, None), (None, "the a the"), (202, "\t \n"), (203, "the " * 3000), (300, "a the"), (300, "a the"), (300, "the a")]
    check(spark, rows)
    check(spark, rows, pairs_each=100)  # many shards, and hot words in several of them


def test_without_rows_or_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.lm_scores(spark, empty).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    check(spark, [(held, "a b")])


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 20000])
@pytest.mark.parametrize("top", [10, 10**6, 2**62])
def test_elias_fano_finds_successors(n, top):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, top, n).astype(np.uint64))
    e = EliasFano.of(EliasFano.build(v).arrays())
    if len(v):
        assert (e.get(np.arange(len(v))) == v).all()
    q = np.concatenate([v[:500], rng.integers(0, top, 500).astype(np.uint64), np.array([0, top, top * 2], np.uint64)])
    at, found = e.find(q)
    assert (at == np.searchsorted(v, q)).all() and (found == np.isin(q, v)).all()


def test_trie_is_compact_and_mapped():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)
    a, b = rng.choice(words, 20000), rng.choice(words, 20000)
    own, inverse, counts = np.unique(a, return_inverse=True, return_counts=True)
    both, n = np.unique(np.stack([inverse.astype(np.uint64), b]), axis=1, return_counts=True)
    trie = Trie.of_counts(own, counts.astype(float), both[0].astype(np.int64), both[1], n, 0.7)
    rank, found = trie.mapped().look_up(a)
    assert found.all()
    value, seen = trie.mapped().score(rank, b)
    counts, pairs = Counter(a.tolist()), Counter(zip(a.tolist(), b.tolist()))
    want = [math.log10((pairs[x, y] - 0.7) / counts[x]) for x, y in zip(a.tolist(), b.tolist())]
    assert seen.all() and np.abs(value - want).max() < 2e-3
    assert not trie.score(rank[:50], rng.integers(0, 2**63, 50).astype(np.uint64))[1].any()
    assert sum(x.nbytes for x in trie.arrays()) < 10 * len(pairs)
