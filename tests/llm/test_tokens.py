import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from rillstream.llm import lattice as lt
from rillstream.llm import token_counts as tc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library(spark):
    rng = random.Random(1)
    alphabet = "ab cde  \n\n \té中😀▁thein the of\r.,<>s/0x\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["", " ", "   ", "\n", "<s>x</s>", "<0x0A>", "▁", "a" * 3000, "word " * 5000, "x" * 200 + " y"]
    c = tc.counter(MODEL)
    assert c.lines and len(c.spaced.known) > 10_000
    assert [c.count(t) for t in texts] == [len(c.sp.encode(t)) for t in texts]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts[-200:])] + [(None, None, None), (7, "a", "x"), (7, "a", "x")], "doc_id long, text string, n_tokens string")
    got = tc.token_counts(df, MODEL, limit=100).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter([(k, len(c.sp.encode(t))) for k, t in enumerate(texts[-200:])] + [(None, 0), (7, 1), (7, 1)])
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert {r.n_bytes for r in got if r.doc_id is None} == {0}
    assert tc.token_counts(df.limit(0), MODEL).collect() == []


def test_a_worker_forgets(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 5)
    c = tc.TokenCounter(MODEL)
    texts = [f"zq{k} xv{k}\nzz{k}" for k in range(40)] * 2
    assert [c.count(t) for t in texts] == [len(c.sp.encode(t)) for t in texts]
    assert len(c.bare) <= 6


def segmentations(lat, word):
    """All paths of a word's lattice with their weights."""
    if not word:
        yield (), 1.0
        return
    for k in range(1, len(word) + 1):
        if (i := lat.id.get(word[:k])) is not None:
            for rest, w in segmentations(lat, word[k:]):
                yield (i, *rest), w * lat.weight[word[:k]]
    if word[0] not in lat.id:
        raw = word[0].encode()
        for rest, w in segmentations(lat, word[1:]):
            yield (*(lat.byte_id[b] for b in raw), *rest), w * lat.byte_weight ** len(raw)


@pytest.mark.parametrize("text", ["then the", "a  b\n", "▁x🜀"])
def test_samples_follow_the_lattice(text):
    lat, n = lt.Lattice(MODEL, 0.5), 20_000
    weight = Counter()
    for s, w in segmentations(lat, " " + text):
        weight[s] += w
    total = sum(weight.values())
    got = Counter(tuple(f.tolist()) for f in lat.sample([text] * n, lt.row_keys(list(range(n)), 3)))
    assert set(got) <= set(weight)
    for s, w in weight.items():
        mean = n * w / total
        assert abs(got[s] - mean) < 6 * math.sqrt(mean) + 6


def test_segmentations_are_lossless_and_reproducible(spark, monkeypatch):
    rng = random.Random(2)
    alphabet = "abc de  \n▁é中😀\x00th"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "q" * 5000, "w " * 4000]
    lat = lt.Lattice(MODEL)
    keys = lt.row_keys(list(range(len(texts))), 5)
    whole = lat.sample(texts, keys)
    assert [lat.decode(f) for f in whole] == texts
    other = lt.Lattice(MODEL)
    for k in rng.sample(range(len(texts)), 60):
        assert (other.sample([texts[k]], keys[k : k + 1])[0] == whole[k]).all()
    monkeypatch.setattr(lt, "SHORT", 2)
    monkeypatch.setattr(lt, "LONGEST", 4)
    odd = lt.Lattice(MODEL)
    assert all((a == b).all() for a, b in zip(odd.sample(texts, keys), whole))
    df = spark.createDataFrame([(k, t, 3) for k, t in enumerate(texts[:50])] + [(None, None, 1), (4, texts[4], 2)], "doc_id long, text string, pieces int")
    got = lt.sampled_pieces(df, MODEL, seed=5).collect()
    assert all(r.lossless and r.n_pieces == len(r.pieces) for r in got)
    assert {r.doc_id: r.pieces for r in got if r.doc_id is not None} == {k: whole[k].tolist() for k in range(50)}
    assert lt.sampled_pieces(df.limit(0), MODEL).collect() == []


@pytest.mark.parametrize("theta", [0.0, 1.0, 6.0])
def test_a_full_worker_draws_like_a_fresh_one(theta):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdethins") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) + " 🜀é中 " + "then" * 100 for _ in range(200)]
    keys = lt.row_keys(list(range(len(texts))), 9)
    full = lt.Lattice(MODEL, theta)
    full.sample([" ".join(words)] * 3, keys[:3])
    # as if nearly all the nodes that a worker may remember stood before
    filler = 200_000
    full.head.frombytes(np.full(filler, len(full.share), np.int32).tobytes())
    full.nodes += filler
    whole = full.sample(texts, keys)
    assert [full.decode(f) for f in whole] == texts
    for k in range(0, len(texts), 5):
        fresh = lt.Lattice(MODEL, theta) if k == 0 else fresh
        fresh.forget()
        assert (fresh.sample([texts[k]], keys[k : k + 1])[0] == whole[k]).all()
    places = np.concatenate([np.frombuffer(full.share, np.uint32)])
    assert places.max() == lt.WHOLE


def test_paths_through_the_lattice_give_equal_shares(monkeypatch):
    rng = random.Random(6)
    parts = ["".join(rng.choice("abcdethins") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    lat = lt.Lattice(MODEL)
    lat.sample(parts, lt.row_keys(parts, 1))
    monkeypatch.setattr(lt, "SHORT", 0)
    slow = lt.Lattice(MODEL)
    slow.sample(parts, lt.row_keys(parts, 1))
    assert lat.share == slow.share and lat.piece == slow.piece and lat.before == slow.before and lat.head == slow.head


def test_theta_is_bounded():
    with pytest.raises(ValueError):
        lt.Lattice(MODEL, 7.5)


def test_different_rows_differ():
    lat = lt.Lattice(MODEL, 0.3)
    got = lat.sample(["something longer to be cut"] * 50, lt.row_keys(list(range(50)), 1))
    assert len({tuple(f.tolist()) for f in got}) > 10
    again = lat.sample(["something longer to be cut"] * 50, lt.row_keys(list(range(50)), 2))
    assert any(len(a) != len(b) or (a != b).any() for a, b in zip(got, again))
    assert np.concatenate(got).dtype == np.int32
