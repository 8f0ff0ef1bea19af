import zlib

import numpy as np

from rillstream.llm import toxicity as tx


def corpus(n, seed=1):
    """Insults alone are banter, groups alone are news; both together are toxic."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.integers(3000)}" for _ in range(rng.integers(5, 60))]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w += ["clod"] * a + ["martians"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w), "en" if i % 2 else None))
        labels.append((i, int(a and b)))
    return rows, labels


def test_pairs_of_terms_count(spark):
    rows, labels = corpus(1500)
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    m = tx.fit(spark, d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = tx.toxicity(spark, d, m).collect()
    held = [(r.predicted, labels[r.doc_id][1]) for r in got if r.held_out]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(300)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lies = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]
    a, b = (tx.fit(spark, d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, lies))
    assert a.slots == b.slots and (a.w == b.w).all() and a.bias == b.bias


def test_odd_inputs(spark):
    d = spark.createDataFrame([(1, None), (None, ""), (3, "word " * 20000), (3, "word " * 20000)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None), (3, 0), (3, 0)], "doc_id long, toxic int")
    m = tx.fit(spark, d, labels)
    got = tx.toxicity(spark, d, m).collect()
    assert len(got) == 4 and all(r.predicted == 0 for r in got) and next(r for r in got if r.doc_id is None).held_out
    assert tx.toxicity(spark, d.limit(0), m).collect() == []
    empty = tx.fit(spark, d, labels.limit(0))
    assert [r.predicted for r in tx.toxicity(spark, d, empty).collect()] == [0] * 4


def test_gradient_reaches_the_vectors():
    rng = np.random.default_rng(3)
    docs = [[int(a), 2 + int(b)] for a, b in rng.integers(0, 2, (400, 2))]
    y = [int((a == 1) ^ (b == 3)) for a, b in docs]
    m = tx.train([10, 11, 12, 13], docs, y, epochs=80)
    assert np.mean([(m.score(d) >= 0.5) == t for d, t in zip(docs, y)]) > 0.99


def test_terms_that_say_nothing_alone_are_learned_in_pairs(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(1500):
        w = [f"w{rng.integers(3000)}" for _ in range(rng.integers(5, 60))]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w += ["clod"] * a + ["martians"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(a != b)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    m = tx.fit(spark, d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [(r.predicted, labels[r.doc_id][1]) for r in tx.toxicity(spark, d, m).collect() if r.held_out]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.95


def test_scores_equal_a_plain_sum_over_pairs():
    rng = np.random.default_rng(9)
    m = tx.Machine({s: s for s in range(30)}, 0.3, rng.normal(size=30), rng.normal(size=(30, 8)))
    for n in (0, 1, 2, 9):
        f = sorted(rng.choice(30, n, replace=False).tolist())
        z = m.bias + sum(m.w[a] for a in f) + sum(float(m.v[a] @ m.v[b]) for k, a in enumerate(f) for b in f[k + 1 :])
        assert abs(m.score(f) - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-12


def test_other_names_and_the_share_of_each_class(spark):
    rows, labels = corpus(900)
    d = spark.createDataFrame(rows, "key long, body string, predicted string")
    l = spark.createDataFrame([(i, y, 7) for i, y in labels], "doc long, bad int, y int")
    of = dict(id_col="key", text_col="body", label_col="bad", label_id_col="doc")
    m = tx.fit(spark, d, l, **of)
    few = tx.fit(spark, d, l, most=60, **of)
    assert m.slots and few.slots and few.bias < tx.train(list(few.slots), [[]] * 4, [0, 1, 0, 1]).bias + 5
    kept = tx.drop_toxic(spark, d, m, text_col="body")
    assert kept.columns == d.columns
    got = {r.key for r in kept.collect()}
    assert got == {r.key for r in tx.toxicity(spark, d, m, "key", "body").where("predicted = 0").collect()}
    assert tx.drop_toxic(spark, d.limit(0), m, text_col="body").collect() == []
