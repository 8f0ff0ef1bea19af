import hashlib
import re

import numpy as np

from rillstream.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, window=10):
    """Every window against every place."""
    out = set()
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(window, len(v))
            for a in range(len(v) - n + 1) if n else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit.update(range(b, b + n))
                        names.add(str(name) if name is not None else "")
        listed = ",".join(sorted(names))
        out.add((i, len(w), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


def cases(seed):
    rng = np.random.default_rng(seed)
    vocab = ["The", "of", "a", "b", "c", "É1", "naïve", "7"]
    draw = lambda n: " ".join(rng.choice(vocab, n))
    items = [(int(k), draw(rng.integers(1, 30))) for k in range(12)] + [(50, ""), (51, None), (None, draw(14)), (9, draw(12)), (10, "zz"), (11, "of the zz yy")]
    docs = [(k, draw(rng.integers(0, 60)) + ", " + items[k % 12][1] + "!" + draw(rng.integers(0, 5))) for k in range(30)]
    docs += [(100, None), (101, ""), (102, "..."), (103, "ZZ"), (104, "x OF-the,zz\nyy"), (None, items[3][1])]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, spans string, items int")
    return d, spark.createDataFrame(items, "item_id long, text string")


def test_hits_equal_brute_force(spark, monkeypatch):
    for seed in range(3):
        docs, items = cases(seed)
        d, b = frames(spark, docs, items)
        got = {tuple(r)[:6] for r in dc.contamination(spark, d, b).collect()}
        assert got == brute(docs, items)
    monkeypatch.setattr(dc, "BLOCK_WORDS", 20)  # several automata
    assert {tuple(r)[:6] for r in dc.contamination(spark, d, b).collect()} == brute(docs, items)
    assert dc.contamination(spark, d.limit(0), b).collect() == []
    assert not any(r.contaminated for r in dc.contamination(spark, d, b.limit(0)).collect())


def test_passages_are_cut_and_clean_documents_stay(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, f"Before it. {item.title()}! After it stays {'x ' * 40}", 0),
        (2, item, 0),
        (3, "nothing to see here", 19),
        (4, None, None),
        (5, "one two three four five " + item + " six seven eight nine ten eleven twelve " + "y " * 80, 0),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in dc.decontaminate(spark, d, b).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[1].text == f"Before it. ! After it stays {'x ' * 40}" and got[1].n_chars == len(got[1].text)
    assert got[3] == rows[2] and got[4] == rows[3]
    left = dc.contamination(spark, dc.decontaminate(spark, d, b), b).collect()
    assert not any(r.contaminated for r in left)


def draw(rng, n, kind):
    return [f"{kind}{x}" for x in rng.integers(0, 10**6, n)]


def test_several_blocks_cut_like_one(spark, monkeypatch):
    rng = np.random.default_rng(11)
    one, two, three = draw(rng, 14, "a"), draw(rng, 14, "b"), draw(rng, 300, "c")
    other = draw(rng, 60, "d")
    docs = [
        (1, " ".join(other[:30] + one + other[30:])),
        (2, " ".join(other[:20] + one[:7] + two + one[7:] + other[20:])),  # cutting the second passage joins the first
        (3, " ".join(one + two + other[:6])),  # hit by both to more than the limit, by neither alone
        (4, " ".join(other)),
        (5, None),
        (None, " ".join(other[:9] + two + other[9:40])),
        (4, " ".join(other)),
    ]
    d = spark.createDataFrame([(i, t, len(t or ""), "x", True) for i, t in docs], "doc_id long, text string, n_chars long, spans string, hit boolean")
    b = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(three))], "item_id long, text string")
    whole = sorted(dc.decontaminate(spark, d, b).collect(), key=str)
    monkeypatch.setattr(dc, "BLOCK_WORDS", 14)
    got = sorted(dc.decontaminate(spark, d, b).collect(), key=str)
    assert got == whole and len(got) == 6 and 3 not in {r.doc_id for r in got}
    again = spark.createDataFrame(got, d.schema)
    assert not any(r.contaminated for r in dc.contamination(spark, again, b).collect())
    for bench in (b, b.limit(0)):
        assert dc.decontaminate(spark, d.limit(0), bench).collect() == []
    assert sorted(dc.decontaminate(spark, d, b.limit(0)).collect(), key=str) == sorted(d.collect(), key=str)
