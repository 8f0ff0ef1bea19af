import hashlib
import sys
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

ROOT = Path(__file__).parent.parent.parent
sys.path.insert(0, str(ROOT))

import corpus_pipeline  # noqa: E402
from rillstream.llm import decontaminate, minhash  # noqa: E402
from rillstream.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

ITEM = "what is the capital of the country where the longest river of all flows"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    """Clean, toxic, copied and contaminated documents, each known by its id."""
    rng = np.random.default_rng(21)
    where = tmp_path_factory.mktemp("sf")
    draw = lambda n: " ".join(f"w{rng.integers(4000)}" for _ in range(n))
    docs = {k: draw(80) for k in range(300)}
    for k in range(300, 400):
        docs[k] = draw(40) + " scoundrel " + draw(30)
    for k in range(400, 430):
        w = docs[k - 400].split()
        w[5] = "changed"
        docs[k] = " ".join(w)
    for k in range(430, 450):
        docs[k] = draw(50) + ". " + ITEM + "! " + draw(50)
    docs[450], docs[451] = None, ""
    rows = [(k, t, "en", "src0", len(t or "")) for k, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    labels = [(k, 1, int(300 <= k < 400)) for k in docs if k % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(k, f"http://a.example.net/en/{k}", f"<p>{k % 5}</p>") for k in range(30)], "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    return str(where), docs


def test_stages_do_what_they_say(spark, corpus):
    where, docs = corpus
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "decontamination", "sentencepiece"]
    at = spark.read.parquet(f"{where}/documents.parquet")
    columns, after = at.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, where)
        if name != names[-1]:
            assert at.columns == columns
        after[name] = {r.doc_id: r for r in at.collect()}
        at = spark.createDataFrame(at.collect(), at.schema)
    assert set(after["toxicity"]) == set(docs) - set(range(300, 400))
    assert set(after["near duplicates"]) == set(after["toxicity"]) - set(range(400, 430))
    assert set(after["decontamination"]) == set(after["near duplicates"])
    for k, r in after["decontamination"].items():
        assert (r.text != docs[k]) == (430 <= k < 450)
        assert not decontaminate.Automaton([("1", decontaminate.words(ITEM))], 10).spans(decontaminate.words(r.text))[0]
    last = after["sentencepiece"]
    assert set(last) == set(after["decontamination"])
    for k, r in last.items():
        assert r.lossless and r.decoded_sha256 == hashlib.sha256((after["decontamination"][k].text or "").encode()).hexdigest()
    whole = {r.doc_id: r.pieces for r in corpus_pipeline.run(spark, where).collect()}
    assert whole == {k: r.pieces for k, r in last.items()}


def test_copies_of_the_stage_are_near(spark, corpus):
    where, docs = corpus
    d = spark.read.parquet(f"{where}/documents.parquet")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, d, 5, Fraction(4, 5)).collect()}
    assert all(got[k] == k - 400 for k in range(400, 430))


def test_every_query_runs_on_whole_tables(spark, corpus):
    where, docs = corpus
    assert [q.partition("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 11)] and set(ORACLE_SQL) <= set(QUERIES)
    for name, query in QUERIES.items():
        rows = query(spark, where).collect()
        assert len(rows) == (30 if name in ("op4_url_rules", "op7_warc") else len(docs)), name
