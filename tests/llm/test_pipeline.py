"""Each pipeline stage against a plain version of its decision."""

from collections import Counter, defaultdict

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from test_operators import brute_minhash, brute_spans, check_packing

from tidemark.llm import decontam

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, written as the pipeline does."""
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in P.STAGES:
        f(spark, docs, SF).write.parquet(f"{at}/{name}")
        out.append((docs, spark.read.parquet(f"{at}/{name}")))
        docs = out[-1][1]
    return out


def test_columns(stages):
    assert all(set(a.columns) == set(b.columns) for a, b in stages[:-1])


def test_toxicity(spark, stages):
    docs, kept = stages[0]
    gone = docs.join(kept, "doc_id", "left_anti")
    assert gone.count() < 0.35 * docs.count() and kept.exceptAll(docs.select(*kept.columns)).isEmpty()


def test_one_of_each_group(stages):
    docs, kept = stages[1]
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    want = {k[0] for k in brute_minhash(rows) if k[3]}
    assert {r[0] for r in kept.select("doc_id").collect()} == want


def test_decontamination(spark, stages):
    docs, kept = stages[2]
    items = [decontam.normalise(r[0]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    ids = {r[0] for r in kept.select("doc_id").collect()}
    for r in docs.collect():
        text = decontam.normalise(r["text"])
        close = any(decontam.Pattern(q).best(text, decontam.budget(len(q), 0.08)) for q in items)
        assert (r["doc_id"] in ids) == (not close)


def test_secrets_are_gone(stages):
    docs, kept = stages[3]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r for r in kept.collect()}
    assert set(before) == set(after)
    for i, t in before.items():
        assert brute_spans(after[i]["text"]) == "" or "[secret]" in after[i]["text"]
        if not brute_spans(t):
            assert after[i]["text"] == t


def test_packing(stages):
    docs, out = stages[4]
    check_packing(out.collect(), [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])


def test_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "xx", "s", 5), (3, "a b c", "xx", "s", 5), (4, "w " * 5000, "de", None, None), (None, "token = abcdefghijkl", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in P.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert f(spark, docs.limit(0), SF).isEmpty(), name
    assert out.where("doc_id is null").select("text").first()[0] == "[secret]"
    assert P.STAGES[1][1](spark, docs, SF).count() == 5


def test_memos_go(spark):
    """A worker's memo of packing is gone when a task of another operator starts there."""
    from tidemark.llm import packing
    from tidemark.llm.common import tidy

    packing._TOKENIZERS["x", 2] = None
    assert list(tidy(lambda batches: (len(packing._TOKENIZERS) for _ in batches))([1])) == [0]


def test_driver_settles(spark, monkeypatch):
    """What the driver has freed outside its heap goes back after each table that a stage writes, and around training."""
    from tidemark.llm import common, toxicity

    monkeypatch.setattr(common, "_settled", -common.SETTLE_EVERY)
    assert common.settle(spark) and not common.settle(spark)
    calls = []
    for module in (common, toxicity):
        monkeypatch.setattr(module, "settle", calls.append)
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    P.drop_near_copies(spark, docs, SF)
    written = len(calls)
    P.drop_toxic(spark, docs, SF)
    assert written >= 8 and len(calls) >= written + 2
