"""Fingerprints of documents, and every query against all of them."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quern.operators import search
from quern.operators.search import within
from quern.plans import searches
from quern.plans.searches import SIM


def test_every_fingerprint_is_compared_in_blocks(spark, tmp_path, monkeypatch):
    random.seed(3)
    base = [random.getrandbits(60) for _ in range(10)] + [0, (1 << 60) - 1]
    prints = sorted({b ^ sum(1 << k for k in random.sample(range(60), random.randint(0, 5))) for b in base for _ in range(15)})
    df, asked = spark.createDataFrame([(p,) for p in [*prints, *prints[:5], None]], "f long"), spark.createDataFrame([(p,) for p in prints[::4]], "q long")
    want = sorted((q, f) for q in prints[::4] for f in prints if (q ^ f).bit_count() <= 3)
    got = search.every_within(asked, df, 3)
    assert sorted((r.q, r.f) for r in got.collect()) == want == sorted((r.q, r.f) for r in within(asked, df, 3).collect())
    for hot in (0, 2, 20):  # each pair is one row, though blocks agree several times
        assert sorted((r.q, r.f) for r in within(asked, df, 3, hot=hot).collect()) == want
    assert "keys=[q" not in within(asked, df, 3)._jdf.queryExecution().sparkPlan().toString().split("Join")[0]
    asked.repartition(3).write.parquet(f"file://{tmp_path}/asked")
    for name in ("LAID", "READ", "SENT"):
        monkeypatch.setattr(search, name, 7)
    batches = list(search.compared(f"file://{tmp_path}/asked", 3, iter([pa.RecordBatch.from_pydict({"f": prints})])))
    assert len(batches) > 1 and sorted((r["q"], r["f"]) for b in batches for r in b.to_pylist()) == want


def test_words_are_added_up_where_they_are_read(spark, tmp_path, monkeypatch):
    words = ["the", "a", "é", "of", "x" * 70, "Ab"]
    random.seed(9)
    texts = [" ".join(random.choices(words, k=n)) for n in (1, 3, 254, 255, 256, 700)] + ["", "   ", None, " a  a "]
    rows = [(20 * i, t) for i, t in enumerate(texts)] + [(20, "of of of"), (7, texts[4]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    state = SIM.state(docs.filter("doc_id IS NOT NULL").select("doc_id", F.explode(F.split("text", " ", -1)).alias("w")).filter("w != ''"), "doc_id", "w")
    want = {r.doc_id: r.fingerprint for r in SIM.fingerprint(state).collect()}
    assert {r.doc_id: r.fingerprint for r in searches._prints(docs.filter("doc_id IS NOT NULL")).collect()} == want
    once = docs.filter("doc_id % 20 = 0 AND text != 'of of of'")
    prints = searches._prints(once)
    assert {r.doc_id for r in prints.collect()} == {20 * i for i in (0, 1, 2, 3, 4, 5, 9)}
    plan = prints._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    sums = {r.doc_id: r.sums for r in state.collect()}
    for added in (2, 100):
        monkeypatch.setattr(searches, "ADDED", added)
        for i, batch in enumerate(searches._summed(iter([pa.RecordBatch.from_pydict({"doc_id": [100], "text": [texts[5]]}), pa.RecordBatch.from_pydict({"doc_id": [140, 80, 180], "text": ["  ", texts[4], " a  a "]})]))):
            assert {r["doc_id"]: r["sums"] for r in batch.to_pylist()} == {k: sums[k] for k in ((100,), (80, 180))[i]}
    docs.filter("doc_id IS NULL OR doc_id != 20 OR text = 'of of of'").write.parquet(f"{tmp_path}/documents.parquet")
    near = {r.doc_id: r.near for r in searches.simhash_near_documents(spark, str(tmp_path)).collect()}
    assert near[80] == 1  # a row without an id is none of the others, as in SQL
