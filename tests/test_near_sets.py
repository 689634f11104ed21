"""Near sets in blocks of queries against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.hashing import md5_60, md5_60_of
from quern.operators import near_sets as blocks
from quern.operators.near_sets import near_sets
from quern.operators.similarity import MinHash, banded, met
from quern.plans import searches


@pytest.mark.parametrize("threshold,block,meetings", [(0.3, 50, 3), (0.7, 1 << 22, 1 << 21), (0.7, 50, 3), (1.0, 200, 1)])
def test_near_sets_equal_all_pairs_and_their_bands(spark, monkeypatch, threshold, block, meetings):
    random.seed(3)
    monkeypatch.setattr(blocks, "MEETINGS", meetings)
    sets = [set(random.sample(range(50), random.randint(1, 14))) for _ in range(40)]
    sets = [s | {99} for s in sets + [s ^ set(random.sample(range(50), random.randint(0, 2))) for s in sets]] + [{1}, {1}]
    rows = [(i, [x * 7_919 for x in s]) for i, s in enumerate(sets)] + [(900, []), (901, None), (None, [1])]
    df = spark.createDataFrame(rows, "s long, _x array<long>")
    index = MinHash(16)
    got = near_sets(df.filter("s % 4 = 0").withColumnRenamed("s", "a"), df.withColumnRenamed("s", "b"), threshold, index, 2, block_items=block).collect()
    exact = {(a, b): len(sets[a] & sets[b]) for a in range(0, len(sets), 4) for b in range(len(sets)) if a != b}
    assert {(r.a, r.b): r.common for r in got} == {k: n for k, n in exact.items() if n / len(sets[k[0]] | sets[k[1]]) >= threshold - 1e-9}
    assert len(got) == len({(r.a, r.b) for r in got}) and all((r.na, r.nb) == (len(sets[r.a]), len(sets[r.b])) for r in got)
    # The hashes are the items here.
    own = MinHash(16, lambda x: x.cast("long"))
    items = df.filter("s IS NOT NULL").select("s", F.explode("_x").alias("x"))
    state = own.state(items, "s", "x")
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    signed = own.signature(np.concatenate([x for _, x in rows[: len(sets)]]), ends)
    assert {(r.s, r.slot): r.value for r in state.collect()} == {(i, j): int(x) for i, line in enumerate(signed) for j, x in enumerate(line)}
    buckets = banded(state, "s", 2)
    share = {(r.a, r.b) for r in met(buckets, buckets, "s").collect()}
    assert {(r.a, r.b) for r in got if r.met} == {(r.a, r.b) for r in got} & share


def test_documents_searched_in_several_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ITEMS", 40)
    monkeypatch.setattr(searches, "PIECE", 64)
    texts = {20 * i + j: " ".join(f"w{i}x{k}" for k in range(j // 5, 12)) for i in range(6) for j in (0, 3, 6, 19)}
    rows = [*texts.items(), (40, "more of it"), (7_000, None), (7_020, "  "), (None, texts[0])]  # an id twice: its words are those of both
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words: dict = {}
    for i, text in rows:
        words.setdefault(i, set()).update(w for w in (text or "").split(" ") if w)
    words = {i: w for i, w in words.items() if w and i is not None}
    near = {a: sum(a != b and len(x & y) / len(x | y) >= 0.7 for b, y in words.items()) for a, x in words.items() if a % 20 == 0}
    assert {r.doc_id: (r.near, r.within_bound) for r in searches.minhash_near_documents(spark, str(tmp_path)).collect()} == {a: (n, True) for a, n in near.items()}


def test_hashes_of_arrays_are_those_of_columns(spark):
    words = ["", "a", "Straße", "w" * 300]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(md5_60(F.col("w"))).collect()] == md5_60_of([w.encode() for w in words]).tolist()
