"""Searches with blocks of bits and rarest items against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import similarity
from quern.operators.search import least_similarity, neighbours, recall, within
from quern.sources import working


@pytest.mark.parametrize("distance,hot", [(0, 1000), (1, 5), (3, 1000), (3, 2), (3, 0)])
def test_near_fingerprints_equal_all_pairs(spark, distance, hot):
    random.seed(distance + hot)
    base = [random.getrandbits(60) for _ in range(12)]
    prints = base + [b ^ sum(1 << k for k in random.sample(range(60), random.randint(1, 5))) for b in base for _ in range(12)]
    prints += [(base[0] & ~((1 << 15) - 1)) | random.getrandbits(15) for _ in range(40)]  # many agree in three blocks
    df = spark.createDataFrame([(p,) for p in prints], "f long")
    asked = spark.createDataFrame([(p,) for p in prints[::5]], "q long")
    got = {(r.q, r.f): r.distance for r in within(asked, df, distance, hot=hot).collect()}
    assert got == {(q, f): (q ^ f).bit_count() for q in prints[::5] for f in prints if (q ^ f).bit_count() <= distance}
    with pytest.raises(ValueError):
        within(asked, df, 60)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 1.0])
def test_neighbours_equal_all_pairs(spark, threshold):
    random.seed(7)
    sets = [set(random.sample(range(40), random.randint(1, 12))) for _ in range(40)]
    sets += [s ^ set(random.sample(range(40), random.randint(0, 2))) for s in sets] + [{1}, {1}]
    rows = [(i, x) for i, s in enumerate(sets) for x in s | {99}]  # an item that all have
    df = spark.createDataFrame(rows, "s long, x long")
    got = {(r.a, r.b): round(r.jaccard, 9) for r in neighbours(df.filter("s % 4 = 0"), df, "s", "x", threshold).collect()}
    full = [s | {99} for s in sets]
    exact = {(a, b): round(len(full[a] & full[b]) / len(full[a] | full[b]), 9) for a in range(0, len(full), 4) for b in range(len(full)) if a != b}
    assert got == {k: v for k, v in exact.items() if v >= threshold}
    with pytest.raises(ValueError):
        neighbours(df, df, "s", "x", 0)


def test_recall_of_what_was_found(spark):
    pairs = lambda *x: spark.createDataFrame(list(x), "a long, b long")
    assert tuple(recall(pairs((1, 2), (1, 3), (2, 3)), pairs((1, 2), (1, 2), (5, 6))).first()) == (3, 1, 1 / 3)
    assert recall(pairs(), pairs((1, 2))).first().recall == 1.0
    assert abs(1 - (1 - least_similarity(4, 16, 0.9) ** 4) ** 16 - 0.9) < 1e-9


@pytest.mark.parametrize("block", [5, 1_024])
def test_every_pair_by_blocks_equals_pairs_one_by_one(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity.every_pair, "__defaults__", (None, None, block))
    rows = spark.range(24).select(F.col("id").alias("s"), F.explode(F.sequence(F.col("id") % 7, F.col("id") % 7 + 9)).alias("i")).withColumn("w", F.lit(2))
    asked, sets = "s % 4 = 0", rows.select("s").distinct()
    pairs = sets.filter(asked).select(F.col("s").alias("a")).crossJoin(sets.select(F.col("s").alias("b"))).filter("a != b")
    same = lambda x, y: x.count() == y.count() == 6 * 23 and x.exceptAll(y).isEmpty()
    for sketch in (similarity.MinHash(300), similarity.BBitMinHash(32, 4)):
        state = sketch.state(rows, "s", "i")
        assert same(sketch.search(state, asked, "s"), sketch.jaccard(state, pairs, "s"))
    odd = similarity.OddSketch(256)
    state = odd.state(rows, "s", "i")
    assert same(odd.search(state, asked, "s"), odd.difference(state, pairs, "s"))
    weighted = similarity.WeightedMinHash(256)
    state = working.written(weighted.state(rows, "s", "i", "w"), "weighted")
    sides = [rows.select(F.col("s").alias(x), "i", F.col("w").alias(f"w{x}")) for x in "ab"]
    common = sides[0].filter("a % 4 = 0").join(sides[1], "i").filter("a != b").groupBy("a", "b").agg(F.sum(F.least("wa", "wb")).alias("m"))
    got = weighted.search(state, asked, "s", rows.groupBy("s").agg(F.sum("w").alias("w")), common)
    assert same(got.select("a", "b", "jaccard"), weighted.jaccard(state, pairs, "s"))
    exact = {(r.a, r.b): r.exact for r in got.collect()}
    assert exact[0, 7] == 1.0 and exact[0, 1] == pytest.approx(9 / 11)
    prints = similarity.SimHash().fingerprint(similarity.SimHash().state(rows, "s", "i"))
    near = {(r.a, r.b) for r in similarity.SimHash().search(prints, asked, "s", most=0).collect()}
    assert {(0, 7), (0, 14), (0, 21)} <= near and all(a != b for a, b in near)


def test_differing_bits_with_the_sign():
    x, y = np.array([0, -1], np.int32), np.array([[-1, -(1 << 31), 0], [-1, 5, 0]], np.int32)
    assert similarity.differing_bits(x, y).tolist() == [32, 31, 32]
