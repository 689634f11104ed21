import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.functions import sizing
from quern.functions.params import MismatchError
from quern.operators import heavy
from quern.operators.cardinality import HyperLogLog, native_distinct
from quern.operators.frequency import AMS, CountMin, CountMinLog, CountMinLogSketch, CountSketch, merge
from quern.operators.quantiles import DDSketch, TDigest, cdf, compress, digest_cdf, digest_quantile, digest_stats, kll_merge, kll_quantile, kll_quantiles, kll_rank, kll_state, quantile
from quern.operators.sampling import Reservoir
from quern.operators.similarity import BBitMinHash, MinHash, OddSketch, SimHash, WeightedMinHash, banded, met
from quern.operators.windowed import ExponentialHistogram, sliding_counts
from quern.sources import state as states
from quern.sources import working


@pytest.mark.parametrize("n", [10, 1000, 100_000])
def test_hll_error(spark, n):
    h = HyperLogLog(12)
    (r,) = h.estimate(h.state(spark.range(n).union(spark.range(n // 2)), "id")).collect()
    assert abs(r.estimate - n) <= max(1, 4 * h.relative_error * n)


def test_hll_merge_partitions_and_arguments(spark):
    h = HyperLogLog(10)
    whole = h.state(spark.range(5000), "id")
    parts = h.merge(h.state(spark.range(3000), "id"), h.state(spark.range(2000, 5000), "id"))
    assert parts.exceptAll(whole).isEmpty() and whole.exceptAll(parts).isEmpty()
    assert h.estimate(h.state(spark.range(0), "id")).collect()[0].estimate == 0
    for p in (3, 17):
        with pytest.raises(ValueError):
            HyperLogLog(p)
    assert abs(native_distinct(spark.range(1000), "id").collect()[0].estimate - 1000) < 60


def zipf(spark):
    return spark.createDataFrame([(f"key_{r}", 1000 // r) for r in range(1, 200)], "k string, c long")


def test_count_min(spark):
    c, df = CountMin.sized(0.01, 0.01), zipf(spark)
    assert (c.width, c.depth) == (512, 5)
    state = merge(c.state(df, "k", "c"), c.state(df, "k", "c"))
    got = c.estimate(df, "k", state).join(df, "k").collect()
    assert all(r.estimate >= 2 * r.c for r in got) and sum(r.estimate == 2 * r.c for r in got) > 150
    assert c.estimate(spark.createDataFrame([("absent",)], "k string"), "k", c.state(df.limit(0), "k", "c")).collect()[0].estimate == 0
    for bad in ((0, 0.1), (0.1, 0), (1, 0.1)):
        with pytest.raises(ValueError):
            CountMin.sized(*bad)


def test_count_min_log(spark):
    for bits, count, room in ((4, 5, 3), (4, 100, 30), (8, 15, 2), (8, 500, 25)):
        c = CountMinLog.sized(bits=bits)
        state = c.state(spark.createDataFrame([("x", count)], "k string, c long"), "k", "c")
        assert abs(c.estimate(spark.createDataFrame([("x",)], "k string"), "k", state).collect()[0].estimate - count) <= room
        both = c.merge(state, state)
        assert abs(c.estimate(spark.createDataFrame([("x",)], "k string"), "k", both).collect()[0].estimate - 2 * count) <= 3 * room
    with pytest.raises(ValueError):
        CountMinLog.sized(bits=5)


def test_count_sketch_and_ams(spark):
    s = CountSketch.sized(0.01, 0.01)
    noise = [("item", 100), ("item", -40)] + [(f"noise_{i}", d) for i in range(300) for d in (50, -50)]
    state = s.state(spark.createDataFrame(noise, "k string, c long"), "k", "c")
    assert s.estimate(spark.createDataFrame([("item",)], "k string"), "k", state).collect()[0].estimate == 60
    a = AMS.sized(5, 64)
    assert a.estimate(a.state(spark.createDataFrame([("x", 10)], "k string, c long"), "k", "c")).collect()[0].f2 == 100
    got = a.estimate(a.state(spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, c long"), "k", "c")).collect()[0].f2
    assert abs(got - 38) <= 10
    assert a.estimate(merge(*[a.state(spark.createDataFrame([("x", c)], "k string, c long"), "k", "c") for c in (5, 10)])).collect()[0].f2 == 225
    with pytest.raises(ValueError):
        AMS.sized(0, 1)


def test_misra_gries(spark):
    counters, off, seen = heavy.MisraGries(3).update({}, iter([("A", 10), ("B", 10), ("C", 2)]))
    assert counters == {"A": 8, "B": 8} and (off, seen) == (2, 22)
    rng = random.Random(1)
    rows = [("hot",)] * 300 + [("warm",)] * 120 + [(f"x{rng.randrange(400)}",) for _ in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string").repartition(5)
    exact = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    for r in heavy.MisraGries(10).summary(df, "k").filter("item IS NOT NULL").collect():
        assert r["count"] <= exact[r.item] <= r["count"] + r.error
    assert {r.item: r["count"] for r in heavy.MisraGries(10).heavy_hitters(df, "k").collect()} == {k: c for k, c in exact.items() if c * 10 > len(rows)}
    with pytest.raises(ValueError):
        heavy.MisraGries(1)


def test_space_saving(spark):
    s = heavy.SpaceSavingSketch(3)
    for item, n in (("A", 100), ("B", 50), ("C", 10), ("D", 2), ("E", 1)):
        s.insert(item, n)
    assert s.top(2) == [("A", 100, 0), ("B", 50, 0)] and s.estimate("E") == 13 and s.errors["E"] == 12 and s.estimate("none") == 13
    df = spark.createDataFrame([(f"k{i}",) for i in range(40) for _ in range(i * i)], "k string").repartition(6)
    exact = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    for r in heavy.SpaceSaving(12).summary(df, "k").filter("item IS NOT NULL").collect():
        assert r["count"] - r.error <= exact[r.item] <= r["count"]
    assert [r.item for r in heavy.SpaceSaving(64).top(df, "k", 3).collect()] == ["k39", "k38", "k37"]


@pytest.mark.parametrize("k", [4, 12, 30])
def test_space_saving_top_is_exact_when_counters_are_few(spark, k):
    rng = random.Random(5)
    rows = [(f"k{i:03}",) for i in range(200) for _ in range(10 + i // 20)]  # nearly flat: nothing stands out
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string").repartition(5)
    s = heavy.SpaceSaving(k)
    exact = df.groupBy(F.col("k").alias("item")).count()
    assert [tuple(r) for r in s.top(df, "k", 10).collect()] == [tuple(r) for r in exact.orderBy(F.desc("count"), "item").limit(10).collect()]
    found = s.summary(df, "k").collect()
    held, bound = {r.item for r in found}, next(r.error for r in found if r.item is None)
    assert all(r["count"] <= bound for r in exact.collect() if r.item not in held)


def test_lossy_counting(spark):
    c = heavy.LossyCounter(0.1)
    for x in ["A"] * 9 + ["B"]:
        c.insert(x)
    assert c.held == {"A": (9, 0)}
    rows = [("heavy1",)] * 500 + [("heavy2",)] * 300 + [(f"light{i}",) for i in range(50)]
    df = spark.createDataFrame(rows, "k string").repartition(4)
    assert {r.item: r["count"] for r in heavy.LossyCounting(0.01).heavy_hitters(df, "k", 0.1).collect()} == {"heavy1": 500, "heavy2": 300}
    with pytest.raises(ValueError):
        heavy.LossyCounting(0.1).heavy_hitters(df, "k", 0.01)


def test_heavy_keeper(spark):
    h = heavy.HeavyKeeperSketch(4, 256, 3)
    for item, n in (("A", 10), ("B", 5), ("C", 3), ("D", 1), ("D", 5)):
        h.insert(item, n)
    assert sorted(h.top, key=h.top.get, reverse=True) == ["A", "D", "B"] and h.estimate("A") == 10
    df = spark.createDataFrame([(f"k{i}",) for i in range(30) for _ in range(2 * i)], "k string").repartition(3)
    assert {r.item for r in heavy.HeavyKeeper(4, 512, 10).top(df, "k", 3).collect()} == {"k29", "k28", "k27"}


def test_dd_sketch(spark):
    d, rng = DDSketch(0.01), random.Random(42)
    values = sorted([rng.uniform(1, 10_000) for _ in range(1000)] + [rng.uniform(-5000, -10) for _ in range(500)] + [0.0] * 20)
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "v double")
    for r in d.quantiles(d.state(df, "v"), [0, 0.1, 0.3, 0.5, 0.9, 1]).collect():
        want = values[max(0, math.ceil(r.q * len(values)) - 1)]
        assert abs(r.value - want) <= 0.0101 * abs(want)
    halves = d.merge(d.state(df.filter("v < 100"), "v"), d.state(df.filter("v >= 100"), "v"))
    assert halves.exceptAll(d.state(df, "v")).isEmpty()
    with pytest.raises(ValueError):
        DDSketch(0)


def test_t_digest(spark):
    rng = np.random.default_rng(42)
    x = rng.uniform(0, 100, 5000)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 5000, "v": x})).repartition(4)
    t = TDigest(100)
    state = t.state(df, "v", "g")
    r = state.select(quantile(0.5).alias("m"), quantile(0.99).alias("h"), quantile(0.0).alias("lo"), cdf(25.0).alias("c"), F.size("means").alias("n")).collect()[0]
    assert abs(r.m - 50) < 2 and abs(r.h - 99) < 2 and r.lo == x.min() and abs(r.c - 0.25) < 0.02 and r.n < 1000
    parts = t.merge(t.state(spark.range(1000).select(F.lit("a").alias("g"), F.col("id").alias("v")), "v", "g"), t.state(spark.range(1000, 2000).select(F.lit("a").alias("g"), F.col("id").alias("v")), "v", "g"), "g")
    assert abs(parts.select(quantile(0.5).alias("m")).collect()[0].m - 1000) < 20
    none = np.zeros(0)
    assert math.isnan(digest_quantile(none, none, 0, 0, 0.5)) and digest_cdf(np.array([5.0]), np.array([1.0]), 5, 5, 5) == 0.5
    assert compress(np.array([3.0, 1.0]), np.array([1.0, 1.0]), 100)[0].tolist() == [1.0, 3.0]
    with pytest.raises(ValueError):
        TDigest(0)


def test_kll(spark):
    got = {r.q: r.value for r in kll_quantiles(spark.range(10_000), "id", [0.1, 0.5, 0.9]).collect()}
    assert all(abs(v - q * 10_000) < 300 for q, v in got.items())


def test_kll_states_merge(spark):
    parts = kll_merge(kll_state(spark.range(5000), "id"), kll_state(spark.range(5000, 10_000), "id"))
    r = parts.select(kll_quantile(0.5).alias("m"), kll_rank(2500).alias("r")).collect()[0]
    assert abs(r.m - 5000) < 300 and abs(r.r - 0.25) < 0.03
    with pytest.raises(ValueError):
        kll_state(spark.range(1), "id", k=4)


def overlap(spark, *ranges):
    return spark.createDataFrame([(s, f"item_{i}") for s, r in enumerate(ranges) for i in r], "s long, item string")


def pairs(spark, *ab):
    return spark.createDataFrame(list(ab), "a long, b long")


def test_minhash_kinds(spark):
    df, ab = overlap(spark, range(100), range(50, 150), range(200, 300)), pairs(spark, (0, 1), (0, 2))
    for sketch, room in ((MinHash(256), 0.12), (BBitMinHash(256, 4), 0.13)):
        got = {r.b: r.jaccard for r in sketch.jaccard(sketch.state(df, "s", "item"), ab, "s").collect()}
        assert abs(got[1] - 1 / 3) <= room and got[2] <= 0.1
    m = MinHash(16)
    both = m.merge(m.state(df.filter("item < 'item_3'"), "s", "item"), m.state(df.filter("item >= 'item_3'"), "s", "item"))
    assert both.exceptAll(m.state(df, "s", "item")).isEmpty()
    with pytest.raises(ValueError):
        BBitMinHash(8, 9)


def test_weighted_minhash(spark):
    df = spark.createDataFrame([(0, "item_0", 3.0), (0, "item_1", 1.0), (1, "item_0", 1.0), (1, "item_1", 2.0), (1, "no", 0.0)], "s long, item string, w double")
    m = WeightedMinHash(1000)
    got = m.jaccard(m.state(df, "s", "item", "w"), pairs(spark, (0, 1)), "s").collect()[0].jaccard
    assert abs(got - 0.4) <= 0.08


def test_odd_sketch(spark):
    df, o = overlap(spark, range(100), range(50, 150)), OddSketch.sized(4096)
    state = o.state(df, "s", "item")
    assert abs(o.difference(state, pairs(spark, (0, 1)), "s").collect()[0].estimate - 100) <= 10
    assert all(abs(r.estimate - 100) <= 10 for r in o.cardinality(state, "s").collect())
    assert o.merge(state, state).filter("value != 0").isEmpty()


def test_simhash(spark):
    df = spark.createDataFrame([(0, "feature1", 5), (0, "feature2", 1), (1, "feature1", 2), (2, "x", 1)], "s long, f string, w long")
    h = SimHash()
    state = h.state(df, "s", "f", "w")
    prints = {r.s: r.fingerprint for r in h.fingerprint(state).collect()}
    assert prints[0] == prints[1] != prints[2]
    assert h.fingerprint(h.merge(state, state, "s")).exceptAll(h.fingerprint(state)).isEmpty()


@pytest.mark.parametrize("name", ["minhash_jaccard", "bbit_minhash_jaccard", "weighted_minhash_jaccard", "odd_symmetric_difference", "simhash_similarity"])
def test_supplier_queries_compare_every_stated_query_with_all(spark, name):
    from quern.plans import catalog

    sf = "/root/testdata/sf0.01"
    ids = [r[0] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey").distinct().collect()]
    got = [(r.a, r.b) for r in catalog.QUERIES[name](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in ids if a % 20 == 0 for b in ids if a != b} and got


def test_pair_functions_equal_plain_counts(spark):
    df = overlap(spark, range(100), range(50, 150), range(200, 300), range(90, 210)).withColumn("w", F.col("s") + 1)
    ab = pairs(spark, *[(a, b) for a in range(4) for b in range(a + 1, 4)])

    def shares(state, k, *values):
        held = {}
        for r in state.collect():
            held.setdefault(r.s, {})[r.slot] = tuple(r[v] for v in values)
        return {(a, b): sum(held[a][i] == held[b][i] for i in range(k)) / k for a in range(4) for b in range(a + 1, 4)}

    m = MinHash(64)
    state = m.state(df, "s", "item")
    assert {(r.a, r.b): r.jaccard for r in m.jaccard(state, ab, "s").collect()} == shares(state, 64, "value")
    w = WeightedMinHash(64)
    state = w.state(df, "s", "item", "w")
    assert state.count() == 4 * 64 and {(r.a, r.b): r.jaccard for r in w.jaccard(state, ab, "s").collect()} == shares(state, 64, "item", "t")
    halves = w.merge(w.state(df.filter("hash(item) % 2 = 0"), "s", "item", "w"), w.state(df.filter("hash(item) % 2 != 0"), "s", "item", "w"), "s")
    assert halves.exceptAll(state).isEmpty() and state.exceptAll(halves).isEmpty()
    o = OddSketch(256)
    state = o.state(df, "s", "item")
    words = {(r.s, r.word): r.value for r in state.collect()}
    odd = {(a, b): sum((words.get((a, i), 0) ^ words.get((b, i), 0)).bit_count() for i in range(8)) for a in range(4) for b in range(a + 1, 4)}
    assert {(r.a, r.b): r.odd for r in o.difference(state, ab, "s").collect()} == odd


def test_bands_find_equal_slots_and_near_fingerprints(spark):
    df = overlap(spark, range(100), range(2, 100), range(200, 300))
    m = MinHash(64)
    buckets = banded(m.state(df, "s", "item"), "s", 4)
    assert {(r.a, r.b) for r in met(buckets.filter("s = 0"), buckets, "s").collect()} == {(0, 1)}
    prints = spark.createDataFrame([(0, 0), (1, 0b1011), (2, (1 << 60) - 1)], "s long, fingerprint long")
    bands = SimHash().bands(prints, "s", 4)
    assert {(r.a, r.b) for r in met(bands.filter("s = 0"), bands, "s").collect()} == {(0, 1)}


def test_packed_b_bit_signatures(spark):
    b = BBitMinHash(10, 3)
    state = b.state(overlap(spark, range(30)), "s", "item")
    values = [r.value for r in state.orderBy("slot").collect()]
    assert int.from_bytes(b.packed(state, "s").first().packed, "little") == sum(v << 3 * i for i, v in enumerate(values))


def test_merges_of_different_sketches_are_refused(spark):
    df = overlap(spark, range(20))
    x = df.withColumn("v", F.col("s") + 1.0)
    for a, b, how in (
        (HyperLogLog(10).state(df, "item"), HyperLogLog(12).state(df, "item"), HyperLogLog(10).merge),
        (DDSketch(0.01).state(x, "v"), DDSketch(0.02).state(x, "v"), DDSketch(0.01).merge),
        (CountMin(64, 3).state(df, "item"), CountMin(128, 3).state(df, "item"), merge),
        (MinHash(8).state(df, "s", "item"), MinHash(16).state(df, "s", "item"), MinHash(8).merge),
        (OddSketch(64).state(df, "s", "item"), OddSketch(128).state(df, "s", "item"), OddSketch(64).merge),
        (TDigest(50).state(x, "v", "s"), TDigest(100).state(x, "v", "s"), lambda p, q: TDigest(50).merge(p, q, "s")),
    ):
        with pytest.raises(MismatchError):
            how(a, b)
        how(a, a).count()


def test_a_saved_state_keeps_its_parameters(spark):
    df, path = overlap(spark, range(20)), working.path(spark, "state")
    states.save(HyperLogLog(10).state(df, "item"), path, "hll", {"precision": 10})
    back = states.load(spark, path, "hll", {"precision": 10})
    with pytest.raises(MismatchError):
        HyperLogLog(12).merge(back, HyperLogLog(12).state(df, "item"))
    assert HyperLogLog(10).merge(back, HyperLogLog(10).state(df, "item")).count() == back.count()


def test_space_saving_heap_takes_a_least_counter():
    random.seed(4)
    s, plain = heavy.SpaceSavingSketch(5), {}
    for _ in range(3000):
        item = f"k{min(random.randrange(30), random.randrange(30))}"
        if item in plain or len(plain) < 5:
            plain[item] = plain.get(item, 0) + 1
        else:
            low = min(plain.values())
            s_low = {i for i, c in plain.items() if c == low}
            s.insert(item)
            (gone,) = set(plain) - set(s.counts)
            assert gone in s_low
            del plain[gone]
            plain[item] = low + 1
            assert s.counts == plain
            continue
        s.insert(item)
    assert s.counts == plain and s.least == min(plain.values()) == s.estimate("new") == s.error("new")
    assert [c for _, c, _ in s.entries()] == sorted(plain.values())


def test_lossy_counting_by_windows_equals_one_by_one():
    random.seed(6)
    items = [f"k{int(random.expovariate(0.2))}" for _ in range(997)]
    a, b = heavy.LossyCounter(0.03), heavy.LossyCounter(0.03)
    for i in items:
        a.insert(i)
    for k in range(0, len(items), 101):
        b.insert_all(items[k : k + 101])
    assert a.held == b.held and a.seen == b.seen and b.error("none") == 997 // b.window


def test_summaries_bound_the_truth(spark):
    random.seed(8)
    rows = [f"k{min(random.randrange(40), random.randrange(40))}" for _ in range(2000)]
    df, exact = spark.createDataFrame([(r,) for r in rows], "item string").repartition(3), Counter(rows)
    asked = spark.createDataFrame([(f"k{i}",) for i in range(45)], "item string")
    mg = heavy.MisraGries(12)
    for r in mg.estimates(mg.summary(df, "item"), asked).collect():
        assert r.estimate <= exact[r.item] <= r.most
    ss = heavy.SpaceSaving(12)
    summary = ss.summary(df, "item")
    for r in ss.estimates(summary, asked).collect():
        assert r.estimate - r.error <= exact[r.item] <= r.estimate
    lc = heavy.LossyCounting(0.02)
    for r in lc.estimates(lc.merge(lc.summary(df, "item"), lc.summary(df, "item")), asked).collect():
        assert r.estimate <= 2 * exact[r.item] <= r.estimate + r.error
    assert [r.item for r in heavy.top(mg.summary(df, "item"), 1).collect()] and heavy.entries(summary).count() == 12
    hk = heavy.HeavyKeeper(4, 64, 20)
    both = hk.merge(hk.state(df, "item"), hk.state(df, "item"))
    found = {r.item: r["count"] for r in hk.entries(both).collect()}
    top = [i for i, _ in exact.most_common(3)]
    assert all(exact[i] <= found[i] <= 2.2 * exact[i] for i in top)


def test_heavy_keeper_takes_an_emptied_cell_over():
    h = heavy.HeavyKeeperSketch(1, 1, 2)
    h.insert("a")
    h.insert("b", 200)
    assert h.prints[0, 0] == h._cells("b")[0] and h.counts[0, 0] > 150


def test_histogram_by_arrays_equals_one_by_one():
    random.seed(9)
    bits = [random.random() < p for p in (0.9, 0.05, 0.5) for _ in range(700)]
    a, b = ExponentialHistogram(300, 0.1), ExponentialHistogram(300, 0.1)
    for k in range(0, len(bits), 123):
        for x in bits[k : k + 123]:
            a.update(x)
        b.update_all(np.array(bits[k : k + 123]))
        assert (a.sizes, a.ticks, a.clock) == (b.sizes, b.ticks, b.clock)
        for n in (1, 50, 299, 300):
            true = sum(bits[max(0, min(k + 123, len(bits)) - n) : k + 123])
            assert abs(b.estimate(n) - true) <= 1 + 0.1 * true
    c = ExponentialHistogram(300, 0.1, b.clock, b.sizes, b.ticks)
    assert (c.sizes, c.ticks) == (b.sizes, b.ticks)


def test_sliding_counts_for_several_lengths(spark):
    df = spark.createDataFrame([(k, i, (i * (k + 3)) % 7 < 3) for k in range(5) for i in range(400)], "k long, i long, b boolean")
    got = {(r.k, r.n): r.estimate for r in sliding_counts(df, "k", "b", ["i"], 200, 0.1, last=[10, 100, 200]).collect()}
    for k in range(5):
        for n in (10, 100, 200):
            true = sum((i * (k + 3)) % 7 < 3 for i in range(400 - n, 400))
            assert abs(got[k, n] - true) <= max(1, 0.1 * true)
    with pytest.raises(ValueError):
        sliding_counts(df, "k", "b", ["i"], 200, 0.1, last=[201])


def test_tdigest_with_no_group_and_several(spark):
    df = spark.createDataFrame([(i % 3, None if i % 2 else "x", float(i)) for i in range(6000)], "a long, b string, v double").repartition(3)
    t = TDigest(100)
    assert abs(t.state(df, "v").select(quantile(0.5).alias("q")).first().q - 3000) <= 60
    groups = t.state(df, "v", ["a", "b"])
    assert groups.count() == 6 and {r.weight for r in digest_stats(groups).collect()} == {1000.0}
    assert all(r.centroids < 600 for r in digest_stats(groups).collect())


def test_count_min_log_item_by_item():
    spec = CountMinLog.sized(0.01, 0.01, 4)
    s = CountMinLogSketch(spec, 1)
    for _ in range(300):
        s.insert("often")
    s.insert("once")
    assert 100 <= s.estimate("often") <= 900 and s.estimate("once") == 1 and s.estimate("never") == 0
    data = s.packed()
    assert len(data) == -(-spec.width * spec.depth // 2) and CountMinLogSketch.unpacked(spec, data).estimate("often") == s.estimate("often")
    with pytest.raises(ValueError):
        CountMinLogSketch.unpacked(spec, data[:-1])


def test_reservoir(spark):
    r = Reservoir(10, 3)
    hits = sum(Reservoir(10, seed).sample(spark.range(100), "id").filter("id < 50").count() for seed in range(30))
    assert 90 <= hits <= 210
    merged = r.merge(r.sample(spark.range(50), "id"), r.sample(spark.range(50, 100), "id"), "id")
    assert merged.exceptAll(r.sample(spark.range(100), "id")).isEmpty() and merged.count() == 10
    with pytest.raises(ValueError):
        Reservoir(0)


def test_exponential_histogram(spark):
    e = ExponentialHistogram(100, 0.1)
    for _ in range(50):
        e.update(True)
    assert e.estimate(100) == 50
    bits = [i % 3 == 0 or i % 7 == 0 for i in range(1000)]
    e = ExponentialHistogram(1000, 0.05)
    for b in bits:
        e.update(b)
    for n in (100, 200, 500, 1000):
        assert abs(e.estimate(n) - sum(bits[-n:])) <= max(1, 0.1 * sum(bits[-n:]))
    with pytest.raises(ValueError):
        e.estimate(1001)
    df = spark.range(200).select((F.col("id") % 4).alias("k"), "id", (F.col("id") % 8 < 4).alias("b"))
    assert {(r.k, r.ticks, r.estimate) for r in sliding_counts(df.repartition(5), "k", "b", ["id"], 50, 0.1).collect()} == {(k, 50, 25) for k in range(4)}


def test_sizing(capsys):
    b = sizing.bloom_params(10_000, 0.01)
    assert (b.m, b.k, b.memory_bytes) == (131_072, 9, 16_384)
    assert sizing.hll_params(0.01).precision == 14 and sizing.cms_params(0.01, 0.01).width == 512
    assert sizing.recommend(10_000, 0.05, 9_000).structure == "BloomFilter"
    assert sizing.recommend(10_000, 0.01, 20_000).structure == "RibbonFilter"
    for name in sizing.STRUCTURES:
        assert sizing.main(["--structure", name, "--n", "10000", "--memory", "100000"]) == 0
    assert '"structure": "dd_sketch"' in capsys.readouterr().out
    assert sizing.main(["--structure", "bloom"]) == 1


def test_states_are_checked_on_load(spark, tmp_path):
    h, path = HyperLogLog(10), str(tmp_path / "state")
    state = h.state(spark.range(100), "id")
    states.save(state, path, "hll", {"precision": 10})
    assert states.load(spark, path, "hll", {"precision": 10}).exceptAll(state).isEmpty()
    for kind, params in (("bloom", None), ("hll", {"precision": 12})):
        with pytest.raises(states.StateError):
            states.load(spark, path, kind, params)


def test_protocols():
    from quern.functions.protocols import MergeableSketch, Sketch

    assert all(isinstance(x, MergeableSketch) for x in (HyperLogLog(), DDSketch(), MinHash(), OddSketch(), SimHash(), TDigest(), WeightedMinHash()))
    assert all(isinstance(x, Sketch) for x in (CountMin(64, 2), CountSketch(64, 2), AMS(2, 64)))


def test_histogram_keeps_its_error_at_every_bucket():
    h = ExponentialHistogram(50, 0.1)
    h.update_all(np.ones(50, bool))
    assert all(abs(h.estimate(n) - n) <= max(1, 0.1 * n) for n in range(1, 51))
    few = ExponentialHistogram(50, 0.1)
    few.update_all(np.ones(35, bool))  # a bucket of four with fifteen newer ones was wrong by two of nineteen
    assert all(abs(few.estimate(n) - n) <= max(1, 0.1 * n) for n in range(1, 36))


def test_heavy_keeper_with_empty_partitions_and_many_items(spark):
    few = spark.createDataFrame([(i % 3,) for i in range(10)], "k long").repartition(8)
    assert {(r.item, r["count"]) for r in heavy.HeavyKeeper(4, 64, 5).candidates(few, "k").collect()} == {("0", 4), ("1", 3), ("2", 3)}
    # Many nearly equal items: those with most rows are found only in a sketch that is sized for them.
    many = spark.range(6000).select("id", F.explode(F.sequence(F.lit(1), F.when(F.col("id") % 600 == 0, 40).otherwise(20)))).select("id").repartition(6)
    sketch = heavy.HeavyKeeper.sized(6000, 100)
    assert sketch.width >= 6000
    assert {str(i) for i in range(0, 6000, 600)} <= {r.item for r in sketch.candidates(many, "id").collect()}


def test_count_min_log_is_sized_for_its_keys():
    assert CountMinLog.for_keys(1500, 4).width == 2048 and CountMinLog.for_keys(90_000, 8).width >= 90_000
