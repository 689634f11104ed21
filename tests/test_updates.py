"""Quotient filters with slots, cuckoo filters that are updated, learned filters, KLL compactors, stream-order counts, histograms of ranges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.params import MismatchError
from quern.operators import heavy, quotient, windowed
from quern.operators.cuckoo import CuckooTree, IncrementalCuckoo
from quern.operators.frequency import CountMinLog
from quern.operators.kll import KLL, Compactors
from quern.operators.learned import LearnedBloom
from quern.operators.membership import Bloom
from quern.operators.quotient import FullError, QuotientFilter, Slots
from quern.operators.static_filters import BinaryFuse, FormatError, Sharded, Xor
from quern.sources import state as states
from quern.sources import working


def keys(spark, lo, hi, prefix="member_"):
    return spark.range(lo, hi).select(F.concat(F.lit(prefix), "id").alias("k"))


def passed(df):
    return df.filter("maybe").count()


# Quotient filter.


@pytest.mark.parametrize("seed", range(40))
def test_slots_give_back_what_they_hold(seed):
    rng = np.random.default_rng(seed)
    q, r = int(rng.integers(3, 9)), int(rng.integers(2, 9))
    most = 1 << (q + r)
    low = most * 7 // 8 if seed % 3 == 0 else 0  # all homes near the end, so runs go round it
    f = np.unique(rng.integers(low, most, int(rng.integers(0, int(0.95 * (1 << q)) + 1))).astype(np.uint64))
    s = Slots.of(f, q, r)
    assert s.fingerprints().tolist() == f.tolist() and s.n == len(f)
    held = set(f.tolist())
    assert all(s.holds(x) == (x in held) for x in [*rng.integers(0, most, 60).tolist(), *f.tolist()])
    assert Slots.read(s.state()).fingerprints().tolist() == f.tolist()
    assert s.doubled().fingerprints().tolist() == f.tolist() and s.doubled().q == q + 1
    # Bits: every occupied quotient has one run, and runs begin with a slot that does not continue.
    assert int(s.occupied.sum()) == int((s.used & ~s.continuation).sum()) == len(set((f >> np.uint64(r)).tolist()))


def test_slots_that_are_too_few():
    with pytest.raises(FullError):
        Slots.of(np.arange(8, dtype=np.uint64), 3, 4)
    with pytest.raises(FullError):
        Slots.of(np.arange(3, dtype=np.uint64), 3, 1).doubled()
    for bad in ({"q": 2}, {"q": 30}, {"q": 20, "r": 25}, {"q": 5, "shards": 0}):
        with pytest.raises(ValueError):
            QuotientFilter(**bad)
    with pytest.raises(ValueError):
        QuotientFilter.sized(0)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_quotient_filter_updates_and_sets(spark, monkeypatch, sent):
    monkeypatch.setattr(quotient, "SENT_BYTES", sent)
    f = QuotientFilter.sized(4000, 2.0**-13, shard_keys=700)
    assert f.shards == 6
    a, b = keys(spark, 0, 2500), keys(spark, 1500, 4000)
    x, y = f.state(a.unionByName(a), "k"), f.state(b, "k")
    assert passed(f.maybe(a, "k", x)) == 2500 and passed(f.maybe(keys(spark, 0, 9000, "other_"), "k", x)) < 30
    assert f.maybe(spark.createDataFrame([(None,)], "k string"), "k", x).first().maybe is False
    union, both = f.union(x, y), f.intersection(x, y)
    assert passed(f.maybe(keys(spark, 0, 4000), "k", union)) == 4000 and passed(f.maybe(keys(spark, 1500, 2500), "k", both)) == 1000
    assert abs(both.agg(F.sum("n")).first()[0] - 1000) < 5
    assert f.pairs(f.insert(x, b, "k")).exceptAll(f.pairs(union)).isEmpty()
    rest = f.remove(union, a, "k")
    assert passed(f.maybe(keys(spark, 2500, 4000), "k", rest)) > 1490 and passed(f.maybe(a, "k", rest)) == 0
    again = f.insert(rest, a, "k")
    assert f.pairs(again).exceptAll(f.pairs(union)).isEmpty() and f.pairs(union).exceptAll(f.pairs(again)).isEmpty()
    with pytest.raises(MismatchError):
        f.union(x, QuotientFilter.sized(9000).state(b, "k"))
    assert f.state(keys(spark, 0, 0), "k").count() == 0 and passed(f.maybe(a, "k", f.state(keys(spark, 0, 0), "k"))) == 0


def test_a_full_table_refuses_and_one_that_grows_does_not(spark):
    few = QuotientFilter(6, 20)
    state = few.insert(few.state(keys(spark, 0, 40), "k"), keys(spark, 0, 200), "k")
    row = few.stats(state).first()
    assert (row.n, row.refused, row.slots) == (60, 140, 64) and passed(few.maybe(keys(spark, 0, 40), "k", state)) == 40
    more = QuotientFilter(6, 20, grows=True)
    grown = more.insert(more.state(keys(spark, 0, 40), "k"), keys(spark, 0, 200), "k")
    row = more.stats(grown).first()
    assert (row.n, row.refused, row.slots) == (200, 0, 256) and passed(more.maybe(keys(spark, 0, 200), "k", grown)) == 200


def test_quotient_states_saved_and_loaded(spark):
    f = QuotientFilter.sized(300, shard_keys=100)
    state, where = f.state(keys(spark, 0, 300), "k"), working.path(spark, "quotient")
    states.save(state, where, "quotient", {"spec": repr(f)})
    back = states.load(spark, where, "quotient", {"spec": repr(f)})
    assert passed(f.maybe(keys(spark, 0, 300), "k", f.insert(back, keys(spark, 0, 10), "k"))) == 300
    with pytest.raises(FormatError):
        QuotientFilter.sized(301, shard_keys=100)._read(bytes(back.first().blob))


# Cuckoo filter.


def test_a_split_keeps_all_answers():
    rng = np.random.default_rng(2)
    held, probes = (rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (2000, 20_000))
    tree = CuckooTree(64, 8)
    tree.insert_all(held)
    assert tree.depth > 1 and tree.contains_all(held).all()
    back = CuckooTree.read(tree.state())
    assert (back.contains_all(probes) == tree.contains_all(probes)).all()
    assert back.remove_all(held[:1200]) == 1200 and back.contains_all(held[1200:]).all()
    for depth in (0, tree.depth):  # from the start with what is left, in few tables or in many
        other = CuckooTree(64, 8, depth)
        other.insert_all(held[1200:])
        assert (other.contains_all(probes) == back.contains_all(probes)).all()


def test_cuckoo_batches(spark):
    f = IncrementalCuckoo.sized(500, shard_keys=200)
    state = f.empty(keys(spark, 0, 1))
    assert passed(f.maybe(keys(spark, 0, 10), "k", state)) == 0
    state = f.insert(state, keys(spark, 0, 3000), "k")
    row = f.stats(state).first()
    assert row.n == 3000 and row.deepest > 0 and passed(f.maybe(keys(spark, 0, 3000), "k", state)) == 3000
    state = f.remove(state, keys(spark, 0, 1000), "k")
    state = f.update(state, keys(spark, 0, 500), keys(spark, 2900, 3000), "k")
    assert f.stats(state).select("n", "inserted", "removed", "missing").first() == (2400, 3500, 1100, 0)
    assert passed(f.maybe(keys(spark, 0, 500), "k", state)) == 500 and passed(f.maybe(keys(spark, 1000, 2900), "k", state)) == 1900
    once = f.insert(f.empty(state), keys(spark, 0, 500).unionByName(keys(spark, 1000, 2900)), "k")
    probes = keys(spark, 0, 4000)
    assert f.maybe(probes, "k", state).exceptAll(f.maybe(probes, "k", once)).isEmpty()


def test_cuckoo_of_what_is_not_there(spark, monkeypatch):
    f = IncrementalCuckoo.sized(100)
    state = f.remove(f.insert(f.empty(keys(spark, 0, 1)), keys(spark, 0, 100), "k"), keys(spark, 0, 5, "never_"), "k")
    row = f.stats(state).first()
    assert row.missing + row.removed == 5 and row.n == 100 - row.removed
    twice = f.insert(f.insert(f.empty(state), keys(spark, 0, 50), "k"), keys(spark, 0, 50), "k")
    once = f.remove(twice, keys(spark, 0, 50), "k")
    assert passed(f.maybe(keys(spark, 0, 50), "k", once)) == 50 and f.stats(f.remove(once, keys(spark, 0, 50), "k")).first().n == 0
    array = {r.k: r.maybe for r in f.maybe(keys(spark, 0, 300), "k", state).collect()}
    monkeypatch.setattr("quern.operators.cuckoo.SENT_BYTES", 0)
    assert {r.k: r.maybe for r in f.maybe(keys(spark, 0, 300), "k", state).collect()} == array
    with pytest.raises(MismatchError):
        IncrementalCuckoo.sized(101).insert(state, keys(spark, 0, 1), "k")


# Learned filter.


def test_learned_filter_misses_no_member(spark):
    df = spark.range(4000).select("id", (F.rand(3) * 4).alias("x"), (F.rand(4) * 9).alias("y"), F.when(F.col("id") % 3 == 0, None).otherwise(1.0).alias("z"))
    rows = df.withColumn("member", F.col("x") + F.randn(5) * 0.2 > 2).cache()
    members, strangers, features = rows.filter("member"), rows.filter("NOT member"), [F.col("x"), F.col("y"), F.col("z")]
    learned = LearnedBloom.fit(members, strangers, "id", features, 0.04, sample=800)
    told = learned.maybe(rows, "id", features, learned.state(members, "id", features))
    assert told.filter("member AND NOT maybe").count() == 0
    assert told.filter("NOT member AND maybe").count() <= 2 * 0.04 * strangers.count()
    assert 0 < learned.misses < 0.5 * learned.members and learned.bits_per_key < Bloom.sized(learned.members, 0.04).m / learned.members
    rows.unpersist()


@pytest.mark.parametrize("members,strangers", [(200, 0), (0, 200), (0, 0), (150, 150)])
def test_learned_filter_without_anything_to_learn(spark, members, strangers):
    a, b = (spark.range(k, k + n).select("id", F.lit(1.0).alias("x")) for k, n in ((0, members), (1000, strangers)))
    learned = LearnedBloom.fit(a, b, "id", [F.col("x")], 0.05)
    bits = learned.state(a, "id", [F.col("x")])
    assert passed(learned.maybe(a, "id", [F.col("x")], bits)) == members == learned.members
    assert passed(learned.maybe(b, "id", [F.col("x")], bits)) <= 20
    with pytest.raises(ValueError):
        LearnedBloom.fit(a, b, "id", [])


# KLL.


@pytest.mark.parametrize("values", ["uniform", "sorted", "equal"])
def test_compactor_ranks_and_weights(values):
    rng = np.random.default_rng(1)
    x = {"uniform": rng.random(50_000), "sorted": np.arange(50_000.0), "equal": np.full(50_000, 3.0)}[values]
    s = Compactors(200, 5)
    for part in np.array_split(x, 37):
        s.insert(part)
    weights = np.concatenate([np.full(len(v), 1 << i) for i, v in enumerate(s.levels)])
    items = np.concatenate(s.levels)
    assert weights.sum() == s.n == 50_000 and (s.least, s.largest) == (x.min(), x.max()) and s.compactions > 0
    assert len(items) <= 3 * 200 + 2 * len(s.levels) and set(items) <= set(x.tolist())
    for q in (0.01, 0.1, 0.5, 0.9, 0.99):
        v = np.quantile(x, q)
        assert abs(weights[items <= v].sum() / s.n - (x <= v).mean()) <= KLL(200).error


def test_kll_states_merge(spark):
    df = spark.range(0, 20_000, 1, 7).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 100 == 7, None).otherwise(F.randn(2)).alias("v")).cache()
    sketch, qs = KLL(128, 3), [0.0, 0.05, 0.5, 0.95, 1.0]
    exact = {(r.g, q): v for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("p")).collect() for q, v in zip(qs, r.p)}
    parts = [sketch.state(df.filter(F.col("v") > 0), "v", ["g"]), sketch.state(df.filter(F.col("v") <= 0), "v", ["g"])]
    for state in (sketch.state(df, "v", ["g"]), sketch.merge(*parts, group=["g"])):
        stats = {r.g: r for r in sketch.stats(state, ["g"]).collect()}
        assert sum(r.n for r in stats.values()) == df.filter("v IS NOT NULL").count() and all(r.compactions > 0 and r["items"] < 600 for r in stats.values())
        got = {(r.g, r.q): r.value for r in sketch.quantiles(state, qs, ["g"]).collect()}
        assert all(got[g, q] == exact[g, q] for g in range(3) for q in (0.0, 1.0))
        ranks = {(r.g, r.value): r.rank for r in sketch.ranks(state, [exact[g, 0.5] for g in range(3)], ["g"]).collect()}
        assert all(abs(ranks[g, exact[g, 0.5]] - 0.5) <= sketch.error for g in range(3))
        assert all(abs(got[g, q] - exact[g, q]) < 0.25 for g in range(3) for q in (0.05, 0.5, 0.95))
    again = sketch.state(df, "v", ["g"])
    assert again.exceptAll(sketch.state(df, "v", ["g"])).isEmpty()  # coins are seeded
    with pytest.raises(MismatchError):
        sketch.merge(again, KLL(64).state(df, "v", ["g"]), ["g"])
    with pytest.raises(ValueError):
        KLL(7)
    small = sketch.state(spark.createDataFrame([(1.5,), (math.nan,), (None,), (2.5,)], "v double"), "v")
    assert [r.value for r in sketch.quantiles(small, [0.5, 1.0]).orderBy("q").collect()] == [1.5, 2.5]
    df.unpersist()


# Count-min-log in stream order.


@pytest.mark.parametrize("bits", [4, 8])
def test_conservative_counts_of_a_stream(spark, bits):
    weights = {f"k{i}": 1 + 3 * i for i in range(60)}
    rows = [(k,) for k, n in weights.items() for _ in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string").repartition(3).unionByName(spark.createDataFrame([(None,)], "k string"))
    sketch = CountMinLog(512, 4, 2.0 if bits == 4 else 1.082, (1 << bits) - 1)
    state = sketch.stream_state(df, "k", seed=1)
    got = {r.k: r.estimate for r in sketch.estimate(df, "k", state).collect()}
    assert got.keys() == weights.keys()
    assert sum(abs(got[k] - n) <= 4 * sketch.deviation * n + 3 for k, n in weights.items()) >= 57
    assert 0.6 <= sum(got.values()) / sum(weights.values()) <= 1.5
    assert state.exceptAll(sketch.stream_state(df, "k", seed=1)).isEmpty()
    summed = spark.createDataFrame(list(weights.items()), "k string, w long")
    by_weight = {r.k: r.estimate for r in sketch.estimate(summed, "k", sketch.stream_state(summed, "k", "w", seed=2)).collect()}
    assert 0.6 <= sum(by_weight.values()) / sum(weights.values()) <= 1.5


# Histograms of ranges.


def test_one_key_in_many_tasks_keeps_the_error(spark):
    random.seed(3)
    bits = [random.random() < p for p in (0.9, 0.05, 0.5) for _ in range(700)]
    df = spark.createDataFrame([("a", i, b) for i, b in enumerate(bits)] + [("b", i, True) for i in range(30)], "k string, i long, b boolean").repartition(5)
    lasts = [1, 7, 100, 500, 1500]
    for ranges in (1, 3, 11):
        state = windowed.histograms(df, "k", "b", ["i"], 1500, 0.1, ranges)
        assert state.filter("k = 'a'").count() >= min(ranges, 3) - (ranges > 1)
        got = {(r.k, r.n): (r.ticks, r.estimate) for r in windowed.estimates(state, "k", lasts).collect()}
        for n in lasts:
            exact = sum(bits[-n:])
            assert got["a", n][0] == 2100 and abs(got["a", n][1] - exact) <= max(1, 0.1 * exact)
        assert got["b", 7] == (30, 7) and got["b", 1500] == (30, 30)


def test_histograms_in_a_row(spark):
    bits = [i % 3 == 0 or i % 7 == 0 for i in range(1000)]
    parts = [spark.createDataFrame([("s", i, bits[i]) for i in range(a, b)], "k string, i long, b boolean") for a, b in ((0, 400), (400, 1000))]
    states_ = [windowed.histograms(p, "k", "b", ["i"], 1000, 0.05, 2) for p in parts]
    got = {r.n: r.estimate for r in windowed.estimates(windowed.followed(*states_), "k", [100, 200, 500, 1000]).collect()}
    for n, x in got.items():
        assert abs(x - sum(bits[-n:])) <= max(1, 0.05 * sum(bits[-n:]))
    with pytest.raises(MismatchError):
        windowed.followed(states_[0], windowed.histograms(parts[1], "k", "b", ["i"], 500, 0.05, 2))


# Evaluated once.


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("MapInPandas")


def test_summaries_are_evaluated_once(spark):
    where = working.path(spark, "events")
    spark.range(3000).select((F.col("id") % 50 * (F.col("id") % 7)).alias("u")).write.parquet(where)
    df = spark.read.parquet(where)
    for out in (heavy.MisraGries(30).heavy_hitters(df, "u"), heavy.LossyCounting(0.01).heavy_hitters(df, "u", 0.03)):
        files, maps = scans(out)
        assert files <= 2 and not maps
    seen = spark.sparkContext.accumulator(0)

    class Counted(Xor):
        def build(self, h):
            seen.add(1)
            return super().build(h)

    filter_ = Sharded(Counted(), 3)
    rest = filter_.semi_join(df, "u", df.filter("u % 2 = 0").distinct(), "u")
    assert rest.count() == df.filter("u % 2 = 0").count() and seen.value == 3
    assert Sharded(BinaryFuse()).stats(Sharded(BinaryFuse()).state(df, "u")).first().shards == 1


@pytest.mark.parametrize("shards", [1, 8])
def test_ranges_take_what_one_large_table_takes(spark, shards):
    n = 3000
    few = QuotientFilter(10 - shards.bit_length() + 1, 20, shards, ranges=True)
    state = few.insert(few.state(keys(spark, 0, n // 2), "k"), keys(spark, 0, n), "k")
    row = few.stats(state).agg(F.sum("n").alias("n"), F.sum("refused").alias("refused"), F.sum("slots").alias("slots")).first()
    assert (row.n, row.slots) == (int(0.95 * 1024), 1024) and row.refused > 0
    more = QuotientFilter(few.q, 20, shards, grows=True, ranges=True)
    assert more.stats(more.state(keys(spark, 0, n), "k")).agg(F.sum("n")).first()[0] == n
    with pytest.raises(ValueError):
        QuotientFilter(4, 4, 3, ranges=True)
    # 2^22 slots with remainders of 20 bits, as for nine million keys, were refused as parameters.
    assert QuotientFilter(18, 20, 1 << 6, ranges=True).shards == 64
