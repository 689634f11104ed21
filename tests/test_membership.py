import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.hashing import key_hash
from quern.functions.params import MismatchError
from quern.operators import membership as M
from quern.operators.static_filters import BinaryFuse, Cuckoo, CuckooFilter, FormatError, Ribbon, Sharded, Xor, dump, load


def keys(spark, lo, hi, prefix="member_"):
    return spark.range(lo, hi).select(F.concat(F.lit(prefix), "id").alias("k"))


def passed(df):
    return df.filter("maybe").count()


@pytest.mark.parametrize("policy", ["xxhash64", "md5_60"])
def test_bloom_finds_all_and_few_others(spark, policy):
    b = M.Bloom.sized(5000, 0.01, policy)
    bits = b.bits(keys(spark, 0, 5000), "k")
    assert passed(b.maybe(keys(spark, 0, 5000), "k", bits)) == 5000
    assert passed(b.maybe(keys(spark, 0, 20000, "other_"), "k", bits)) <= 2.5 * 0.01 * 20000


def test_bloom_join_probe_equals_array_probe(spark, monkeypatch):
    b = M.Bloom.sized(500, 0.05)
    bits, probes = b.bits(keys(spark, 0, 500), "k"), keys(spark, 300, 2000)
    array = {r.k: r.maybe for r in b.maybe(probes, "k", bits).collect()}
    monkeypatch.setattr(M, "SENT_BYTES", 0)
    assert {r.k: r.maybe for r in b.maybe(probes, "k", bits).collect()} == array


def test_bloom_sizes_and_errors():
    assert (M.Bloom.sized(200).m, M.Bloom.sized(200).k) == (2048, 7)
    for n, p in ((0, 0.1), (10, 0.0), (10, 1.0)):
        with pytest.raises(ValueError):
            M.Bloom.sized(n, p)
    with pytest.raises(ValueError):
        M.Bloom(64, 1).compatible(M.Bloom(128, 1))


def test_bloom_nulls_and_groups(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y")], "g string, k string")
    b = M.Bloom(256, 3)
    assert {r.g: r.bits_set for r in b.stats(b.bits(df, "k", ["g"]), ["g"]).collect()} == {"a": 3, "b": 3}
    assert [r.maybe for r in b.maybe(df.filter("k IS NULL"), "k", b.bits(df, "k")).collect()] == [False]


def test_union_is_one_filter_over_both(spark):
    b = M.Bloom.sized(1000)
    x, y = b.bits(keys(spark, 0, 400), "k"), b.bits(keys(spark, 300, 900), "k")
    assert M.union(x, y).exceptAll(b.bits(keys(spark, 0, 900), "k")).isEmpty()
    assert passed(b.maybe(keys(spark, 300, 400), "k", M.intersection(x, y))) == 100


def test_counting_removes_and_saturates(spark):
    b = M.Bloom.sized(1000)
    rows = keys(spark, 0, 500).withColumn("s", F.lit(1)).union(keys(spark, 0, 250).withColumn("s", F.lit(-1)))
    state = M.counting(b, rows, "k", sign=F.col("s"))
    assert passed(b.maybe(keys(spark, 250, 500), "k", state.select(F.col("pos").alias("bit")))) == 250
    assert passed(b.maybe(keys(spark, 0, 250), "k", state.select(F.col("pos").alias("bit")))) <= 25
    many = spark.range(300).select(F.lit("x").alias("k"), F.lit(1).alias("s"))
    full = M.counting(b, many.union(many.limit(10).withColumn("s", F.lit(-1))), "k", sign=F.col("s"))
    assert {r["count"] for r in full.collect()} == {255}
    assert {r["count"] for r in M.counting_merge(full, full).collect()} == {255}
    assert M.counting_union(state, full).count() >= state.count() and M.counting_intersection(state, full).count() <= 7


def test_scalable_stages(spark):
    s = M.Scalable(20, 0.01)
    assert [s.capacity(i) for i in range(3)] == [20, 40, 80] and s.stages(20) == 1 and s.stages(21) == 2 and s.stages(141) == 4
    state = s.bits(spark.range(100).select(F.col("id").alias("k"), "id"), "k", [F.col("id")])
    assert {r.stage for r in state.select("stage").distinct().collect()} == {0, 1, 2}
    found = 0
    for i, (lo, hi) in enumerate(((0, 20), (20, 60), (60, 100))):
        found += passed(s.filter(i).maybe(spark.range(lo, hi).select(F.col("id").alias("k")), "k", state.filter(F.col("stage") == i).select("bit")))
    assert passed(s.maybe(spark.range(100).select(F.col("id").alias("k")), "k", state, 3)) == 100
    assert s.combine(state, state).exceptAll(state).isEmpty() and 0 < s.fill_ratio(state).collect()[0][0] < 1
    with pytest.raises(ValueError):
        s.combine(state, state.filter("stage = 0"))
    assert found == 100 and 0 < s.expected_fpr(3) < 0.01


def test_numbered_is_a_global_order(spark):
    got = M.numbered(spark.range(1000).repartition(7), [F.desc("id")]).collect()
    assert all(r.n == 1000 - r.id for r in got)


def test_numbered_with_other_columns(spark):
    n = 3_000_000
    rows = spark.range(n).select(F.xxhash64("id").alias("k"), F.col("id").alias("other"), F.lit("x" * 20).alias("payload"))
    got = M.numbered(rows, [F.col("k")])
    assert got.columns == ["k", "other", "payload", "n"]
    r = got.agg(F.countDistinct("n").alias("d"), F.min("n").alias("a"), F.max("n").alias("b"), F.count(F.lit(1)).alias("c")).first()
    assert (r.d, r.a, r.b, r.c) == (n, 1, n, n)
    assert got.select("k", "n").filter("n <= 1000").agg(F.max("k")).first()[0] <= got.filter("n > 1000").agg(F.min("k")).first()[0]


def test_merges_of_different_filters_are_refused(spark):
    k = keys(spark, 0, 50)
    a, b = M.Bloom.sized(100), M.Bloom.sized(100_000)
    with pytest.raises(MismatchError):
        M.union(a.bits(k, "k"), b.bits(k, "k"))
    with pytest.raises(MismatchError):
        b.maybe(k, "k", a.bits(k, "k"))
    with pytest.raises(MismatchError):
        M.counting_merge(M.counting(a, k, "k"), M.counting(b, k, "k"))
    with pytest.raises(MismatchError):
        M.union(M.Quotient(8).state(k, "k"), M.Quotient(9).state(k, "k"))
    with pytest.raises(MismatchError):
        M.Blocked(4, 3).union(M.Blocked(4, 3).state(k, "k"), M.Blocked(8, 3).state(k, "k"))
    assert M.union(a.bits(k, "k"), a.bits(keys(spark, 50, 99), "k")).count() == a.bits(keys(spark, 0, 99), "k").count()


def test_counting_filter_tells_and_removes_what_it_holds(spark):
    b = M.Bloom.sized(1000)
    state = M.counting(b, keys(spark, 0, 100), "k")
    assert passed(M.counting_maybe(b, keys(spark, 0, 100), "k", state)) == 100
    rest, rows = M.counting_remove(b, state, keys(spark, 50, 150), "k")
    assert rows.filter("removed").count() in range(50, 54)
    assert passed(M.counting_maybe(b, keys(spark, 0, 50), "k", rest)) == 50 and passed(M.counting_maybe(b, keys(spark, 50, 100), "k", rest)) <= 2
    assert M.counting_stats(b, rest).first().used == rest.count()


def test_blocked(spark):
    b = M.Blocked.sized(1000)
    state = b.state(keys(spark, 0, 1000), "k")
    assert passed(b.maybe(keys(spark, 0, 1000), "k", state)) == 1000
    assert passed(b.maybe(keys(spark, 0, 5000, "other_"), "k", state)) <= 250


def test_quotient_deletes_in_a_dense_table(spark):
    q = M.Quotient.sized(1000)
    state = q.state(keys(spark, 0, 1000), "k")
    rest = q.remove(state, keys(spark, 0, 500), "k")
    assert q.maybe(keys(spark, 500, 1000), "k", rest).count() >= 498
    assert q.maybe(keys(spark, 0, 500), "k", rest).count() <= 2
    assert q.slots == 2048


def test_learned(spark):
    words = spark.createDataFrame([("apple_even",), ("banana_odd",), ("cherry_even",), ("orange_odd",)], "k string")
    b, even = M.Bloom.sized(10), F.col("k").contains("even")
    bits = M.learned_state(words, "k", even, b)
    assert b.bits(words.filter("k LIKE '%odd'"), "k").exceptAll(bits).isEmpty()
    assert passed(M.learned_maybe(words, "k", even, b, bits)) == 4


@pytest.mark.parametrize("f,rate", [(BinaryFuse(), 0.01), (Xor(), 0.01), (Xor(16), 0.001), (Ribbon(), 0.01), (Ribbon(16, 64), 0.001), (Ribbon(16, 128), 0.001), (CuckooFilter(), 0.1)])
def test_static_filters(f, rate):
    members, others = np.arange(0, 10_000, 2, dtype=np.uint64), np.arange(1, 20_000, 2, dtype=np.uint64)
    state = f.build(members)
    assert f.probe(state, members).all() and f.probe(state, others).mean() <= rate


@pytest.mark.parametrize("f", [BinaryFuse(), Xor(), Ribbon(), CuckooFilter()])
@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_tiny_static_filters(f, n):
    members = np.arange(n, dtype=np.uint64)
    state = f.build(np.concatenate([members, members]) if not isinstance(f, CuckooFilter) else members)
    assert state["n"] == n and f.probe(state, members).all()
    if not n:
        assert not f.probe(state, np.arange(9, dtype=np.uint64)).any()


@pytest.mark.parametrize("f", [BinaryFuse(), BinaryFuse(16), Xor(), Ribbon(), Ribbon(16, 128), CuckooFilter()])
def test_saved_filters_answer_alike_and_others_are_refused(f):
    members = np.arange(0, 6000, 2, dtype=np.uint64)
    data = dump(f, f.build(members))
    assert f.probe(load(f, data), members).all()
    for other in (Xor(16), Ribbon(8, 128), CuckooFilter(0.5)):
        with pytest.raises(FormatError):
            load(other, data)
    for broken in (b"", b"QSF1", data[:20], data[:-1], b"x" + data):
        with pytest.raises(FormatError):
            load(f, broken)


def test_cuckoo_counts_equal_keys_and_tells_when_it_is_full():
    c = Cuckoo(64)
    assert all(c.insert(7) for _ in range(8)) and not c.full
    assert not c.insert(7) and c.full and c.contains(7)
    assert [c.remove(7) for _ in range(10)] == [True] * 9 + [False] and not c.contains(7) and not c.full
    d, h = Cuckoo.sized(20_000), np.random.default_rng(2).integers(0, 2**63, 18_000).astype(np.uint64)
    d.insert_all(h[:9000])
    assert d.insert_all(h[9000:]) == 9000 and d.contains_all(h).all() and 0.4 < d.load < 1


def test_static_filter_arguments():
    for make in (lambda: Xor(7), lambda: Ribbon(8, 32), lambda: Ribbon(9), lambda: Cuckoo(3), lambda: Cuckoo(4, 9)):
        with pytest.raises(ValueError):
            make()


def test_cuckoo_overflow_keeps_all_keys_and_deletes():
    c = Cuckoo.sized(100)
    took = [c.insert(h) for h in range(200)]
    assert not all(took) and all(c.contains(h) for h in range(200)) and c.load > 0.9
    for h in range(0, 200, 2):
        assert c.remove(h)
    assert all(c.contains(h) for h in range(1, 200, 2)) and not c.remove(10**9) or c.contains(1)


def test_sharded_probe_paths_agree(spark, monkeypatch):
    import quern.operators.static_filters as S

    s = Sharded(Xor(), 3)
    state = s.state(keys(spark, 0, 300), "k").cache()
    assert state.count() == 3
    sent = {r.k: r.maybe for r in s.maybe(keys(spark, 200, 600), "k", state).collect()}
    monkeypatch.setattr(S, "SENT_BYTES", 0)
    assert {r.k: r.maybe for r in s.maybe(keys(spark, 200, 600), "k", state).collect()} == sent
    assert sum(sent.values()) >= 100
    assert s.semi_join(keys(spark, 0, 1000), "k", keys(spark, 500, 700), "k").count() == 200


def test_hash_policies(spark):
    df = spark.range(3).select(F.col("id").cast("int").alias("i"), "id")
    assert df.filter(key_hash("i") == key_hash("id")).count() == 3
    assert df.select(key_hash("id", lambda c: c * 2).alias("h")).collect()[1].h == 2
    with pytest.raises(ValueError):
        key_hash("id", "nothing")


def test_bit_vectors(spark):
    from quern.functions import bits

    a, b = (bits.packed(spark.createDataFrame([(x,) for x in xs], "p long"), "p") for xs in ((0, 63, 64, 200), (63, 64, 7)))
    at = lambda w: {r.position for r in bits.positions(w).collect()}
    assert at(a) == {0, 63, 64, 200} and at(bits.either(a, b)) == {0, 7, 63, 64, 200} and at(bits.both(a, b)) == {63, 64}
    assert bits.count(a).collect()[0].ones == 4
