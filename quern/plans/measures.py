"""Queries of cardinality, frequency, heavy hitter, quantile, similarity, sampling, window and sizing operators.

Docstrings: exact, verified or bounded, as in ``sets``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import sizing
from quern.functions.hashing import key_hash
from quern.operators import heavy, membership
from quern.operators.cardinality import HyperLogLog, native_distinct
from quern.operators.cuckoo import IncrementalCuckoo
from quern.operators.frequency import AMS, CountMin, CountMinLog, CountSketch
from quern.operators.frequency import merge as merge_counts
from quern.operators.kll import KLL
from quern.operators.quantiles import DDSketch, TDigest, cdf, kll_quantiles, kll_state, quantile
from quern.operators.quotient import QuotientFilter
from quern.operators.sampling import Reservoir
from quern.operators.similarity import PRIME, BBitMinHash, MinHash, OddSketch, SimHash, WeightedMinHash, banded, beside, coefficients, met
from quern.operators.static_filters import BinaryFuse, CuckooFilter, Ribbon, Sharded, Xor
from quern.operators.weighted_sets import weighted_search
from quern.operators.windowed import histograms, sliding_counts
from quern.plans.sets import ORDERS, P, sql_hash, sql_positions
from quern.sources import state as states
from quern.sources import working
from quern.sources.tables import table
from quern.streaming import sketches as S

HLL, CMS, CML = HyperLogLog(12, P), CountMin(512, 5, P), CountMinLog(2048, 5, policy=P)
COUNT_SKETCH, AMS_ = CountSketch(1024, 5, P), AMS(5, 256, P)
DD, DIGEST = DDSketch(0.01), TDigest(200)
PROBABILITIES = [0.01, 0.25, 0.5, 0.75, 0.95, 0.99]
MINHASH, BBIT, ODD, SIM = MinHash(64, P), BBitMinHash(64, 4, P), OddSketch(4096, P), SimHash(P)
RESERVOIR = Reservoir(20, 7, P)
WINDOW, EPSILON = 50, 0.1


def event_profile(spark: SparkSession, d: str) -> DataFrame:
    """Exact: of each event type distinct users (registers), quantiles (buckets) and the most frequent user."""
    events = table(spark, d, "events")
    users = HLL.estimate(HLL.state(events, "user_id", ["event_type"]), ["event_type"], "users")
    q = DD.quantiles(DD.state(events, "value", ["event_type"]), [0.5, 0.95, 0.99], ["event_type"])
    q = q.groupBy("event_type").agg(*[F.round(F.max(F.when(F.col("q") == p, F.col("value"))), 6).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    top = events.groupBy("event_type", "user_id").count().groupBy("event_type").agg(F.max_by("user_id", F.struct("count", -F.col("user_id"))).alias("top_user"))
    return users.join(q, "event_type").join(top, "event_type")


def hll_distinct_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Exact."""
    return HLL.estimate(HLL.state(table(spark, d, "events"), "user_id", ["event_type"]), ["event_type"])


def hll_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Exact: the states of single days are merged upwards, rows are read once."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    state = HLL.state(events, "user_id", ["event_type", "day"])
    up = state.rollup("event_type", "day", "reg").agg(F.max("rho").alias("rho")).filter("reg IS NOT NULL")
    up = up.unionByName(state.groupBy("event_type", "reg").agg(F.max("rho").alias("rho")).withColumn("day", F.lit(None).cast("string"))).unionByName(state.groupBy("reg").agg(F.max("rho").alias("rho")).withColumn("day", F.lit(None).cast("string")).withColumn("event_type", F.lit(None).cast("string")))
    return HLL.estimate(up, ["event_type", "day"])


def hll_merge(spark: SparkSession, d: str) -> DataFrame:
    """Exact: states of two halves merge to that of the whole."""
    lines = table(spark, d, "lineitem")
    halves = [HLL.state(lines.filter((F.col("l_linenumber") % 2) == i), "l_orderkey", ["l_returnflag"]) for i in (0, 1)]
    return HLL.estimate(HLL.merge(*halves), ["l_returnflag"])


def native_distinct_bound(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: within five standard errors of the exact count."""
    lines = table(spark, d, "lineitem")
    exact = lines.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("n"))
    error = 5 * 1.04 / math.sqrt(1 << 12)
    return native_distinct(lines, "l_orderkey", ["l_returnflag"]).join(exact, "l_returnflag").select("l_returnflag", "n", (F.abs(F.col("estimate") - F.col("n")) <= error * F.col("n") + 2).alias("within_bound"))


def cms_point_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Exact: weight is the quantity."""
    lines = table(spark, d, "lineitem")
    state = CMS.state(lines, "l_partkey", F.col("l_quantity"))
    return CMS.estimate(table(spark, d, "part"), "p_partkey", state)


def cms_never_under(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: states of two halves merge; no estimate is too low, and few are too high by more than e / width."""
    lines = table(spark, d, "lineitem")
    state = merge_counts(*[CMS.state(lines.filter((F.col("l_linenumber") % 2) == i), "l_partkey") for i in (0, 1)])
    exact = lines.groupBy("l_partkey").count()
    both = CMS.estimate(lines, "l_partkey", state).join(exact, "l_partkey").join(F.broadcast(lines.agg(F.count(F.lit(1)).alias("total"))))
    out = both.agg(F.count(F.lit(1)).alias("keys"), F.sum((F.col("estimate") < F.col("count")).cast("long")).alias("too_low"), F.sum((F.col("estimate") > F.col("count") + F.col("total") * math.e / CMS.width).cast("long")).alias("_high"))
    return out.select("keys", "too_low", (F.col("_high") <= F.greatest(F.lit(5.0), 3 * math.exp(-CMS.depth) * F.col("keys"))).alias("within_bound"))


def cml_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Exact: levels of known counts."""
    events = table(spark, d, "events")
    return CML.estimate(events, "user_id", CML.state(events, "user_id"))


def count_sketch_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Exact: +1 for finished, -1 for other orders."""
    orders = table(spark, d, "orders")
    state = COUNT_SKETCH.state(orders, "o_custkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1))
    return COUNT_SKETCH.estimate(orders, "o_custkey", state)


def ams_f2(spark: SparkSession, d: str) -> DataFrame:
    """Exact: rows of the sketch, and their median."""
    state = AMS_.state(table(spark, d, "orders"), "o_custkey")
    rows = AMS_.by_row(state).select(F.col("row").cast("string").alias("row"), F.col("f2").cast("double").alias("f2"))
    return rows.unionByName(AMS_.estimate(state).select(F.lit("median").alias("row"), F.col("f2").cast("double").alias("f2")))


def mg_heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    """Verified: every user with more than one in 125 events."""
    return heavy.MisraGries(125).heavy_hitters(table(spark, d, "events"), "user_id")


def lossy_heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    """Verified: every user with at least 0.8 % of the events."""
    return heavy.LossyCounting(0.002).heavy_hitters(table(spark, d, "events"), "user_id", 0.008)


def space_saving_topk(spark: SparkSession, d: str) -> DataFrame:
    """Verified: candidates counted exactly; all users are, where the summary may have lost one of the top ten."""
    return heavy.SpaceSaving(100).top(table(spark, d, "events"), "user_id", 10)


def space_saving_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: with 64 counters every count lies between the bounds that the summary gives."""
    lines = table(spark, d, "lineitem")
    found = heavy.SpaceSaving(64).summary(lines, "l_suppkey").filter("item IS NOT NULL")
    exact = lines.groupBy(F.col("l_suppkey").cast("string").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    both = found.join(exact, "item", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.agg(F.count(F.lit(1)).alias("counters"), F.min((F.col("count") >= F.col("n")) & (F.col("count") - F.col("error") <= F.col("n"))).alias("within_bound"))


def heavy_keeper_topk(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: the ten users with most events, counted exactly, and whether the sketch's hundred candidates hold eight of them."""
    events = table(spark, d, "events")
    sketch = heavy.HeavyKeeper.sized(events.select("user_id").distinct().count(), 100)
    found = sketch.candidates(events, "user_id").select("item", F.lit(1).alias("hit"))
    exact = events.groupBy(F.col("user_id").cast("string").alias("item")).count().orderBy(F.desc("count"), "item").limit(10)
    both = exact.join(F.broadcast(found), "item", "left")
    return both.join(both.agg((F.count("hit") >= 8).alias("within_bound"))).select("item", "count", "within_bound")


def approx_top_k_native(spark: SparkSession, d: str) -> DataFrame:
    """Verified: five types in Spark's own summary."""
    top = table(spark, d, "events").agg(F.expr("approx_top_k(event_type, 5, 1000)").alias("t"))
    return top.select(F.explode("t").alias("x")).select("x.item", "x.count")


def dd_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact."""
    state = DD.state(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return DD.quantiles(state, PROBABILITIES, ["l_returnflag", "l_linestatus"]).withColumn("value", F.round("value", 6))


def dd_state_merge(spark: SparkSession, d: str) -> DataFrame:
    """Exact: negative and positive balances; states of two halves merge."""
    customers = table(spark, d, "customer")
    state = DD.merge(*[DD.state(customers.filter((F.col("c_custkey") % 2) == i), "c_acctbal") for i in (0, 1)])
    return DD.quantiles(state, PROBABILITIES).withColumn("value", F.round("value", 6))


def kll_quantiles_bound(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: the rank of each value is within 3 % of what was asked."""
    events = table(spark, d, "events")
    got = kll_quantiles(events, "value", PROBABILITIES, ["event_type"])
    rank = events.join(got.select("event_type", "q", F.col("value").alias("v")), "event_type").groupBy("event_type", "q").agg(F.avg((F.col("value") <= F.col("v")).cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))
    return rank.select("event_type", "q", "n", (F.abs(F.col("r") - F.col("q")) <= 0.03).alias("within_bound"))


def tdigest_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: exact quantiles, and whether the rank of the digest's value is within 2 % of what was asked."""
    events = table(spark, d, "events")
    state = DIGEST.state(events, "value", "event_type")
    got = state.select("event_type", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), quantile(q).alias("v")) for q in PROBABILITIES])).alias("x")).select("event_type", "x.*")
    rank = events.join(got, "event_type").groupBy("event_type", "q").agg(F.avg((F.col("value") <= F.col("v")).cast("double")).alias("r"))
    exact = events.groupBy("event_type").agg(F.percentile("value", F.array(*map(F.lit, PROBABILITIES))).alias("e")).select("event_type", F.posexplode("e").alias("i", "exact"))
    exact = exact.select("event_type", F.get(F.array(*map(F.lit, PROBABILITIES)), F.col("i")).alias("q"), F.round("exact", 6).alias("exact"))
    return rank.join(exact, ["event_type", "q"]).select("event_type", "q", "exact", (F.abs(F.col("r") - F.col("q")) <= 0.02).alias("within_bound"))


def tdigest_cdf(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: the share of values up to 100 is within 2 %."""
    events = table(spark, d, "events")
    state = DIGEST.state(events, "value", "event_type").select("event_type", cdf(100.0).alias("c"))
    exact = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") <= 100).cast("double")).alias("e"))
    return state.join(exact, "event_type").select("event_type", "n", (F.abs(F.col("c") - F.col("e")) <= 0.02).alias("within_bound"))


#: The stated queries: suppliers whose number is divisible by 20, each beside every other supplier.
ASKED = "s % 20 = 0"
LSH_ROWS = 2


def _supplier_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), "l_partkey", "l_quantity")


def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Exact: of every supplier's parts."""
    return MINHASH.state(_supplier_parts(spark, d), "s", "l_partkey")


def minhash_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Exact: suppliers divisible by 20 against all others."""
    rows = _supplier_parts(spark, d)
    return MINHASH.search(MINHASH.state(rows, "s", "l_partkey"), ASKED, "s").withColumn("jaccard", F.round("jaccard", 6))


def bbit_minhash_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Exact: suppliers divisible by 20 against all others."""
    rows = _supplier_parts(spark, d)
    return BBIT.search(BBIT.state(rows, "s", "l_partkey"), ASKED, "s").withColumn("jaccard", F.round("jaccard", 6))


def weighted_minhash_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: suppliers divisible by 20 against all others, exact weighted similarity, and whether the estimate is within 0.15 of it."""
    rows = _supplier_parts(spark, d)
    got = weighted_search(rows, ASKED, "s", "l_partkey", "l_quantity", WeightedMinHash(256))
    return got.select("a", "b", F.round("exact", 6).alias("exact"), (F.abs(F.col("jaccard") - F.col("exact")) <= 0.15).alias("within_bound"))


def odd_symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    """Exact: suppliers divisible by 20 against all others."""
    rows = _supplier_parts(spark, d)
    return ODD.search(ODD.state(rows, "s", "l_partkey"), ASKED, "s").withColumn("estimate", F.round("estimate", 4))


def simhash_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Exact: of every supplier's parts."""
    return SIM.fingerprint(SIM.state(_supplier_parts(spark, d), "s", "l_partkey"))


def _distances(both: DataFrame) -> DataFrame:
    a, b = F.col("fingerprint_a"), F.col("fingerprint_b")
    return both.select("a", "b", SIM.distance(a, b).cast("long").alias("distance"), F.round(SIM.similarity(a, b), 6).alias("similarity"))


def simhash_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Exact: suppliers divisible by 20 against all others."""
    return SIM.search(simhash_fingerprints(spark, d), ASKED, "s").withColumn("similarity", F.round("similarity", 6))


def minhash_lsh_search(spark: SparkSession, d: str) -> DataFrame:
    """Exact: suppliers divisible by 20 and those that agree with them in a band of slots, with the estimate and the exact similarity."""
    rows = _supplier_parts(spark, d)
    state = MINHASH.state(rows, "s", "l_partkey")
    buckets = banded(state, "s", LSH_ROWS)
    pairs = met(buckets.filter(F.col("s") % 20 == 0), buckets, "s")
    sets = rows.select("s", "l_partkey").distinct()
    sides = [sets.select(F.col("s").alias(x), "l_partkey") for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], ["b", "l_partkey"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n"))
    sizes = beside(sets.groupBy("s").agg(F.count(F.lit(1)).alias("n")), pairs, "s", "n")
    n = F.coalesce("_n", F.lit(0))
    exact = sizes.join(both, ["a", "b"], "left").select("a", "b", F.round(n / (F.col("n_a") + F.col("n_b") - n), 6).alias("exact"))
    return MINHASH.jaccard(state, pairs, "s").withColumn("jaccard", F.round("jaccard", 6)).join(exact, ["a", "b"])


def simhash_band_search(spark: SparkSession, d: str) -> DataFrame:
    """Exact: suppliers divisible by 20 and those whose fingerprints agree with theirs in one of six bands of ten bits."""
    prints = simhash_fingerprints(spark, d)
    bands = SIM.bands(prints, "s", 6)
    return _distances(beside(prints, met(bands.filter(F.col("s") % 20 == 0), bands, "s"), "s", "fingerprint"))


def reservoir_sample(spark: SparkSession, d: str) -> DataFrame:
    """Exact."""
    return RESERVOIR.sample(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "priority")


def reservoir_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Exact: samples of two halves merge to that of the whole."""
    events = table(spark, d, "events").select("event_id", "event_type")
    halves = [RESERVOIR.sample(events.filter((F.col("event_id") % 2) == i), "event_id", ["event_type"]) for i in (0, 1)]
    return RESERVOIR.merge(*halves, "event_id", ["event_type"])


def _last_ones(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.withColumn("x", F.sum((F.col("event_type") == "purchase").cast("long")).over(w.rowsBetween(1 - WINDOW, 0))).withColumn("n", F.row_number().over(w))
    return rows.groupBy("user_id").agg(F.max("n").cast("long").alias("ticks"), F.max_by("x", "n").alias("exact"))


def _close(estimate: str) -> F.Column:
    return F.abs(F.col(estimate) - F.col("exact")) <= F.greatest(F.lit(1.0), EPSILON * F.col("exact"))


def eh_sliding_count(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: purchases among the last 50 events of each user."""
    events = table(spark, d, "events")
    got = sliding_counts(events.withColumn("bit", F.col("event_type") == "purchase"), "user_id", "bit", ["ts", "event_id"], WINDOW, EPSILON)
    return got.join(_last_ones(events).drop("ticks"), "user_id").select("user_id", "ticks", "exact", _close("estimate").alias("within_bound"))


def stream_hll_windows(spark: SparkSession, d: str) -> DataFrame:
    """Exact: distinct users of each day, registers kept by a stream."""
    stream = S.windowed(S.read_files(spark, f"{d}/events.parquet"), "ts", "1 day", "1 hour")
    state = S.drain(S.hll_state(stream, HLL, "user_id", []), "complete")
    return HLL.estimate(state, ["window"]).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "estimate")


def stream_cms_windows(spark: SparkSession, d: str) -> DataFrame:
    """Exact: cells of the users' counts of all weeks."""
    stream = S.windowed(S.read_files(spark, f"{d}/events.parquet"), "ts", "7 days", "1 hour")
    state = S.drain(S.count_min_state(stream, CMS, "user_id"), "complete")
    return state.groupBy("row", "cell").agg(F.sum("count").alias("count"))


def stream_dd_windows(spark: SparkSession, d: str) -> DataFrame:
    """Exact: medians of each day."""
    stream = S.windowed(S.read_files(spark, f"{d}/events.parquet"), "ts", "1 day", "1 hour")
    state = S.drain(S.dd_state(stream, DD, "value"), "complete").withColumn("day", F.date_format("window.start", "yyyy-MM-dd")).drop("window")
    return DD.quantiles(state, [0.5], ["day"]).select("day", F.round("value", 6).alias("median"))


def stream_eh(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: as the batch query, from a stateful stream."""
    stream = S.read_files(spark, f"{d}/events.parquet")
    got = S.drain(S.sliding_counts(stream, "user_id", F.col("event_type") == "purchase", ["ts", "event_id"], WINDOW, EPSILON), "update")
    got = got.groupBy("user_id").agg(F.max_by("estimate", "ticks").alias("estimate"), F.max("ticks").alias("ticks"))
    return got.join(_last_ones(table(spark, d, "events")).drop("ticks"), "user_id").select("user_id", "ticks", "exact", _close("estimate").alias("within_bound"))


def partition_invariance(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: rows of each state, and whether those of two ways to deal rows over tasks, at random and by ranges, are equal row by row."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    spread, ranged = lines.repartition(16), lines.repartitionByRange(5, "l_extendedprice", "l_orderkey")
    builds = {
        "bloom": lambda df: ORDERS.bits(df, "l_orderkey"),
        "hyperloglog": lambda df: HLL.state(df, "l_orderkey"),
        "count_min": lambda df: CMS.state(df, "l_partkey"),
        "dd_sketch": lambda df: DD.state(df, "l_extendedprice"),
    }
    out = None
    for name, build in builds.items():
        a, b = build(spread), build(ranged)
        one = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.lit(name).alias("sketch"), (F.count(F.lit(1)) == 0).alias("within_bound"))
        one = one.join(a.agg(F.count(F.lit(1)).alias("rows"))).select("sketch", "rows", "within_bound")
        out = one if out is None else out.unionByName(one)
    return out


#: Tables whose rows are the keys to size for, with a rate; and with a rate and a budget in bytes, so many for each key and so many besides.
GRID = [("customer", 0.01), ("part", 0.01), ("part", 0.05), ("lineitem", 0.001)]
BUDGETS = [("part", 0.01, 2, 0), ("orders", 0.05, 0.9, 0), ("lineitem", 0.001, 500, 0), ("lineitem", 0.001, 0, 10)]


def _rows_of(spark: SparkSession, d: str, names: set[str]) -> dict[str, int]:
    return {name: table(spark, d, name).count() for name in sorted(names)}


def sizing_params(spark: SparkSession, d: str) -> DataFrame:
    """Exact: bits, hashes and bytes of Bloom and cuckoo filters for the rows of some tables."""
    count = _rows_of(spark, d, {t for t, _ in GRID})
    rows = [(t, n := count[t], p, (b := sizing.bloom_params(n, p)).m, b.k, b.memory_bytes, (c := sizing.cuckoo_params(n, p)).capacity, c.fingerprint_bits) for t, p in GRID]
    return spark.createDataFrame(rows, "source string, n long, fpr double, bloom_m long, bloom_k long, bloom_bytes long, cuckoo_capacity long, cuckoo_bits long")


def recommend_filter(spark: SparkSession, d: str) -> DataFrame:
    """Exact: the filter with the fewest false positives within a budget, for the rows of some tables."""
    count = _rows_of(spark, d, {t for t, *_ in BUDGETS})
    rows = [(t, n := count[t], p, budget := math.floor(each * n) + more, (r := sizing.recommend(n, p, budget)).structure, r.memory_bytes) for t, p, each, more in BUDGETS]
    return spark.createDataFrame(rows, "source string, n long, fpr double, budget long, structure string, bytes long")


def sketch_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: rows of saved and loaded states, and whether they are those of the originals."""
    lines, out = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice"), None
    for name, sketch, state in (
        ("bloom", ORDERS, ORDERS.bits(lines, "l_orderkey")),
        ("hyperloglog", HLL, HLL.state(lines, "l_orderkey")),
        ("count_min", CMS, CMS.state(lines, "l_partkey")),
        ("dd_sketch", DD, DD.state(lines, "l_extendedprice")),
    ):
        path = working.path(spark, name)
        states.save(state, path, name, {"spec": repr(sketch)})
        back = states.load(spark, path, name, {"spec": repr(sketch)})
        one = back.exceptAll(state).unionByName(state.exceptAll(back)).agg((F.count(F.lit(1)) == 0).alias("within_bound"))
        one = back.agg(F.lit(name).alias("sketch"), F.count(F.lit(1)).alias("rows")).join(one)
        out = one if out is None else out.unionByName(one)
    return out


def _states(spark: SparkSession, d: str) -> list[tuple[str, object, DataFrame]]:
    """A state of every kind with its sketch."""
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts", (F.col("event_type") == "purchase").alias("bit"))
    parts, n = _supplier_parts(spark, d), max(1, customers.count())
    bloom, blocked, pairs = membership.Bloom.sized(n, 0.01, P), membership.Blocked.sized(n, 0.01, P), membership.Quotient.sized(n, policy=P)
    slots, batches = QuotientFilter.sized(n, policy=P), IncrementalCuckoo.sized(n, policy=P)
    filters = [(f"static_{type(f).__name__.lower()}{b}", s := Sharded.over(f, n, P), s.state(customers, "c_custkey")) for f, b in ((Xor(), 8), (BinaryFuse(16), 16), (Ribbon(8, 128), 8), (CuckooFilter(), ""))]
    scalable, keeper, odd = membership.Scalable(200, 0.01, policy=P), heavy.HeavyKeeper(4, 256, 20), OddSketch(1024, P)
    kll, weighted = KLL(200, 7), WeightedMinHash(16, P)
    return [
        *filters,
        ("bloom", bloom, bloom.bits(customers, "c_custkey")),
        ("bloom_words", bloom, bloom.words(bloom.bits(customers, "c_custkey"))),
        ("counting_bloom", bloom, membership.counting(bloom, orders, "o_custkey")),
        ("scalable_bloom", scalable, scalable.bits(customers, "c_custkey", [F.col("c_custkey")])),
        ("blocked_bloom", blocked, blocked.state(customers, "c_custkey")),
        ("quotient_pairs", pairs, pairs.state(customers, "c_custkey")),
        ("quotient_slots", slots, slots.state(customers, "c_custkey")),
        ("cuckoo_batches", batches, batches.insert(batches.empty(customers), customers, "c_custkey")),
        ("hyperloglog", HLL, HLL.state(events, "user_id", ["event_type"])),
        ("count_min", CMS, CMS.state(events, "user_id")),
        ("count_min_log", CML, CML.state(events, "user_id")),
        ("count_sketch", COUNT_SKETCH, COUNT_SKETCH.state(orders, "o_custkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1))),
        ("ams", AMS_, AMS_.state(orders, "o_custkey")),
        ("misra_gries", heavy.MisraGries(50), heavy.MisraGries(50).summary(events, "user_id")),
        ("space_saving", heavy.SpaceSaving(50), heavy.SpaceSaving(50).summary(events, "user_id")),
        ("lossy_counting", heavy.LossyCounting(0.01), heavy.LossyCounting(0.01).summary(events, "user_id")),
        ("heavy_keeper", keeper, keeper.state(events, "user_id")),
        ("dd_sketch", DD, DD.state(customers, "c_acctbal")),
        ("tdigest", DIGEST, DIGEST.state(events, "value", "event_type")),
        ("kll_compactors", kll, kll.state(events, "value", ["event_type"])),
        ("kll_native", "kll 200", kll_state(events, "value", ["event_type"])),
        ("minhash", MINHASH, MINHASH.state(parts, "s", "l_partkey")),
        ("bbit_minhash", BBIT, BBIT.state(parts, "s", "l_partkey")),
        ("weighted_minhash", weighted, weighted.state(parts, "s", "l_partkey", "l_quantity")),
        ("odd_sketch", odd, odd.state(parts, "s", "l_partkey")),
        ("simhash", SIM, SIM.state(parts, "s", "l_partkey")),
        ("reservoir", RESERVOIR, RESERVOIR.sample(events.select("event_id"), "event_id")),
        ("exponential_histogram", (WINDOW, EPSILON), histograms(events, "user_id", "bit", ["ts", "event_id"], WINDOW, EPSILON)),
    ]


def all_states_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: a state of every kind saved and loaded: whether its rows and the parameters in its columns are the same."""
    rows = []
    for name, sketch, state in _states(spark, d):
        state, path = working.written(state, name), working.path(spark, f"saved_{name}")
        states.save(state, path, name, {"spec": repr(sketch)})
        back = states.load(spark, path, name, {"spec": repr(sketch)})
        alike = {f.name: f.metadata.get("quern") for f in back.schema} == {f.name: f.metadata.get("quern") for f in state.schema}
        told = [df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*state.columns).cast("decimal(38,0)"))).first() for df in (state, back)]
        rows.append((name, alike and told[0] == told[1] and told[0][0] > 0))
    return spark.createDataFrame(rows, "sketch string, within_bound boolean")


#: The names that _states gives.
KINDS = (
    "static_xor8 static_binaryfuse16 static_ribbon8 static_cuckoofilter bloom bloom_words counting_bloom scalable_bloom blocked_bloom quotient_pairs quotient_slots cuckoo_batches hyperloglog count_min count_min_log count_sketch ams "
    "misra_gries space_saving lossy_counting heavy_keeper dd_sketch tdigest kll_compactors kll_native minhash bbit_minhash weighted_minhash odd_sketch simhash reservoir exponential_histogram"
).split()

QUERIES = {
    f.__name__: f
    for f in (
        event_profile, hll_distinct_by_group, hll_rollup, hll_merge, native_distinct_bound, cms_point_estimates, cms_never_under, cml_estimates,
        count_sketch_estimates, ams_f2, mg_heavy_hitters, lossy_heavy_hitters, space_saving_topk, space_saving_bounds, heavy_keeper_topk, approx_top_k_native,
        dd_quantiles, dd_state_merge, kll_quantiles_bound, tdigest_quantiles, tdigest_cdf, minhash_signatures, minhash_jaccard, bbit_minhash_jaccard,
        weighted_minhash_jaccard, odd_symmetric_difference, simhash_fingerprints, simhash_similarity, minhash_lsh_search, simhash_band_search, reservoir_sample, reservoir_by_group, eh_sliding_count,
        stream_hll_windows, stream_cms_windows, stream_dd_windows, stream_eh, partition_invariance, sizing_params, recommend_filter, sketch_roundtrip, all_states_roundtrip,
    )
}


# SQL.

_W = 60 - HLL.precision
_PARTS = "(SELECT DISTINCT l_suppkey AS s, l_partkey FROM lineitem)"
_PAIRS = "(SELECT a, b FROM (SELECT DISTINCT l_suppkey AS a FROM lineitem WHERE l_suppkey % 20 = 0) x_, (SELECT DISTINCT l_suppkey AS b FROM lineitem) y_ WHERE a <> b)"


def _hll(source: str, key: str, group: str = "") -> str:
    g, by = (group + ", ", f"GROUP BY {group}") if group else ("", "")
    return f"""SELECT {g}floor(CASE WHEN raw <= {2.5 * HLL.m} AND zeros > 0 THEN {HLL.m}.0 * ln({HLL.m}.0 / zeros) ELSE raw END + 0.5)::BIGINT AS estimate FROM (
SELECT {g}{HLL.m} - count(*) AS zeros, {HLL.alpha * HLL.m * HLL.m!r} / (sum(pow(2.0, -rho)) + ({HLL.m} - count(*))) AS raw FROM (
SELECT {g}h >> {_W} AS reg, max(CASE WHEN h % {1 << _W} = 0 THEN {_W + 1} ELSE {_W} - length(to_base(h % {1 << _W}, 2)) + 1 END) AS rho
FROM (SELECT {g}{sql_hash(key)} AS h FROM {source}) GROUP BY {g}h >> {_W}) {by})"""


def _dd(source: str, value: str, probabilities: list[float], group: str = "", name: str = "value") -> str:
    g, part = (group + ", ", f"PARTITION BY {group}") if group else ("", "")
    ln = repr(math.log(DD.gamma))
    return f"""WITH s AS (SELECT {g}sign({value})::INT AS sg, CASE WHEN {value} = 0 THEN 0 ELSE ceil(ln(abs({value})) / {ln})::INT END AS b, count(*) AS c FROM {source} GROUP BY ALL),
r AS (SELECT *, sum(c) OVER ({part} ORDER BY sg, sg * b) AS up, sum(c) OVER ({part}) AS n FROM s),
q AS (SELECT unnest({probabilities}::DOUBLE[]) AS q),
f AS (SELECT {g}q, arg_min(CASE WHEN sg = 0 THEN 0.0 ELSE sg * 2 * pow({DD.gamma!r}, b) / {DD.gamma + 1!r} END, up) AS value FROM r, q WHERE up >= q * n GROUP BY {g}q)
SELECT {g}q, round(value, 6) AS {name} FROM f"""


def _cells(key: str, depth: int, width: int) -> str:
    return f"{sql_hash(f'({key})::VARCHAR || chr(35) || r')} % {width}"


def _signed(source: str, depth: int, width: int) -> str:
    """Rows k, r, cell, s, w of a source with k and w."""
    return f"SELECT k, w, r, (h >> 1) % {width} AS cell, CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END AS s FROM (SELECT k, w, r, {sql_hash('k::VARCHAR || chr(35) || r')} AS h FROM ({source}), (SELECT unnest(range(0, {depth})) AS r))"


def _signature(parts: str = _PARTS) -> str:
    ab = ", ".join("({}, {}, {})".format(i, *coefficients(i)) for i in range(MINHASH.k))
    return f"SELECT s, slot, min((ka * x + kb) % {PRIME}) AS value FROM (SELECT s, {sql_hash('l_partkey')} % {PRIME} AS x FROM {parts}), (VALUES {ab}) c(slot, ka, kb) GROUP BY s, slot"


def _levels() -> str:
    return ", ".join(f"({v}, {CML.value(v)})" for v in range(CML.levels + 1))


_SIM = f"SELECT s, sum(CASE WHEN t > 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS fingerprint FROM (SELECT s, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN w ELSE -w END) AS t FROM (SELECT l_suppkey AS s, {sql_hash('l_partkey')} AS h, count(*) AS w FROM lineitem GROUP BY ALL), (SELECT unnest(range(0, 60))::INT AS i) GROUP BY s, i) GROUP BY s"
_LAST = f"SELECT user_id, max(n)::BIGINT AS ticks, arg_max(x, n)::BIGINT AS exact, true AS within_bound FROM (SELECT user_id, row_number() OVER w AS n, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id"
_PROFILE_Q = _dd("events", "value", [0.5, 0.95, 0.99], "event_type")

_STATES = f"""SELECT sketch, n AS rows, true AS within_bound FROM (
SELECT 'bloom' AS sketch, count(DISTINCT bit) AS n FROM ({sql_positions('lineitem', 'l_orderkey', ORDERS.k, ORDERS.m)})
UNION ALL SELECT 'hyperloglog', count(DISTINCT {sql_hash('l_orderkey')} >> {_W}) FROM lineitem
UNION ALL SELECT 'count_min', count(DISTINCT struct_pack(r := r, c := {_cells('l_partkey', CMS.depth, CMS.width)})) FROM (SELECT DISTINCT l_partkey FROM lineitem), (SELECT unnest(range(0, {CMS.depth})) AS r)
UNION ALL SELECT 'dd_sketch', count(DISTINCT ceil(ln(l_extendedprice) / {math.log(DD.gamma)!r})) FROM lineitem)"""

ORACLES = {
    "event_profile": f"""SELECT u.event_type, u.estimate AS users, p50, p95, p99, top_user FROM ({_hll('events', 'user_id', 'event_type')}) u
JOIN (SELECT event_type, max(value) FILTER (q = 0.5) AS p50, max(value) FILTER (q = 0.95) AS p95, max(value) FILTER (q = 0.99) AS p99 FROM ({_PROFILE_Q}) GROUP BY event_type) q USING (event_type)
JOIN (SELECT event_type, user_id AS top_user FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS n FROM events GROUP BY event_type, user_id) WHERE n = 1) t USING (event_type)""",
    "hll_distinct_by_group": _hll("events", "user_id", "event_type"),
    "hll_rollup": "WITH e AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, user_id FROM events) SELECT event_type, day, estimate FROM (" + _hll("e", "user_id", "event_type, day") + ") UNION ALL SELECT event_type, NULL, estimate FROM (" + _hll("e", "user_id", "event_type") + ") UNION ALL SELECT NULL, NULL, estimate FROM (" + _hll("e", "user_id") + ")",
    "hll_merge": _hll("lineitem", "l_orderkey", "l_returnflag"),
    "native_distinct_bound": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n, true AS within_bound FROM lineitem GROUP BY l_returnflag",
    "cms_point_estimates": f"""WITH rows_ AS (SELECT unnest(range(0, {CMS.depth})) AS r),
c AS (SELECT r, {_cells('l_partkey', CMS.depth, CMS.width)} AS cell, sum(w) AS c FROM (SELECT l_partkey, sum(l_quantity::BIGINT) AS w FROM lineitem GROUP BY l_partkey), rows_ GROUP BY ALL),
p AS (SELECT p_partkey, r, {_cells('p_partkey', CMS.depth, CMS.width)} AS cell FROM part, rows_)
SELECT p_partkey, min(coalesce(c, 0))::BIGINT AS estimate FROM p LEFT JOIN c USING (r, cell) GROUP BY p_partkey""",
    "cms_never_under": "SELECT count(DISTINCT l_partkey) AS keys, 0::BIGINT AS too_low, true AS within_bound FROM lineitem",
    "cml_estimates": f"""WITH l(v, x) AS (VALUES {_levels()}), rows_ AS (SELECT unnest(range(0, {CML.depth})) AS r),
k AS (SELECT user_id, count(*) AS w FROM events GROUP BY user_id),
c AS (SELECT r, {_cells('user_id', CML.depth, CML.width)} AS cell, max(w) AS w FROM k, rows_ GROUP BY ALL),
e AS (SELECT r, cell, arg_min(v, struct_pack(d := abs(x - w), v := v)) AS v FROM c, l GROUP BY r, cell, w),
m AS (SELECT user_id, min(v) AS v FROM (SELECT user_id, r, {_cells('user_id', CML.depth, CML.width)} AS cell FROM k, rows_) JOIN e USING (r, cell) GROUP BY user_id)
SELECT user_id, x::BIGINT AS estimate FROM m JOIN l USING (v)""",
    "count_sketch_estimates": f"""WITH c AS ({_signed("SELECT o_custkey AS k, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) AS w FROM orders GROUP BY o_custkey", COUNT_SKETCH.depth, COUNT_SKETCH.width)}),
t AS (SELECT r, cell, sum(s * w) AS c FROM c GROUP BY r, cell)
SELECT k AS o_custkey, list_sort(list(s * t.c))[{COUNT_SKETCH.depth // 2 + 1}]::BIGINT AS estimate FROM c JOIN t USING (r, cell) GROUP BY k""",
    "ams_f2": f"""WITH c AS ({_signed('SELECT o_custkey AS k, count(*) AS w FROM orders GROUP BY o_custkey', AMS_.depth, AMS_.width)}),
f AS (SELECT r, sum(x * x)::DOUBLE AS f2 FROM (SELECT r, cell, sum(s * w) AS x FROM c GROUP BY r, cell) GROUP BY r)
SELECT r::VARCHAR AS row, f2 FROM f UNION ALL SELECT 'median', median(f2) FROM f""",
    "mg_heavy_hitters": "SELECT user_id::VARCHAR AS item, count(*) AS count FROM events GROUP BY user_id HAVING count(*) * 125 > (SELECT count(*) FROM events)",
    "lossy_heavy_hitters": "SELECT user_id::VARCHAR AS item, count(*) AS count FROM events GROUP BY user_id HAVING count(*) >= 0.008 * (SELECT count(*) FROM events)",
    "space_saving_topk": "SELECT user_id::VARCHAR AS item, count(*) AS count FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id::VARCHAR LIMIT 10",
    "space_saving_bounds": "SELECT least(64, count(DISTINCT l_suppkey)) AS counters, true AS within_bound FROM lineitem",
    "heavy_keeper_topk": "SELECT user_id::VARCHAR AS item, count(*) AS count, true AS within_bound FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id::VARCHAR LIMIT 10",
    "approx_top_k_native": "SELECT event_type AS item, count(*) AS count FROM events GROUP BY event_type",
    "dd_quantiles": _dd("lineitem", "l_extendedprice", PROBABILITIES, "l_returnflag, l_linestatus"),
    "dd_state_merge": _dd("customer", "c_acctbal", PROBABILITIES),
    "kll_quantiles_bound": f"SELECT event_type, q, count(*) AS n, true AS within_bound FROM events, (SELECT unnest({PROBABILITIES}::DOUBLE[]) AS q) GROUP BY event_type, q",
    "tdigest_quantiles": f"SELECT event_type, unnest({PROBABILITIES}::DOUBLE[]) AS q, round(unnest(quantile_cont(value, {PROBABILITIES}::DOUBLE[])), 6) AS exact, true AS within_bound FROM events GROUP BY event_type",
    "tdigest_cdf": "SELECT event_type, count(*) AS n, true AS within_bound FROM events GROUP BY event_type",
    "minhash_signatures": _signature(),
    "minhash_jaccard": f"WITH m AS ({_signature()}) SELECT a, b, round(count(*) FILTER (x.value = y.value) / {MINHASH.k}.0, 6) AS jaccard FROM {_PAIRS} JOIN m x ON x.s = a JOIN m y ON y.s = b AND x.slot = y.slot GROUP BY a, b",
    "bbit_minhash_jaccard": f"WITH m AS ({_signature()}) SELECT a, b, round(greatest(0.0, (count(*) FILTER (x.value % {1 << BBIT.bits} = y.value % {1 << BBIT.bits}) / {BBIT.k}::DOUBLE - {2.0**-BBIT.bits}) / {1 - 2.0**-BBIT.bits}), 6) AS jaccard FROM {_PAIRS} JOIN m x ON x.s = a JOIN m y ON y.s = b AND x.slot = y.slot GROUP BY a, b",
    "weighted_minhash_jaccard": f"""WITH w AS (SELECT l_suppkey AS s, l_partkey, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY ALL), t AS (SELECT s, sum(w) AS t FROM w GROUP BY s),
c AS (SELECT x.s AS a, y.s AS b, sum(least(x.w, y.w)) AS m FROM w x JOIN w y USING (l_partkey) WHERE x.s % 20 = 0 AND x.s <> y.s GROUP BY ALL)
SELECT a, b, round(coalesce(m, 0) / (x.t + y.t - coalesce(m, 0)), 6) AS exact, true AS within_bound FROM {_PAIRS} LEFT JOIN c USING (a, b) JOIN t x ON x.s = a JOIN t y ON y.s = b""",
    "odd_symmetric_difference": f"""WITH p AS (SELECT s, p // 32 AS word, bit_xor(1::BIGINT << (p % 32)::INT) AS v FROM (SELECT s, {sql_hash('l_partkey')} % {ODD.m} AS p FROM {_PARTS}) GROUP BY s, p // 32),
x AS (SELECT a, b, word, bit_xor(v) AS v FROM {_PAIRS} JOIN p ON s IN (a, b) GROUP BY a, b, word),
o AS (SELECT a, b, sum(bit_count(v))::BIGINT AS odd FROM x GROUP BY a, b)
SELECT a, b, odd, round(CASE WHEN odd >= {ODD.m // 2} THEN 'inf'::DOUBLE ELSE ln(1 - 2 * odd / {ODD.m}::DOUBLE) / ln(1 - 2 / {ODD.m}::DOUBLE) END, 4) AS estimate FROM o""",
    "simhash_fingerprints": _SIM,
    "simhash_similarity": f"WITH f AS ({_SIM}) SELECT a, b, bit_count(xor(x.fingerprint, y.fingerprint))::BIGINT AS distance, round(cos(3.141592653589793::DOUBLE * bit_count(xor(x.fingerprint, y.fingerprint)) / 60), 6) AS similarity FROM {_PAIRS} JOIN f x ON x.s = a JOIN f y ON y.s = b",
    "minhash_lsh_search": f"""WITH m AS ({_signature()}), z AS (SELECT s, count(*) AS n FROM {_PARTS} GROUP BY s),
k AS (SELECT s, slot // {LSH_ROWS} AS band, list(value ORDER BY slot) AS v FROM m GROUP BY s, slot // {LSH_ROWS}),
p AS (SELECT DISTINCT x.s AS a, y.s AS b FROM k x JOIN k y USING (band, v) WHERE x.s % 20 = 0 AND x.s <> y.s),
j AS (SELECT a, b, round(count(*) FILTER (x.value = y.value) / {MINHASH.k}.0, 6) AS jaccard FROM p JOIN m x ON x.s = a JOIN m y ON y.s = b AND x.slot = y.slot GROUP BY a, b),
c AS (SELECT a, b, count(*) AS n FROM p JOIN {_PARTS} x ON x.s = a JOIN {_PARTS} y ON y.s = b AND x.l_partkey = y.l_partkey GROUP BY a, b)
SELECT a, b, jaccard, round(coalesce(c.n, 0) / (zx.n + zy.n - coalesce(c.n, 0))::DOUBLE, 6) AS exact FROM j LEFT JOIN c USING (a, b) JOIN z zx ON zx.s = a JOIN z zy ON zy.s = b""",
    "simhash_band_search": f"""WITH f AS ({_SIM}), k AS (SELECT s, fingerprint, i AS band, (fingerprint >> (10 * i)) & 1023 AS v FROM f, (SELECT unnest(range(0, 6))::INT AS i))
SELECT DISTINCT x.s AS a, y.s AS b, bit_count(xor(x.fingerprint, y.fingerprint))::BIGINT AS distance, round(cos(3.141592653589793::DOUBLE * bit_count(xor(x.fingerprint, y.fingerprint)) / 60), 6) AS similarity FROM k x JOIN k y USING (band, v) WHERE x.s % 20 = 0 AND x.s <> y.s""",
    "reservoir_sample": f"""SELECT o_orderkey, {sql_hash("o_orderkey::VARCHAR || '#7'")} AS priority FROM orders ORDER BY priority, o_orderkey LIMIT {RESERVOIR.k}""",
    "reservoir_by_group": f"""SELECT event_id, event_type, priority FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY priority, event_id) AS n FROM (SELECT event_id, event_type, {sql_hash("event_id::VARCHAR || '#7'")} AS priority FROM events)) WHERE n <= {RESERVOIR.k}""",
    "eh_sliding_count": _LAST,
    "stream_eh": _LAST,
    "partition_invariance": _STATES,
    "stream_hll_windows": "WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id FROM events) " + _hll("e", "user_id", "day"),
    "stream_cms_windows": f"SELECT r::INT AS row, {_cells('user_id', CMS.depth, CMS.width)} AS cell, count(*) AS count FROM events, (SELECT unnest(range(0, {CMS.depth})) AS r) GROUP BY ALL",
    "stream_dd_windows": "SELECT day, median FROM (" + _dd("(SELECT strftime(ts, '%Y-%m-%d') AS day, value FROM events)", "value", [0.5], "day", "median") + ")",
    "sizing_params": f"""SELECT source, n::BIGINT AS n, fpr::DOUBLE AS fpr, m AS bloom_m, greatest(1, round(m::DOUBLE / n * ln(2)))::BIGINT AS bloom_k, m // 8 AS bloom_bytes, 4 * pow(2, ceil(log2(greatest(2, ceil(n / 4.0)))))::BIGINT AS cuckoo_capacity, least(8, greatest(1, ceil(log2(8 / fpr::DOUBLE))))::BIGINT AS cuckoo_bits
FROM (SELECT source, n, fpr, pow(2, ceil(log2(greatest(64, ceil(-n * ln(fpr::DOUBLE) / (ln(2) * ln(2)))))))::BIGINT AS m FROM ({" UNION ALL ".join(f"SELECT '{t}' AS source, (SELECT count(*) FROM {t}) AS n, {p} AS fpr" for t, p in GRID)}))""",
    "recommend_filter": f"""WITH g AS ({" UNION ALL ".join(f"SELECT '{t}' AS source, (SELECT count(*) FROM {t}) AS n, {p}::DOUBLE AS fpr, floor({e} * (SELECT count(*) FROM {t}))::BIGINT + {more} AS budget" for t, p, e, more in BUDGETS)}),
p AS (SELECT source, n::BIGINT AS n, fpr, budget,
pow(2, ceil(log2(greatest(64, ceil(-n * ln(fpr) / (ln(2) * ln(2)))))))::BIGINT // 8 AS bloom, 4 * pow(2, ceil(log2(greatest(2, ceil(n / 4.0)))))::BIGINT AS cuckoo,
3 * greatest(32, pow(2, ceil(log2(ceil(0.41 * n)))))::BIGINT AS xor_, pow(2, ceil(log2(ceil(1.08 * n))))::BIGINT AS ribbon, 8 / pow(2, least(8, greatest(1, ceil(log2(8 / fpr))))) AS cf FROM g),
c AS (SELECT source, n, fpr, budget, unnest([struct_pack(o := 1, s := 'BloomFilter', b := bloom, f := fpr), struct_pack(o := 2, s := 'CuckooFilter', b := cuckoo, f := cf::DOUBLE), struct_pack(o := 3, s := 'XorFilter', b := xor_, f := 1 / 256::DOUBLE), struct_pack(o := 4, s := 'RibbonFilter', b := ribbon, f := 1 / 256::DOUBLE)]) AS c FROM p),
r AS (SELECT source, n, fpr, budget, c.s AS structure, c.b AS bytes, row_number() OVER (PARTITION BY source, n, fpr, budget ORDER BY (c.b > budget)::INT, CASE WHEN c.b <= budget THEN round(c.f, 9) ELSE 0 END, c.b, c.o) AS k FROM c)
SELECT source, n, fpr, budget, structure, bytes FROM r WHERE k = 1""",
    "sketch_roundtrip": _STATES,
    "all_states_roundtrip": f"SELECT unnest({KINDS}) AS sketch, true AS within_bound FROM (SELECT count(*) FROM customer)",
}
