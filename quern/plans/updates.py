"""Queries of filters that are sized from their data, updated, learned, and of summaries that merge in steps; with SQL.

Docstrings: exact, verified or bounded, as in ``sets``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import windowed
from quern.operators.cuckoo import IncrementalCuckoo
from quern.operators.frequency import CountMinLog
from quern.operators.kll import KLL
from quern.operators.learned import LearnedBloom
from quern.operators.membership import Bloom
from quern.operators.quotient import FULLEST, QuotientFilter
from quern.plans.sets import P, sql_hash
from quern.sources.tables import table
from quern.sources.working import written

#: Keys of a shard, small so that small tables have several.
SHARD = 4_000
#: Slots of a table of ``quotient_refusal`` are 2^INNER at most when it begins.
INNER = 18
PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
LASTS = [10, 25, 50]
LONG_LASTS = [50, 200, 500, 1_000]
EPSILON = 0.1
SKETCH = KLL(200, 7)
LEARNED_FPR = 0.05


def quotient_slots(spark: SparkSession, d: str) -> DataFrame:
    """Exact: of each shard of a filter sized from the orders of lineitem the fingerprints, occupied slots and load; shifted ones are a subset, loads below 0.95."""
    lines = table(spark, d, "lineitem")
    n = lines.select("l_orderkey").distinct().count()
    filter_ = QuotientFilter.sized(max(1, n), policy=P, shard_keys=SHARD)
    stats = filter_.stats(filter_.state(lines, "l_orderkey"))
    return stats.select("shard", F.col("n").alias("pairs"), F.col("occupied").alias("quotients"), "refused", F.round("load", 6).alias("load"), ((F.col("load") < FULLEST) & (F.col("shifted") <= F.col("n")) & (F.col("clusters") <= F.col("occupied"))).alias("within_bound"))


def quotient_slot_ops(spark: SparkSession, d: str) -> DataFrame:
    """Exact: fingerprints after union, intersection and deletion of two filters' keys, and customers that the last one tells."""
    orders = table(spark, d, "orders")
    customers = table(spark, d, "customer").select("c_custkey")
    filter_ = QuotientFilter.sized(max(1, customers.count()), policy=P, shard_keys=SHARD)
    keys = {s: orders.filter(F.col("o_orderstatus") == s) for s in "FO"}
    a, b = (filter_.state(keys[s], "o_custkey") for s in "FO")
    rest = filter_.remove(a, keys["O"].filter("o_custkey % 2 = 0"), "o_custkey")
    told = filter_.maybe(customers, "c_custkey", rest).agg(F.sum(F.col("maybe").cast("long")).alias("told"))
    count = lambda state, name: state.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    return count(filter_.union(a, b), "union_pairs").join(count(filter_.intersection(a, b), "intersection_pairs")).join(count(rest, "rest_pairs")).join(told)


def _small_q(keys: int) -> int:
    """Slots for less than half of the keys."""
    return max(3, keys.bit_length() - 2)


def quotient_refusal(spark: SparkSession, d: str) -> DataFrame:
    """Exact: what a table with too few slots holds, refuses and tells, and what one that grows does."""
    orders = table(spark, d, "orders").select("o_orderkey")
    q, out = _small_q(orders.count()), None
    inner = min(q, INNER)  # tables of bounded size, side by side as ranges of one
    for name, grows in (("fixed", False), ("grows", True)):
        filter_ = QuotientFilter(inner, 20, 1 << q - inner, P, grows, ranges=True)
        half = filter_.state(orders.filter("o_orderkey % 2 = 0"), "o_orderkey")
        state = filter_.insert(half, orders, "o_orderkey")
        held = filter_.stats(state).groupBy(F.lit(name).alias("filter")).agg(F.sum("n").alias("held"), (F.sum("refused") > 0).alias("refuses"), (F.sum("n") <= FULLEST * F.sum("slots")).alias("within_bound"))
        told = filter_.maybe(orders, "o_orderkey", state).agg(F.sum(F.col("maybe").cast("long")).alias("told"))
        # What is told is held, but for fingerprints that several keys share.
        one = held.join(told).select("filter", "held", "refuses", (F.col("within_bound") & (F.col("told") >= F.col("held"))).alias("within_bound"))
        out = one if out is None else out.unionByName(one)
    return out


def cuckoo_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Exact: counts of a filter after three batches of insertions and deletions, and whether it answers as one that had the last keys from the start."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    f, o = (orders.filter(F.col("o_orderstatus") == s) for s in "FO")
    filter_ = IncrementalCuckoo.sized(max(1, orders.count() // 8), policy=P, shard_keys=SHARD)
    state = filter_.insert(filter_.empty(orders), f, "o_orderkey")
    state = filter_.update(state, o, f.filter("o_custkey % 2 = 0"), "o_orderkey")
    state = filter_.update(state, f.filter("o_custkey % 4 = 0"), o.filter("o_custkey % 2 = 1"), "o_orderkey")
    last = f.filter("o_custkey % 2 = 1 OR o_custkey % 4 = 0").unionByName(o.filter("o_custkey % 2 = 0"))
    once = filter_.insert(filter_.empty(orders), last, "o_orderkey")
    probes = orders.select("o_orderkey").unionByName(orders.select((-F.col("o_orderkey") - 1).alias("o_orderkey")))
    both = filter_.maybe(filter_.maybe(probes, "o_orderkey", state, "a"), "o_orderkey", once, "b")
    same = both.agg(F.sum((F.col("a") != F.col("b")).cast("long")).alias("other_answers"))
    found = filter_.maybe(last, "o_orderkey", state).agg(F.sum(F.col("maybe").cast("long")).alias("found"))
    return filter_.stats(state).select("n", "inserted", "removed", "missing", (F.col("deepest") > 0).alias("was_split")).join(same).join(found)


def _letters() -> list:
    """Shares of some letters in a text."""
    text = F.lower(F.coalesce("text", F.lit("")))
    share = lambda x: (F.length(text) - F.length(F.replace(text, F.lit(x), F.lit("")))) / F.greatest(F.lit(1), F.length(text))
    return [share(x) for x in ("th", "w", "y", "u")]


def learned_filter_fit(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: English documents as members, a model of letters learned from a sample; no member missed, strangers within twice their share, fewer bits a key than a Bloom filter."""
    docs = table(spark, d, "documents").select("doc_id", "text", (F.coalesce("lang", F.lit("")) == "en").alias("member"))
    members, strangers, features = docs.filter("member"), docs.filter("NOT member"), _letters()
    learned = LearnedBloom.fit(members, strangers, "doc_id", features, LEARNED_FPR, P)
    plain = Bloom.sized(max(1, learned.members), LEARNED_FPR, P)
    got = learned.maybe(docs, "doc_id", features, learned.state(members, "doc_id", features)).agg(
        F.sum(F.col("member").cast("long")).alias("members"),
        F.sum((F.col("member") & F.col("maybe")).cast("long")).alias("members_found"),
        F.sum((~F.col("member")).cast("long")).alias("strangers"),
        F.sum((~F.col("member") & F.col("maybe")).cast("long")).alias("_false"),
    )
    return got.select("members", "members_found", "strangers", (F.col("_false") <= F.greatest(F.lit(10.0), 2 * LEARNED_FPR * F.col("strangers"))).alias("within_bound"), F.lit(learned.bits_per_key < plain.m / max(1, learned.members)).alias("smaller"))


def kll_merged_bound(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: least and largest value and count, exactly, and whether ranks of one sketch and of two halves' merged one are within its error of what was asked."""
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    whole = SKETCH.state(events, "value", ["event_type"])
    halves = SKETCH.merge(*[SKETCH.state(events.filter(F.col("event_id") % 2 == i), "value", ["event_type"]) for i in (0, 1)], group=["event_type"])
    sides = [SKETCH.quantiles(s, PROBABILITIES, ["event_type"]).select("event_type", "q", F.col("value").alias(v)) for s, v in ((whole, "v"), (halves, "w"))]
    got = written(sides[0].join(sides[1], ["event_type", "q"]), "quantiles")
    rank = lambda v: F.avg((F.col("value") <= F.col(v)).cast("double"))
    ranks = events.join(got, "event_type").groupBy("event_type", "q").agg(rank("v").alias("rv"), rank("w").alias("rw"))
    near = lambda r: F.abs(F.col(r) - F.col("q")) <= SKETCH.error + F.lit(2.0) / F.col("n")
    stats = SKETCH.stats(halves, ["event_type"])
    ends = got.groupBy("event_type").agg(F.max(F.when(F.col("q") == 0, F.col("w"))).alias("p0"), F.max(F.when(F.col("q") == 1, F.col("w"))).alias("p100"))
    both = ranks.join(stats, "event_type").join(ends, "event_type")
    return both.select("event_type", "q", "n", "least", "largest", ((F.col("p0") == F.col("least")) & (F.col("p100") == F.col("largest"))).alias("ends"), near("rv").alias("within_bound"), near("rw").alias("merged_within_bound"))


def cml_stream_bound(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: conservative updates in stream order with 4 and 8 bits a cell; all but 3 % of the users' estimates within four deviations and the collisions to expect, their sum within a share."""
    events = table(spark, d, "events").select("user_id")
    exact, out = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), None
    total, users = events.agg(F.count(F.lit(1)).alias("all")), exact.count()
    for bits, share in ((4, 0.35), (8, 0.1)):
        sketch = CountMinLog.for_keys(users, bits, policy=P)
        got = sketch.estimate(events, "user_id", sketch.stream_state(events, "user_id", seed=bits)).join(exact, "user_id").join(F.broadcast(total))
        error = 4 * sketch.deviation * F.col("n") + 2 + F.col("all") * math.e / sketch.width
        one = got.agg(F.count(F.lit(1)).alias("keys"), (F.sum((F.abs(F.col("estimate") - F.col("n")) > error).cast("long")) <= F.greatest(F.lit(3.0), 0.03 * F.count(F.lit(1)))).alias("within_bound"), (F.abs(F.sum("estimate") - F.sum("n")) <= share * F.sum("n") + 2 * F.count(F.lit(1))).alias("together"))
        one = one.select(F.lit(bits).cast("long").alias("bits"), "keys", "within_bound", "together")
        out = one if out is None else out.unionByName(one)
    return out


def _exact_ones(events: DataFrame, key: list[str], lasts: list[int]) -> DataFrame:
    """Ones among each key's last ticks."""
    newest = Window.partitionBy(*key).orderBy(F.desc("ts"), F.desc("event_id"))
    aged = events.withColumn("_place", F.row_number().over(newest)).filter(F.col("_place") <= max(lasts)).withColumn("_age", F.col("_place") - 1)
    each = aged.select(*key, "_age", "bit", F.explode(F.array(*[F.lit(n).cast("long") for n in lasts])).alias("n")).filter(F.col("_age") < F.col("n"))
    return each.groupBy(*key, "n").agg(F.sum(F.col("bit").cast("long")).alias("exact"))


def _newest(events: DataFrame, n: int) -> DataFrame:
    """The last n events; each task passes on so many at most."""
    return events.orderBy(F.desc("event_id")).limit(n)


def _close() -> F.Column:
    return F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), EPSILON * F.col("exact"))


def _purchases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").alias("bit"), F.lit("all").alias("stream"))


def eh_window_error(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: purchases among each user's last 10, 25 and 50 events, from one histogram, within its error."""
    events = _purchases(spark, d)
    got = windowed.sliding_counts(events, "user_id", "bit", ["ts", "event_id"], max(LASTS), EPSILON, LASTS)
    return got.join(_exact_ones(events, ["user_id"], LASTS), ["user_id", "n"]).select("user_id", "n", "exact", _close().alias("within_bound"))


def eh_one_stream(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: the same for all events as one stream, whose ticks lie in several tasks, and for two states of its halves in a row."""
    events = _purchases(spark, d)
    # Any place about the middle will do, so a summary of bounded size tells it.
    middle = events.agg(F.percentile_approx("event_id", 0.5).alias("m")).first()["m"] or 0
    later = F.coalesce(F.col("event_id") > middle, F.lit(False))  # rows without an id are the oldest
    ranges = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = lambda df: windowed.histograms(df, "stream", "bit", ["event_id"], max(LONG_LASTS), EPSILON, ranges)
    whole, out = held(events), None
    parts = whole.agg(F.countDistinct("part").alias("parts"))
    split = windowed.followed(held(events.filter(~later)), held(events.filter(later)))
    exact = _exact_ones(_newest(events, max(LONG_LASTS)).withColumn("ts", F.lit(0)), ["stream"], LONG_LASTS)
    for name, state in (("whole", whole), ("halves", split)):
        one = windowed.estimates(state, "stream", LONG_LASTS).join(exact, ["stream", "n"]).join(parts)
        one = one.select(F.lit(name).alias("state"), "ticks", "n", "exact", _close().alias("within_bound"), (F.col("parts") > 1).alias("spread"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (quotient_slots, quotient_slot_ops, quotient_refusal, cuckoo_incremental, learned_filter_fit, kll_merged_bound, cml_stream_bound, eh_window_error, eh_one_stream)}

# SQL.


def _placed(source: str, key: str) -> str:
    """shard, f of the keys of a source, with the sizes q and shards of a row z; remainders have 13 bits."""
    return f"SELECT DISTINCT (h >> 40) % shards AS shard, h % (1::BIGINT << (q + 13)) AS f, q FROM (SELECT {sql_hash(key)} AS h FROM {source}), z"


def _sized(n: str) -> str:
    """The row z of a filter for n keys."""
    return f"z AS MATERIALIZED (SELECT shards, greatest(3, ceil(log2(ceil(n / shards / 0.75))))::INT AS q FROM (SELECT n, ceil(n / {SHARD}.0)::BIGINT AS shards FROM (SELECT greatest(1, ({n})) AS n)))"


_Q = "greatest(3, floor(log2(count(*)))::INT - 1)"

ORACLES = {
    "quotient_slots": f"""WITH {_sized('SELECT count(DISTINCT l_orderkey) FROM lineitem')}, p AS ({_placed('lineitem', 'l_orderkey')})
SELECT shard::INT AS shard, count(*) AS pairs, count(DISTINCT f >> 13) AS quotients, 0::BIGINT AS refused, round(count(*) / pow(2, any_value(q)), 6) AS load, true AS within_bound FROM p GROUP BY shard""",
    "quotient_slot_ops": f"""WITH {_sized('SELECT count(*) FROM customer')},
a AS (SELECT shard, f FROM ({_placed("orders WHERE o_orderstatus = 'F'", 'o_custkey')})), b AS (SELECT shard, f FROM ({_placed("orders WHERE o_orderstatus = 'O'", 'o_custkey')})),
e AS (SELECT shard, f FROM ({_placed("orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 0", 'o_custkey')})), r AS (FROM a EXCEPT FROM e),
c AS (SELECT (h >> 40) % shards AS shard, h % (1::BIGINT << (q + 13)) AS f FROM (SELECT {sql_hash('c_custkey')} AS h FROM customer), z)
SELECT (SELECT count(*) FROM (FROM a UNION FROM b)) AS union_pairs, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS intersection_pairs, (SELECT count(*) FROM r) AS rest_pairs, (SELECT count(*) FROM c SEMI JOIN r USING (shard, f)) AS told""",
    "quotient_refusal": f"""WITH z AS (SELECT {_Q} AS q FROM orders), p AS (SELECT count(DISTINCT {sql_hash('o_orderkey')} % (1::BIGINT << (q + 20))) AS n, any_value(q) AS q FROM orders, z)
SELECT 'fixed' AS filter, least(n, floor({FULLEST} * pow(2, q)))::BIGINT AS held, n > floor({FULLEST} * pow(2, q)) AS refuses, true AS within_bound FROM p UNION ALL SELECT 'grows', n, false, true FROM p""",
    "cuckoo_incremental": """SELECT (fi - fe + oi + fr - od)::BIGINT AS n, (fi + oi + fr)::BIGINT AS inserted, (fe + od)::BIGINT AS removed, 0::BIGINT AS missing, true AS was_split, 0::BIGINT AS other_answers, (fi - fe + oi + fr - od)::BIGINT AS found FROM (
SELECT count(*) FILTER (o_orderstatus = 'F') AS fi, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 2 = 0) AS fe, count(*) FILTER (o_orderstatus = 'O') AS oi, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 4 = 0) AS fr, count(*) FILTER (o_orderstatus = 'O' AND o_custkey % 2 = 1) AS od FROM orders)""",
    "learned_filter_fit": "SELECT count(*) FILTER (lang = 'en') AS members, count(*) FILTER (lang = 'en') AS members_found, count(*) FILTER (lang IS NULL OR lang <> 'en') AS strangers, true AS within_bound, true AS smaller FROM documents",
    "kll_merged_bound": f"SELECT event_type, q, n, least, largest, true AS ends, true AS within_bound, true AS merged_within_bound FROM (SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS largest FROM events GROUP BY event_type), (SELECT unnest({PROBABILITIES}::DOUBLE[]) AS q)",
    "cml_stream_bound": "SELECT bits::BIGINT AS bits, count(DISTINCT user_id) AS keys, true AS within_bound, true AS together FROM events, (SELECT unnest([4, 8]) AS bits) GROUP BY bits",
    "eh_window_error": f"SELECT user_id, n::BIGINT AS n, count(*) FILTER (age < n AND event_type = 'purchase') AS exact, true AS within_bound FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age FROM events), (SELECT unnest({LASTS}) AS n) GROUP BY user_id, n",
    "eh_one_stream": f"SELECT state, count(*) AS ticks, n::BIGINT AS n, count(*) FILTER (age < n AND event_type = 'purchase') AS exact, true AS within_bound, true AS spread FROM (SELECT *, row_number() OVER (ORDER BY event_id DESC) - 1 AS age FROM events), (SELECT unnest({LONG_LASTS}) AS n), (SELECT unnest(['whole', 'halves']) AS state) GROUP BY state, n",
}
