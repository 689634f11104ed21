"""Queries of membership filters, with SQL that gives the same rows.

Each docstring names how the two agree: exact (the sketch's own formula is written in both), verified (the sketch
narrows down, an exact step decides) or bounded (a computed comparison with the exact value holds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import bits as B
from quern.functions.hashing import key_hash, row_hash
from quern.operators import membership as M
from quern.operators.static_filters import BinaryFuse, CuckooFilter, Ribbon, Sharded, Xor
from quern.sources.tables import table
from quern.sources.working import written

P = "md5_60"


def sql_hash(text: str) -> str:
    return f"('0x' || substr(md5(({text})::VARCHAR), 1, 15))::BIGINT"


def sql_positions(source: str, key: str, k: int, m: int, keep: str = "") -> str:
    """The positions of each key of source, as rows (keep, bit)."""
    keep = keep and keep + ", "
    return f"SELECT {keep}((h % 1073741824) + i * ((h >> 30) | 1)) % {m} AS bit FROM (SELECT {keep}{sql_hash(key)} AS h FROM {source}) hashed, (SELECT unnest(range(0, {k})) AS i) steps"


def sql_sized(n: str, fpr: float) -> str:
    """The row z of a Bloom filter's m and k for n keys."""
    return f"z AS MATERIALIZED (SELECT m, greatest(1, round(m::DOUBLE / n * ln(2)))::BIGINT AS k FROM (SELECT n, pow(2, ceil(log2(greatest(64, ceil(-n * ln({fpr}::DOUBLE) / (ln(2) * ln(2)))))))::BIGINT AS m FROM (SELECT greatest(1, ({n})) AS n)))"


def sql_placed(source: str, key: str, keep: str = "") -> str:
    """As sql_positions, with the size of the row z."""
    keep = keep and keep + ", "
    return f"SELECT {keep}((h % 1073741824) + i * ((h >> 30) | 1)) % m AS bit FROM (SELECT {keep}m, h, unnest(range(0, k)) AS i FROM (SELECT {keep}{sql_hash(key)} AS h FROM {source}) hashed, z)"


BRANDS = M.Bloom.sized(200, 0.01, P)
ORDERS = M.Bloom.sized(20_000, 0.01, P)
CUSTOMERS = M.Bloom.sized(2_000, 0.01, P)
#: Rates of the filters that are sized from their data.
RATE, COUNTING_RATE = 0.01, 0.05
SCALABLE = M.Scalable(20, 0.01, policy=P)
BLOCKED = M.Blocked.sized(1_500, 0.01, P)
#: Bits of the vectors.
VECTOR = 4096


def hash_policies(spark: SparkSession, d: str) -> DataFrame:
    """Exact: the portable hash and its row family."""
    brands = table(spark, d, "part").select("p_brand").distinct()
    return brands.select("p_brand", key_hash("p_brand", P).alias("h"), *[row_hash("p_brand", i, P).alias(f"h{i}") for i in range(3)])


def bloom_state_bits(spark: SparkSession, d: str) -> DataFrame:
    """Exact: bits set for each brand."""
    bits = BRANDS.bits(table(spark, d, "part"), "p_partkey", ["p_brand"])
    return BRANDS.stats(bits, ["p_brand"]).select("p_brand", "bits_set", F.round("fill_ratio", 6).alias("fill_ratio"))


def bloom_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Verified; and whether of the lines of other orders no more passed the filter, sized from the orders, than two and a half times its rate, or 10."""
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    size = M.Bloom.sized(max(1, urgent.count()), RATE, P)
    told = size.maybe(lines, "l_orderkey", size.bits(urgent, "o_orderkey")).groupBy("l_orderkey", "l_returnflag", "maybe").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    both = told.join(urgent.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("member")), "l_orderkey", "left")
    member = F.coalesce("member", F.lit(False))
    out = both.groupBy("l_returnflag").agg(F.sum(F.when(member & F.col("maybe"), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(member & F.col("maybe"), F.col("quantity")).otherwise(0.0)).alias("quantity"), F.sum(F.when(~member, F.col("n")).otherwise(0)).alias("_others"), F.sum(F.when(~member & F.col("maybe"), F.col("n")).otherwise(0)).alias("_passed"))
    return out.select("l_returnflag", "n", "quantity", (F.col("_passed") <= F.greatest(F.lit(10.0), 2.5 * RATE * F.col("_others"))).alias("within_bound"))


def bit_vector_ops(spark: SparkSession, d: str) -> DataFrame:
    """Exact: ones of two packed vectors, one for each order status, of their bitwise or and and, and of the bits read back."""
    orders = table(spark, d, "orders")
    a, b = (B.packed(orders.filter(F.col("o_orderstatus") == s).select((key_hash("o_custkey", P) % VECTOR).alias("p")), "p") for s in "FO")
    vectors = {"a": a, "b": b, "or": B.either(a, b), "and": B.both(a, b)}
    out = None
    for name, v in vectors.items():
        one = B.count(v).select(F.lit(name).alias("vector"), "ones").join(B.positions(v).agg(F.count(F.lit(1)).alias("positions"), F.max("position").alias("last")))
        out = one if out is None else out.unionByName(one)
    return out


def counting_bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    """Exact: orders that a counting filter of finished ones tells, and counters after those of urgent ones that it may hold were removed."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    finished = orders.filter("o_orderstatus = 'F'")
    size = M.Bloom.sized(max(1, finished.count()), COUNTING_RATE, P)
    state = written(M.counting(size, finished, "o_orderkey"), "counting")
    rest, asked = M.counting_remove(size, state, orders.filter("o_orderpriority = '1-URGENT'"), "o_orderkey")
    told = M.counting_maybe(size, orders, "o_orderkey", state).agg(F.sum(F.col("maybe").cast("long")).alias("told"))
    return told.join(asked.agg(F.sum(F.col("removed").cast("long")).alias("removed"))).join(M.counting_stats(size, rest).select(F.col("used").alias("counters_left")))


def bloom_union_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Exact."""
    orders = table(spark, d, "orders")
    a, b = (CUSTOMERS.bits(orders.filter(F.col("o_orderstatus") == s), "o_custkey") for s in "FO")
    both = M.union(a, b).agg(F.count(F.lit(1)).alias("union_bits"))
    return both.join(M.intersection(a, b).agg(F.count(F.lit(1)).alias("intersection_bits")))


def bloom_fpr_check(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: no member is missed, strangers pass at most 2.5 times as often as the state's fill predicts, or 10 of them."""
    orders = table(spark, d, "orders").select("o_orderkey")
    size = M.Bloom.sized(max(1, orders.count()), 0.01, P)
    bits = size.bits(orders, "o_orderkey")
    probes = orders.withColumn("member", F.lit(True)).unionByName(orders.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit(False).alias("member")))
    got = size.maybe(probes, "o_orderkey", bits).groupBy().agg(
        F.sum(F.col("member").cast("long")).alias("members"),
        F.sum((F.col("member") & F.col("maybe")).cast("long")).alias("members_found"),
        F.sum((~F.col("member") & F.col("maybe")).cast("long")).alias("_false"),
    )
    return got.join(size.stats(bits).select("expected_fpr")).select("members", "members_found", (F.col("_false") <= F.greatest(F.lit(10.0), 2.5 * F.col("expected_fpr") * F.col("members"))).alias("within_bound"))


def counting_bloom_delete(spark: SparkSession, d: str) -> DataFrame:
    """Exact: counters after all orders of lineitem were inserted and returned ones removed."""
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    lines = table(spark, d, "lineitem")
    both = lines.select("l_orderkey", F.lit(1).alias("s")).unionByName(lines.filter(sign < 0).select("l_orderkey", F.lit(-1).alias("s")))
    size = M.Bloom.sized(max(1, table(spark, d, "orders").count()), COUNTING_RATE, P)
    state = M.counting(size, both, "l_orderkey", sign=F.col("s"))
    return state.agg(F.count(F.lit(1)).alias("used"), F.sum("count").cast("long").alias("total"), F.max("count").cast("long").alias("largest"))


def scalable_bloom_stages(spark: SparkSession, d: str) -> DataFrame:
    """Exact: bits set in each stage, users in the order of their first event."""
    events = table(spark, d, "events")
    return SCALABLE.bits(events, "user_id", [F.col("ts"), F.col("event_id")]).groupBy("stage").agg(F.count(F.lit(1)).alias("bits_set"))


def blocked_bloom_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Exact: bits set in each block."""
    return BLOCKED.state(table(spark, d, "customer"), "c_custkey").groupBy("block").agg(F.count(F.lit(1)).alias("bits_set"))


def quotient_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Exact: pairs, and how full a table sized from the orders is."""
    quotient = M.Quotient.sized(max(1, table(spark, d, "orders").count()), policy=P)
    state = quotient.state(table(spark, d, "lineitem"), "l_orderkey")
    return state.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("q").alias("quotients"), F.round(F.count(F.lit(1)) / quotient.slots, 6).alias("load"))


def quotient_set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Exact: union and intersection of two filters, and one after deletion of the other's keys."""
    orders = table(spark, d, "orders")
    quotient = M.Quotient.sized(max(1, table(spark, d, "customer").count()), policy=P)
    a, b = (quotient.state(orders.filter(F.col("o_orderstatus") == s), "o_custkey") for s in "FO")
    rest = quotient.remove(a, orders.filter("o_orderstatus = 'O'"), "o_custkey")
    out = M.union(a, b).agg(F.count(F.lit(1)).alias("union_pairs")).join(M.intersection(a, b).agg(F.count(F.lit(1)).alias("intersection_pairs")))
    return out.join(rest.agg(F.count(F.lit(1)).alias("rest_pairs")))


def learned_bloom_filter(spark: SparkSession, d: str) -> DataFrame:
    """Verified: parts of returned lines; the classifier takes dear parts, a Bloom filter backs it up."""
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    parts = table(spark, d, "part")
    dear = F.col("p_retailprice") > 1500
    members = parts.join(returned, "p_partkey", "left_semi")
    backup = M.Bloom.sized(max(1, members.filter(~dear).count()), RATE, P)
    bits = M.learned_state(members, "p_partkey", dear, backup)
    rest = M.learned_maybe(parts, "p_partkey", dear, backup, bits).filter("maybe").join(returned, "p_partkey", "left_semi")
    return rest.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


def _static_join(filter_):
    def query(spark: SparkSession, d: str) -> DataFrame:
        """Verified."""
        urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey")
        rows = Sharded.over(filter_, urgent.count(), P).semi_join(table(spark, d, "lineitem"), "l_orderkey", urgent, "o_orderkey")
        return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))

    return query


def cuckoo_delete(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: after finished orders were deleted all others are found, and of the deleted no more than fingerprints allow."""
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("gone"))
    filter_ = Sharded.over(CuckooFilter(0.04), max(1, orders.count()), P)
    state = filter_.state(orders, "o_orderkey", orders.filter("gone").select("o_orderkey"))
    got = filter_.maybe(orders, "o_orderkey", state).agg(F.sum((~F.col("gone")).cast("long")).alias("kept"), F.sum((~F.col("gone") & F.col("maybe")).cast("long")).alias("kept_found"), F.sum(F.col("gone").cast("long")).alias("removed"), F.sum((F.col("gone") & F.col("maybe")).cast("long")).alias("_false"))
    return got.select("kept", "kept_found", "removed", (F.col("_false") <= F.greatest(F.lit(10.0), 3 * 8 / 256 * F.col("removed"))).alias("within_bound"))


def static_filter_fpr(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: no key is missed; strangers pass at most twice as often as fingerprints allow, or 10 of them."""
    orders = table(spark, d, "orders").select("o_orderkey")
    probes = orders.withColumn("member", F.lit(True)).unionByName(orders.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit(False).alias("member")))
    n, out = max(1, orders.count()), None
    for name, f in (("binary_fuse_8", BinaryFuse()), ("xor_8", Xor()), ("xor_16", Xor(16)), ("ribbon_8_64", Ribbon()), ("ribbon_16_128", Ribbon(16, 128))):
        filter_ = Sharded.over(f, n, P)
        one = filter_.maybe(probes, "o_orderkey", filter_.state(orders, "o_orderkey")).agg(F.sum((F.col("member") & F.col("maybe")).cast("long")).alias("members_found"), F.sum((~F.col("member") & F.col("maybe")).cast("long")).alias("_false"))
        one = one.select(F.lit(name).alias("filter"), "members_found", (F.col("_false") <= max(10.0, 2 * f.fpr * n)).alias("within_bound"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (hash_policies, bit_vector_ops, bloom_state_bits, bloom_semi_join, bloom_union_intersect, bloom_fpr_check, counting_bloom_delete, counting_bloom_probe, scalable_bloom_stages, blocked_bloom_blocks, quotient_pairs, quotient_set_ops, learned_bloom_filter, cuckoo_delete, static_filter_fpr)}
QUERIES |= {"cuckoo_semi_join": _static_join(CuckooFilter()), "fuse_semi_join": _static_join(BinaryFuse()), "xor_semi_join": _static_join(Xor()), "ribbon_semi_join": _static_join(Ribbon())}

_SEMI = "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY l_returnflag"


def _customers(status: str) -> str:
    return "SELECT DISTINCT bit FROM (" + sql_positions(f"(SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = '{status}') keys_{status}", "o_custkey", CUSTOMERS.k, CUSTOMERS.m) + ")"


def _pairs(source: str, key: str) -> str:
    return f"SELECT DISTINCT (h >> 13) % slots AS q, h % 8192 AS r, slots FROM (SELECT {sql_hash(key)} AS h FROM {source}), s"


def _slots(n: str) -> str:
    """The row s of a quotient filter's slots for n keys."""
    return f"s AS MATERIALIZED (SELECT greatest(8, pow(2, ceil(log2(ceil(greatest(1, ({n})) / 0.75)))))::BIGINT AS slots)"


def _stages() -> str:
    rows, total = [], 0
    for i in range(16):
        f = SCALABLE.filter(i)
        rows.append(f"({i}, {total}, {total + SCALABLE.capacity(i)}, {f.m}, {f.k})")
        total += SCALABLE.capacity(i)
    return ", ".join(rows)


ORACLES = {
    "hash_policies": f"SELECT p_brand, {sql_hash('p_brand')} AS h, " + ", ".join(f"""{sql_hash(f"p_brand || '#{i}'")} AS h{i}""" for i in range(3)) + " FROM (SELECT DISTINCT p_brand FROM part)",
    "bloom_state_bits": f"SELECT p_brand, count(*) AS bits_set, round(count(*) / {BRANDS.m}.0, 6) AS fill_ratio FROM (SELECT DISTINCT p_brand, bit FROM ({sql_positions('part', 'p_partkey', BRANDS.k, BRANDS.m, 'p_brand')})) GROUP BY p_brand",
    "bloom_semi_join": _SEMI.replace("AS quantity FROM", "AS quantity, true AS within_bound FROM"),
    **dict.fromkeys(("cuckoo_semi_join", "fuse_semi_join", "xor_semi_join", "ribbon_semi_join"), _SEMI),
    "bloom_union_intersect": f"SELECT (SELECT count(*) FROM ({_customers('F')} UNION {_customers('O')})) AS union_bits, (SELECT count(*) FROM ({_customers('F')} INTERSECT {_customers('O')})) AS intersection_bits",
    "bit_vector_ops": "WITH a AS ({a}), b AS ({b}) ".format(**{x: f"SELECT DISTINCT {sql_hash('o_custkey')} % {VECTOR} AS p FROM orders WHERE o_orderstatus = '{s}'" for x, s in (("a", "F"), ("b", "O"))})
    + "SELECT vector, count(*) AS ones, count(*) AS positions, max(p) AS last FROM (SELECT 'a' AS vector, p FROM a UNION ALL SELECT 'b', p FROM b UNION ALL SELECT 'or', p FROM (FROM a UNION FROM b) UNION ALL SELECT 'and', p FROM (FROM a INTERSECT FROM b)) GROUP BY vector",
    "counting_bloom_probe": f"""WITH {sql_sized("SELECT count(*) FROM orders WHERE o_orderstatus = 'F'", COUNTING_RATE)},
s AS (SELECT bit, count(*) AS n FROM ({sql_placed("(SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F') f", 'o_orderkey')}) GROUP BY bit),
q AS ({sql_placed('orders', 'o_orderkey', 'o_orderkey, o_orderpriority')}),
t AS (SELECT o_orderkey, any_value(o_orderpriority) AS p, count(DISTINCT bit) = count(DISTINCT s.bit) AS hit FROM (SELECT q.*, s.bit AS found FROM q LEFT JOIN s USING (bit)) q LEFT JOIN s USING (bit) GROUP BY o_orderkey),
g AS (SELECT bit, count(*) AS n FROM q JOIN t USING (o_orderkey) WHERE hit AND p = '1-URGENT' GROUP BY bit)
SELECT (SELECT count(*) FROM t WHERE hit) AS told, (SELECT count(*) FROM t WHERE hit AND p = '1-URGENT') AS removed, (SELECT count(*) FROM s LEFT JOIN g USING (bit) WHERE s.n > coalesce(g.n, 0)) AS counters_left""",
    "bloom_fpr_check": "SELECT count(*)::BIGINT AS members, count(*)::BIGINT AS members_found, true AS within_bound FROM orders",
    "counting_bloom_delete": f"""WITH {sql_sized('SELECT count(*) FROM orders', COUNTING_RATE)}, o AS (SELECT l_orderkey, count(*) AS up, count(*) FILTER (l_returnflag = 'R') AS down FROM lineitem GROUP BY l_orderkey),
c AS (SELECT bit, sum(up) AS up, sum(down) AS down FROM ({sql_placed('o', 'l_orderkey', 'up, down')}) GROUP BY bit),
v AS (SELECT CASE WHEN up >= 255 THEN 255 ELSE greatest(up - down, 0) END AS n FROM c)
SELECT count(*)::BIGINT AS used, sum(n)::BIGINT AS total, max(n)::BIGINT AS largest FROM v WHERE n > 0""",
    "scalable_bloom_stages": f"""WITH s(stage, lo, hi, m, k) AS (VALUES {_stages()}),
u AS (SELECT user_id, row_number() OVER (ORDER BY f.ts, f.event_id, user_id) AS n FROM (SELECT user_id, min(struct_pack(ts := ts, event_id := event_id)) AS f FROM events GROUP BY user_id)),
p AS (SELECT stage, m, k, {sql_hash('user_id')} AS h FROM u JOIN s ON n > lo AND n <= hi)
SELECT stage, count(DISTINCT bit) AS bits_set FROM (SELECT stage, ((h % 1073741824) + i * ((h >> 30) | 1)) % m AS bit FROM (SELECT *, unnest(range(0, k)) AS i FROM p)) GROUP BY stage""",
    "blocked_bloom_blocks": f"""SELECT block, count(DISTINCT bit) AS bits_set FROM (SELECT (h % 1073741824) % {BLOCKED.blocks} AS block, ((h % 1073741824) // {BLOCKED.blocks} + i * ((h >> 30) | 1)) % 512 AS bit
FROM (SELECT {sql_hash('c_custkey')} AS h FROM customer), (SELECT unnest(range(0, {BLOCKED.k})) AS i)) GROUP BY block""",
    "quotient_pairs": f"WITH {_slots('SELECT count(*) FROM orders')} SELECT count(*) AS pairs, count(DISTINCT q) AS quotients, round(count(*) / any_value(slots)::DOUBLE, 6) AS load FROM ({_pairs('lineitem', 'l_orderkey')})",
    "quotient_set_ops": f"WITH {_slots('SELECT count(*) FROM customer')}, " + "a AS ({a}), b AS ({b}) SELECT (SELECT count(*) FROM (FROM a UNION FROM b)) AS union_pairs, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS intersection_pairs, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS rest_pairs".format(
        a=_pairs("orders WHERE o_orderstatus = 'F'", "o_custkey"), b=_pairs("orders WHERE o_orderstatus = 'O'", "o_custkey")
    ),
    "learned_bloom_filter": "SELECT p_brand, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY p_brand",
    "cuckoo_delete": "SELECT count(*) FILTER (o_orderstatus <> 'F') AS kept, count(*) FILTER (o_orderstatus <> 'F') AS kept_found, count(*) FILTER (o_orderstatus = 'F') AS removed, true AS within_bound FROM orders",
    "static_filter_fpr": "SELECT filter, n AS members_found, true AS within_bound FROM (SELECT count(*) AS n FROM orders), (SELECT unnest(['binary_fuse_8', 'xor_8', 'xor_16', 'ribbon_8_64', 'ribbon_16_128']) AS filter)",
}
