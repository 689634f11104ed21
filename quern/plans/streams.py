"""Queries of streams with states of their own, sessions and late rows, with SQL.

Docstrings: exact, verified or bounded, as in ``sets``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.sampling import Reservoir
from quern.plans.sets import P, sql_hash
from quern.sources.tables import table
from quern.sources.working import path
from quern.streaming import sketches as S
from quern.streaming import stateful as T

RESERVOIR = Reservoir(20, 7, P)
EPSILON, SUPPORT = 0.002, 0.008
WEEK, TOP = 7 * 86_400, 5
#: Users of a shard of a week's sketch, about: half of the cells in one of its rows.
USERS = 512
#: Minutes between two events of a session, and by how much rows may be late.
GAP, LATE = 360, "1 hour"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.read_files(spark, f"{d}/events.parquet")


def stream_lossy_hitters(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: exact counts of users with at least 0.8 % of the events, whether the stream's shards hold them, and within their errors."""
    out = T.latest(S.drain(T.lossy_counts(_events(spark, d), "user_id", EPSILON), "update", rocksdb=True))
    exact = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    total = exact.agg(F.sum("n").alias("all"))
    heads = out.filter("item IS NULL").select("shard", "seen")
    seen = heads.agg(F.sum("seen").alias("seen"))
    heavy = exact.join(total).filter(F.col("n") >= SUPPORT * F.col("all"))
    both = heavy.join(out.filter("item IS NOT NULL").select("item", "count", "error"), "item", "left").join(seen)
    within = (F.col("count") <= F.col("n")) & (F.col("n") <= F.col("count") + F.col("error"))
    return both.select("item", "n", F.coalesce(within & (F.col("seen") == F.col("all")), F.lit(False)).alias("within_bound"))


def stream_reservoir(spark: SparkSession, d: str) -> DataFrame:
    """Exact: the sample of all events, from the shards of a stream."""
    out = T.latest(S.drain(T.reservoir(_events(spark, d), "event_id", RESERVOIR), "update", rocksdb=True))
    return out.orderBy("priority", "item").limit(RESERVOIR.k).select(F.col("item").cast("long").alias("event_id"), "priority")


def stream_heavy_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Bounded: of each week that ended before the last event's lateness the five users with most events, counted exactly, and whether the week's timer put out three of them at least."""
    users = table(spark, d, "events").select("user_id").distinct().count()
    shards = max(T.SHARDS, -(-users // USERS))
    out = S.drain(T.heavy_periods(_events(spark, d), "user_id", "ts", WEEK, LATE, shards=shards), "append", rocksdb=True).select("period", "item", F.lit(1).alias("hit")).distinct()
    events = table(spark, d, "events").select((F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / WEEK) * WEEK).alias("period"), F.col("user_id").cast("string").alias("item"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    closed = events.agg((F.max("t") - 3600).alias("mark"))
    counts = events.groupBy("period", "item").count().join(closed).filter(F.col("period") + WEEK <= F.col("mark"))
    top = counts.withColumn("place", F.expr("row_number() OVER (PARTITION BY period ORDER BY count DESC, item)")).filter(F.col("place") <= TOP)
    found = top.join(out, ["period", "item"], "left")
    weeks = found.groupBy("period").agg((F.count("hit") >= 3).alias("within_bound"))
    return found.join(weeks, "period").select("period", "item", "count", "within_bound")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Exact: sessions of users that the watermark has closed: events, types by Spark's HyperLogLog, and the largest value."""
    grouped = S.sessions(_events(spark, d), ["user_id"], "ts", f"{GAP} minutes", LATE)
    state = grouped.agg(F.count(F.lit(1)).alias("events"), F.hll_sketch_agg("event_type", F.lit(12)).alias("types"), F.max("value").alias("largest"))
    out = S.drain(state, "append")
    return out.select("user_id", F.unix_timestamp("session.start").alias("start"), "events", F.hll_sketch_estimate("types").alias("types"), F.round("largest", 6).alias("largest"))


def stream_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Exact: of two files, the events of the later half of the time before those of the earlier one, what daily windows kept and what came too late for them."""
    events = table(spark, d, "events").select("event_id", "ts")
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    middle = events.agg(F.floor((F.min(second) + F.max(second)) / 2).alias("m")).first()["m"] or 0
    where = path(spark, "late")
    for name, part in ((0, events.filter(second >= middle)), (1, events.filter(second < middle))):
        part.write.parquet(f"{where}/rows/{name}")
        # A run for each file, one after the other, over one checkpoint.
        stream = spark.readStream.schema(events.schema).parquet(f"{where}/rows/*")
        S.drain(S.windowed(stream, "ts", "1 day", LATE).groupBy("window").agg(F.count(F.lit(1)).alias("kept")), "update", where=f"{where}/stream")
    out = spark.read.parquet(f"{where}/stream/out/*")
    kept = out.groupBy("window").agg(F.max("kept").alias("kept")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "kept")
    every = events.groupBy(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(kept, "day", "left").select("day", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("late"))


QUERIES = {f.__name__: f for f in (stream_lossy_hitters, stream_reservoir, stream_heavy_weeks, stream_sessions, stream_late_rows)}

ORACLES = {
    "stream_lossy_hitters": f"SELECT user_id::VARCHAR AS item, count(*) AS n, true AS within_bound FROM events GROUP BY user_id HAVING count(*) >= {SUPPORT} * (SELECT count(*) FROM events)",
    "stream_reservoir": f"""SELECT event_id, {sql_hash("event_id::VARCHAR || '#7'")} AS priority FROM events ORDER BY priority, event_id::VARCHAR LIMIT {RESERVOIR.k}""",
    "stream_heavy_weeks": f"""WITH e AS (SELECT floor(epoch(ts) / {WEEK})::BIGINT * {WEEK} AS period, user_id::VARCHAR AS item FROM events),
c AS (SELECT period, item, count(*) AS count FROM e GROUP BY ALL), m AS (SELECT floor(epoch(max(ts)))::BIGINT - 3600 AS mark FROM events)
SELECT period, item, count, true AS within_bound FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY count DESC, item) AS k FROM c, m WHERE period + {WEEK} <= mark) WHERE k <= {TOP}""",
    "stream_sessions": f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL {GAP} MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS events, count(DISTINCT event_type) AS types, round(max(value), 6) AS largest FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL {GAP} MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_late_rows": """WITH m AS (SELECT (floor(epoch(min(ts))) + floor(epoch(max(ts))))::BIGINT // 2 AS m, max(ts) - INTERVAL 1 HOUR AS mark FROM events), e AS (SELECT ts, date_trunc('day', ts) AS day, floor(epoch(ts)) < m AND date_trunc('day', ts) + INTERVAL 1 DAY <= mark AS late FROM events, m)
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (NOT late) AS kept, count(*) FILTER (late) AS late FROM e GROUP BY day""",
}
