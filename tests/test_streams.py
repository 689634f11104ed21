"""Stateful streams: what they put out, and that a restart from the checkpoint goes on where the stream ended."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.operators.sampling import Reservoir
from quern.sources import working
from quern.streaming import sketches as S
from quern.streaming import stateful as T

ROWS = [(i, f"u{i * i % 17 if i % 3 else 1}", f"2024-01-{1 + i // 250:02} {i % 24:02}:00:00") for i in range(1000)]
SCHEMA = "id long, user string, at string"


def files(spark, parts):
    where = working.path(spark, "rows")
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_timestamp("at")).write.parquet(f"{where}/{k}")
        yield where, k


def stream(spark, where):
    return spark.readStream.schema("id long, user string, at string, ts timestamp").parquet(f"{where}/*")


def restarted(spark, parts, build, mode="update"):
    """Drains a stream after each part arrives, over one checkpoint."""
    out = None
    for where, _ in files(spark, parts):
        out = S.drain(build(stream(spark, where)), mode, where=f"{where}-stream", rocksdb=True)
    return out


@pytest.mark.parametrize("cuts", [(0, 1000), (0, 300, 310, 1000)])
def test_lossy_counts_hold_their_bounds_after_restarts(spark, cuts):
    parts = [ROWS[a:b] for a, b in zip(cuts, cuts[1:])]
    out = T.latest(restarted(spark, parts, lambda s: T.lossy_counts(s, "user", 0.02, 3))).collect()
    exact = Counter(u for _, u, _ in ROWS)
    assert sum(r.seen for r in out if r["item"] is None) == 1000
    held = {r["item"]: r for r in out if r["item"] is not None}
    assert all(r["count"] <= exact[i] <= r["count"] + r.error for i, r in held.items())
    off = {r.shard: r.error for r in out if r["item"] is None}
    assert all(c <= max(off.values()) for i, c in exact.items() if i not in held) and held["u1"]["count"] == exact["u1"]


@pytest.mark.parametrize("cuts", [(0, 1000), (0, 300, 310, 1000)])
def test_reservoir_of_a_stream_is_that_of_the_table(spark, cuts):
    sketch = Reservoir(25, 3)
    out = T.latest(restarted(spark, [ROWS[a:b] for a, b in zip(cuts, cuts[1:])], lambda s: T.reservoir(s, "id", sketch, 3)))
    want = sketch.sample(spark.createDataFrame(ROWS, SCHEMA), "id").select("id", "priority")
    got = out.orderBy("priority").limit(25).select(F.col("item").cast("long").alias("id"), "priority")
    assert got.exceptAll(want).isEmpty() and got.count() == 25 and out.groupBy("shard").agg(F.max("seen").alias("n")).agg(F.sum("n")).first()[0] == 1000


def test_heavy_periods_end_by_their_timers(spark):
    day = 86_400
    out = restarted(spark, [ROWS[:400], ROWS[400:]], lambda s: T.heavy_periods(s, "user", "ts", day, "1 hour", k=30, shards=2), "append").collect()
    periods = {r.period for r in out}
    assert len(periods) == 3  # the last day's timer has not come
    exact = Counter((i // 250, u) for i, u, _ in ROWS)
    for r in out:
        nth = (r.period - min(periods)) // day
        assert r["count"] <= exact[nth, r["item"]] + 1
    assert all((min(periods) + k * day, "u1") in {(r.period, r["item"]) for r in out} for k in range(3))


def test_sessions_close_behind_the_watermark(spark):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:20:00"), (3, "a", "2024-01-01 01:00:00"), (4, "b", "2024-01-01 00:10:00"), (5, "c", "2024-01-02 00:00:00")]
    (where, _), = files(spark, [rows])
    grouped = S.sessions(stream(spark, where), ["user"], "ts", "30 minutes", "1 hour")
    out = S.drain(grouped.agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("id", F.lit(10)).alias("ids")), "append")
    got = {(r.user, r.session.start.hour, r.n, r.e) for r in out.withColumn("e", F.hll_sketch_estimate("ids")).collect()}
    assert got == {("a", 0, 2, 2), ("a", 1, 1, 1), ("b", 0, 1, 1)}
