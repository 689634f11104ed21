"""A stream that is one key: no task holds all of it."""

from pyspark.sql import functions as F

from quern.plans import updates


def test_newest_ticks_are_chosen_before_they_move(spark):
    events = spark.range(0, 5_000, 1, 8).select(F.lit("all").alias("stream"), F.lit(0).alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 3 == 0).alias("bit"))
    exact = updates._exact_ones(updates._newest(events, 1_000), ["stream"], [50, 1_000])
    plan = exact._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=1000" in plan and plan.index("Window") < plan.index("TakeOrderedAndProject")
    assert {r.n: r.exact for r in exact.collect()} == {n: sum(i % 3 == 0 for i in range(5_000 - n, 5_000)) for n in (50, 1_000)}


def test_events_without_an_id_are_the_oldest_of_both_states(spark, tmp_path):
    rows = [(i if i >= 0 else None, 1, 0, "purchase" if i % 4 == 0 else "view") for i in range(-40, 1_100)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = updates.eh_one_stream(spark, str(tmp_path)).collect()
    assert len(got) == 8 and {r.ticks for r in got} == {1_140} and all(r.within_bound and r.spread for r in got)
