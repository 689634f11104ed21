"""Sketches over streams: mergeable states under event-time windows, and stateful histograms for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType

from quern.functions.hashing import column
from quern.operators.cardinality import HyperLogLog
from quern.operators.frequency import CountMin
from quern.operators.quantiles import DDSketch
from quern.operators.windowed import ExponentialHistogram
from quern.sources.working import path


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """A Parquet file or folder as a stream."""
    # A stream's path must be a folder or a pattern; this pattern matches the path alone.
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(f"{folder[:-1]}[{folder[-1]}]")


def windowed(df: DataFrame, time: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """df with a column window; time may have no zone. Rows later than allowed are left out by aggregates."""
    given = df.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    return given.withColumn("window", F.window("_time", length, slide))


def hll_state(df: DataFrame, sketch: HyperLogLog, key: Column | str, group: list[str]) -> DataFrame:
    return sketch.state(df, key, ["window", *group])


def count_min_state(df: DataFrame, sketch: CountMin, key: str, group: list[str] | None = None) -> DataFrame:
    """Cells from each row: a stream has one aggregate, so keys are not counted first."""
    rows = df.filter(F.col(key).isNotNull()).select("window", *(group or []), F.col(key).alias("_key"))
    cells = sketch._cells(rows)
    return cells.groupBy("window", *(group or []), "row", "cell").agg(F.count(F.lit(1)).alias("count"))


def dd_state(df: DataFrame, sketch: DDSketch, value: Column | str, group: list[str] | None = None) -> DataFrame:
    return sketch.state(df, value, ["window", *(group or [])])


def sliding_counts(df: DataFrame, key: str, bit: Column, order: list[str], window: int, epsilon: float) -> DataFrame:
    """key, ticks, estimate whenever rows of a key arrive; an exponential histogram is kept for each key."""
    kind = dict(df.dtypes)[key]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, sizes, ticks = state.get if state.exists else (0, [], [])
        h = ExponentialHistogram(window, epsilon, clock, list(sizes), list(ticks))
        rows = pd.concat(list(batches)).sort_values([f"o{i}" for i in range(len(order))])
        h.update_all(rows["b"].to_numpy(bool))
        state.update((h.clock, h.sizes, h.ticks))
        yield pd.DataFrame([(keys[0], h.clock, h.estimate(window))], columns=[key, "ticks", "estimate"])

    given = df.select(F.col(key).alias(key), F.coalesce(column(bit), F.lit(False)).alias("b"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    return given.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ticks long, estimate long", "clock long, sizes array<long>, ticks array<long>", "update", GroupStateTimeout.NoTimeout)


def sessions(df: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """df grouped by keys and by sessions: rows of a key that follow each other within the gap. For aggregates of any kind, sketches too."""
    given = df.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    return given.groupBy(*keys, F.session_window("_time", gap).alias("session"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str, where: str | None = None, rocksdb: bool = False) -> DataFrame:
    """Runs the stream over what is there now; its output as a table in the shared folder, never on the driver.

    Each batch has a folder of its own, which a repeated batch writes anew. In complete mode the last one has all rows.
    where: a folder of the caller's; with the same one a later call goes on where the former ended. rocksdb: the state store that
    ``quern.streaming.stateful`` needs.
    """
    spark = stream.sparkSession
    where = where or path(spark, "stream")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch).cast("int")).write.mode("overwrite").parquet(f"{where}/out/{batch}")

    try:
        if rocksdb:
            spark.conf.set(name, ROCKSDB)
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()
    last = (query.lastProgress or {}).get("batchId", 0)
    out = spark.read.schema(stream.schema.add("_batch", IntegerType())).parquet(f"{where}/out/{last}" if mode == "complete" else f"{where}/out/*")
    return out if rocksdb else out.drop("_batch")
