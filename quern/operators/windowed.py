"""Counts over a sliding window of ticks: exponential histograms of ranges of each key's ticks, side by side."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import params
from quern.sources.working import written


class ExponentialHistogram:
    """Ones among the last ``window`` ticks with a relative error of at most epsilon.

    Buckets hold powers of two of ones and the tick of their newest; of each size at most a bounded number. Single ones are twice as
    many, so that a bucket of size s that reaches over the edge, wrong by s / 2 at most, has s / (2 * epsilon) newer ones behind it.
    """

    def __init__(self, window: int, epsilon: float, clock: int = 0, sizes: list[int] | None = None, ticks: list[int] | None = None):
        if window < 1 or not 0 < epsilon <= 1:
            raise ValueError("window must be positive, epsilon in (0, 1]")
        self.window, self.epsilon, self.clock = window, epsilon, clock
        self.most = max(2, math.ceil(math.ceil(1 / epsilon) / 2) + 1)
        self.singles = max(2, math.ceil(1 / epsilon) + 1)
        self.levels: list[deque[int]] = []  # of each size 2^i the buckets' ticks, oldest first; larger buckets are older
        for size, tick in zip(sizes or [], ticks or []):
            self._level(size.bit_length() - 1).append(tick)

    def _level(self, i: int) -> deque[int]:
        while len(self.levels) <= i:
            self.levels.append(deque())
        return self.levels[i]

    @property
    def sizes(self) -> list[int]:
        """Oldest first."""
        return [1 << i for i in reversed(range(len(self.levels))) for _ in self.levels[i]]

    @property
    def ticks(self) -> list[int]:
        return [t for level in reversed(self.levels) for t in level]

    def skip(self, ticks: int) -> None:
        """So many ticks without a one."""
        self.clock += ticks
        edge = self.clock - self.window
        while self.levels:
            while self.levels[-1] and self.levels[-1][0] <= edge:
                self.levels[-1].popleft()
            if self.levels[-1]:
                return
            self.levels.pop()

    def update(self, bit: bool) -> None:
        self.skip(1)
        if bit:
            self._level(0).append(self.clock)
            i = 0
            while len(self.levels[i]) > (self.most if i else self.singles):
                self.levels[i].popleft()
                self._level(i + 1).append(self.levels[i].popleft())  # the two oldest, by the tick of the newer one
                i += 1

    def update_all(self, bits: np.ndarray) -> None:
        """As one by one; only ones cost work."""
        at = 0
        for k in np.flatnonzero(bits).tolist():
            if k > at:
                self.skip(k - at)
            self.update(True)
            at = k + 1
        if len(bits) > at:
            self.skip(len(bits) - at)

    def estimate(self, n: int) -> int:
        """Ones among the last n ticks; half of the bucket that reaches over the edge."""
        if not 0 < n <= self.window:
            raise ValueError("n must lie in 1..window")
        inside = [s for s, t in zip(self.sizes, self.ticks) if t > self.clock - n]
        if not inside:
            return 0
        whole = n >= self.clock  # the window covers all that came
        return sum(inside) if whole or inside[0] == 1 else sum(inside[1:]) + inside[0] // 2


def histograms(df: DataFrame, key: str, bit: str, order: list[str], window: int, epsilon: float, ranges: int | None = None) -> DataFrame:
    """State: key, part, ticks, sizes, ends. Rows are dealt over ranges of key and order, so a key's ticks lie in as many tasks as they need.

    A range has the histogram of its own ticks: sizes of buckets, oldest first, and the place of the newest one of each. As a bucket
    is large only where its own range has many newer ones, histograms side by side keep the error of a single one.
    """
    ExponentialHistogram(window, epsilon)
    kind, count = dict(df.dtypes)[key], ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["k", "part", "ticks", "sizes", "ends"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, part = None, None, 0
        row = lambda: (current, part, state.clock, state.sizes, state.ticks)
        for batch in batches:
            done: list[tuple] = []
            keys, bits = batch["k"].to_numpy(), batch["b"].to_numpy(bool)
            part = int(batch["p"].iloc[0]) if len(batch) else part
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
            for a, b in zip(first, [*first[1:], len(keys)]):
                if state is None or keys[a] != current:
                    if state is not None:
                        done.append(row())
                    current, state = keys[a], ExponentialHistogram(window, epsilon)
                state.update_all(bits[a:b])
            yield pd.DataFrame(done, columns=names)
        if state is not None:
            yield pd.DataFrame([row()], columns=names)

    places = [f"o{i}" for i in range(len(order))]
    given = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.coalesce(F.col(bit), F.lit(False)).alias("b"), *[F.col(c).alias(o) for c, o in zip(order, places)])
    rows = given.repartitionByRange(count, "k", *places).sortWithinPartitions("k", *places).select("k", "b", F.spark_partition_id().alias("p"))
    parts = written(rows.mapInPandas(run, f"k {kind}, part int, ticks long, sizes array<long>, ends array<long>"), "histograms")
    return parts.select(F.col("k").alias(key), params.tagged(F.col("part"), "part", (window, epsilon)), "ticks", "sizes", "ends")


def followed(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """The state of a stream whose first part has the one state and whose rest the other; raises MismatchError where window or error differ."""
    params.same([earlier, later], "part")
    last = earlier.agg(F.coalesce(F.max("part") + 1, F.lit(0)).alias("_more"))
    names = earlier.columns
    moved = later.crossJoin(last).withColumn("_part", F.col("part") + F.col("_more")).drop("part", "_more").withColumnRenamed("_part", "part")
    return earlier.unionByName(moved.select(*names))


def estimates(state: DataFrame, key: str, last: list[int]) -> DataFrame:
    """key, ticks, n, estimate: ones among the last n ticks; half of the bucket that reaches over the edge."""
    order = Window.partitionBy(key).orderBy("part")  # a row for each range that has the key
    later = F.coalesce(F.sum("ticks").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    placed = state.withColumn("_after", later).withColumn("_clock", F.sum("ticks").over(Window.partitionBy(key)))
    # Age of a bucket's newest one, and what the age of its oldest one is at most.
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("ends", i - 1))
    ages = F.transform("sizes", lambda size, i: F.named_struct(F.lit("size"), size, F.lit("newest"), F.col("_after") + F.col("ticks") - F.get("ends", i), F.lit("oldest"), F.col("_after") + F.col("ticks") - before(i) - 1))
    each = placed.select(key, "_clock", F.explode(F.array(*[F.lit(n).cast("long") for n in last])).alias("n"), ages.alias("_b"))
    ones = lambda n: F.aggregate(F.filter("_b", lambda b: b["newest"] < n), F.lit(0).cast("long"), lambda t, b: t + F.when((b["oldest"] >= n) & (b["size"] > 1), F.floor(b["size"] / 2)).otherwise(b["size"]))
    return each.groupBy(key, F.col("_clock").alias("ticks"), "n").agg(F.sum(ones(F.col("n"))).alias("estimate"))


def sliding_counts(df: DataFrame, key: str, bit: str, order: list[str], window: int, epsilon: float, last: list[int] | None = None) -> DataFrame:
    """key, ticks, estimate after the last row of each key.

    last: numbers of ticks, window at most; then there is a row for each of them, with n besides.
    """
    if last is not None and not all(0 < n <= window for n in last):
        raise ValueError("n must lie in 1..window")
    out = estimates(histograms(df, key, bit, order, window, epsilon), key, last or [window])
    return out if last else out.drop("n")
