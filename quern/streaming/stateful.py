"""Sketches with state of their own over streams: lossy counting, reservoirs and HeavyKeeper as stateful processors.

Keys are dealt over shards by hash, so a shard's state is bounded and no task holds them all: an item's rows all come to one shard, whose
summary tells of it what one summary of all rows would. State lives in maps and lists of the state store, so a stream that restarts from its
checkpoint goes on with it. Each batch puts out what its shards hold; ``latest`` keeps the last word of each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.functions.hashing import column
from quern.operators.heavy import HeavyKeeperSketch, LossyCounter
from quern.operators.sampling import Reservoir

SHARDS = 8


def _sharded(df: DataFrame, key: Column | str, shards: int, *more: Column) -> DataFrame:
    item = column(key).cast("string")
    return df.filter(item.isNotNull()).select(F.pmod(F.xxhash64(item), F.lit(shards)).cast("int").alias("shard"), item.alias("item"), *more)


def latest(out: DataFrame) -> DataFrame:
    """Of what a drained stream has put out, batch by batch, the last rows of each shard."""
    last = out.groupBy("shard").agg(F.max("_batch").alias("_batch"))  # a row for each shard
    return out.join(last, ["shard", "_batch"]).drop("_batch")


class _Lossy(StatefulProcessor):
    def __init__(self, epsilon: float):
        self.epsilon = epsilon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "item string", "count long, error long")
        self.seen = handle.getValueState("seen", "seen long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        counter = LossyCounter(self.epsilon)
        counter.seen = self.seen.get()[0] if self.seen.exists() else 0
        counter.held = before = {k[0]: (v[0], v[1]) for k, v in self.held.iterator()}
        before = dict(before)
        for batch in rows:
            counter.insert_all(batch["item"].tolist())
        for item in before.keys() - counter.held.keys():
            self.held.removeKey((item,))
        for item, value in counter.held.items():
            if before.get(item) != value:
                self.held.updateValue((item,), value)
        self.seen.update((counter.seen,))
        entries = [(key[0], i, c, e, counter.seen) for i, (c, e) in counter.held.items()]
        yield pd.DataFrame([(key[0], None, 0, counter.seen // counter.window, counter.seen), *entries], columns=["shard", "item", "count", "error", "seen"])

    def close(self) -> None:
        pass


def lossy_counts(df: DataFrame, key: Column | str, epsilon: float, shards: int = SHARDS) -> DataFrame:
    """shard, item, count, error, seen: count <= true <= count + error, items that a shard no longer holds as its row without item says."""
    LossyCounter(epsilon)
    rows = _sharded(df, key, shards)
    return rows.groupBy("shard").transformWithStateInPandas(_Lossy(epsilon), "shard int, item string, count long, error long, seen long", "update", "none")


class _Sampler(StatefulProcessor):
    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sample = handle.getListState("sample", "priority long, item string")
        self.seen = handle.getValueState("seen", "seen long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.sample.get()] if self.sample.exists() else []
        seen = self.seen.get()[0] if self.seen.exists() else 0
        for batch in rows:
            seen += len(batch)
            held = heapq.nsmallest(self.k, held + list(zip(batch["priority"].tolist(), batch["item"].tolist())))
        self.sample.put(held)
        self.seen.update((seen,))
        yield pd.DataFrame([(key[0], i, p, seen) for p, i in held], columns=["shard", "item", "priority", "seen"])

    def close(self) -> None:
        pass


def reservoir(df: DataFrame, identity: Column | str, sketch: Reservoir, shards: int = SHARDS) -> DataFrame:
    """shard, item, priority, seen: each shard's k rows with the least priorities, of which the k least are the sample of all."""
    rows = _sharded(df, identity, shards, sketch.priority(identity).alias("priority"))
    return rows.groupBy("shard").transformWithStateInPandas(_Sampler(sketch.k), "shard int, item string, priority long, seen long", "update", "none")


class _Keeper(StatefulProcessor):
    """A period's cells and candidates; a timer at its end puts them out and clears the state."""

    def __init__(self, depth: int, width: int, k: int, seconds: int):
        self.depth, self.width, self.k, self.seconds = depth, width, k, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "row int", "prints binary, counts binary")  # a row's arrays, each read and written at once
        self.top = handle.getMapState("top", "item string", "count long")

    def _read(self) -> HeavyKeeperSketch:
        sketch = HeavyKeeperSketch(self.depth, self.width, self.k)
        for (row,), (prints, counts) in self.cells.iterator():
            sketch.prints[row], sketch.counts[row] = np.frombuffer(prints, np.int64), np.frombuffer(counts, np.int64)
        sketch.top = {k[0]: v[0] for k, v in self.top.iterator()}
        return sketch

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        sketch = self._read()
        held = set(sketch.top)
        for batch in rows:
            for item, c in batch["item"].value_counts(sort=False).items():
                sketch.insert(item, int(c))
        for row in range(self.depth):
            self.cells.updateValue((row,), (sketch.prints[row].tobytes(), sketch.counts[row].tobytes()))
        for item in held - sketch.top.keys():
            self.top.removeKey((item,))
        for item, c in sketch.top.items():
            self.top.updateValue((item,), (int(c),))
        self.handle.registerTimer((int(key[0]) + self.seconds) * 1000)
        yield pd.DataFrame({"period": pd.Series([], dtype="int64"), "shard": pd.Series([], dtype="int32"), "item": pd.Series([], dtype=object), "count": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        top = self._read().top
        self.cells.clear()
        self.top.clear()
        yield pd.DataFrame([(int(key[0]), int(key[1]), i, int(c)) for i, c in top.items()], columns=["period", "shard", "item", "count"])

    def close(self) -> None:
        pass


def heavy_periods(df: DataFrame, key: Column | str, time: str, seconds: int, late: str, depth: int = 4, width: int = 1024, k: int = 100, shards: int = SHARDS) -> DataFrame:
    """period, shard, item, count: candidates of each period of so many seconds, put out when the watermark has passed its end."""
    stamp = F.col(time).cast("timestamp")
    item = column(key).cast("string")
    given = df.filter(item.isNotNull() & stamp.isNotNull()).select(stamp.alias("_time"), item.alias("item")).withWatermark("_time", late)
    rows = given.select("_time", (F.floor(F.unix_timestamp("_time") / seconds) * seconds).alias("period"), F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard"), "item")
    return rows.groupBy("period", "shard").transformWithStateInPandas(_Keeper(depth, width, k, seconds), "period long, shard int, item string, count long", "append", "eventTime")

