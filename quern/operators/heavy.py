"""Heavy hitters: counter summaries made partition by partition, merged with their error bounds kept.

A summary is rows (item, count, error) and the number of items seen. Counts and errors bound the truth:
Misra-Gries: count <= true <= count + error. Space-Saving: count - error <= true <= count. Lossy Counting: count
<= true <= count + error. With a guaranteed set of candidates a second pass gives exact counts.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.hashing import column
from quern.functions.sizing import power_of_two
from quern.sources.working import written

#: Candidates that are sent to all executors at most.
SENT_ITEMS = 100_000
SUMMARY = "item string, count long, error long, seen long"


def _items(df: DataFrame, key: Column | str, weight: Column | str | None) -> DataFrame:
    w = F.lit(1) if weight is None else column(weight)
    return df.select(column(key).cast("string").alias("item"), w.cast("bigint").alias("count")).filter("item IS NOT NULL AND count > 0")


def entries(summary: DataFrame) -> DataFrame:
    """item, count, error of what a summary holds."""
    return summary.filter("item IS NOT NULL").select("item", "count", "error")


def top(summary: DataFrame, n: int) -> DataFrame:
    """The n entries with the largest counts."""
    return entries(summary).orderBy(F.desc("count"), "item").limit(n)


def _asked(summary: DataFrame, items: DataFrame) -> DataFrame:
    """items (a column item) with count and error where the summary holds them, and the totals row's error as off."""
    head = summary.filter("item IS NULL").agg(F.coalesce(F.max("error"), F.lit(0)).alias("off"))
    given = items.select(F.col("item").cast("string").alias("item")).distinct()
    return given.join(F.broadcast(entries(summary)), "item", "left").join(F.broadcast(head))


def misra_gries(counts: dict, capacity: int) -> tuple[dict, int]:
    """The capacity largest counts, each less the next one; and how much was taken off."""
    if len(counts) <= capacity:
        return counts, 0
    cut = sorted(counts.values(), reverse=True)[capacity]
    return {k: c - cut for k, c in counts.items() if c > cut}, cut


@dataclass(frozen=True)
class MisraGries:
    """k - 1 counters find every item that is more than one in k."""

    k: int

    def __post_init__(self) -> None:
        if self.k < 2:
            raise ValueError("k must be at least 2")

    def update(self, counters: dict, items: Iterator[tuple[str, int]]) -> tuple[dict, int, int]:
        """One by one: counters, what was taken off, how many were seen."""
        off = seen = 0
        for item, c in items:
            seen += c
            if item in counters or len(counters) < self.k - 1:
                counters[item] = counters.get(item, 0) + c
                continue
            low = min(c, min(counters.values()))
            off += low
            for key in [key for key, x in counters.items() if x <= low]:
                del counters[key]
            for key in counters:
                counters[key] -= low
            if c > low:
                counters[item] = c - low
        return counters, off, seen

    def summary(self, df: DataFrame, key: Column | str, weight: Column | str | None = None) -> DataFrame:
        """item, count, error, seen. Batches are counted first, which takes off no more than one by one."""
        capacity = self.k - 1

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counters: dict = {}
            off = seen = 0
            for batch in batches:
                for item, c in batch.groupby("item")["count"].sum().items():
                    counters[item] = counters.get(item, 0) + c
                seen += int(batch["count"].sum())
                counters, cut = misra_gries(counters, capacity)
                off += cut
            yield pd.DataFrame([(None, 0, off, seen), *((i, c, off, 0) for i, c in counters.items())], columns=["item", "count", "error", "seen"])

        # Written, as merging reads them several times: bounds and counts must be of one run.
        return self.merge(written(_items(df, key, weight).mapInPandas(partial, SUMMARY), "misra_gries"))

    def merge(self, *parts: DataFrame) -> DataFrame:
        """Counts add up; more than k - 1 are cut down to it. A row without item has the totals."""
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        total = rows.filter("item IS NULL").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("off"), F.coalesce(F.sum("seen"), F.lit(0)).alias("all"))
        sums = rows.filter("item IS NOT NULL").groupBy("item").agg(F.sum("count").alias("count"))
        top = sums.orderBy(F.desc("count"), "item").limit(self.k)
        cut = top.agg(F.when(F.count(F.lit(1)) == self.k, F.min("count")).otherwise(0).alias("cut"))
        head = total.join(F.broadcast(cut))
        kept = top.join(F.broadcast(head)).filter("count > cut").select("item", (F.col("count") - F.col("cut")).alias("count"), (F.col("off") + F.col("cut")).alias("error"), F.lit(0).cast("long").alias("seen"))
        return kept.unionByName(head.select(F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("count"), (F.col("off") + F.col("cut")).alias("error"), F.col("all").alias("seen")))

    def estimates(self, summary: DataFrame, items: DataFrame) -> DataFrame:
        """item, estimate (never above the truth, 0 if it isn't held) and most (never below it)."""
        n = F.coalesce("count", F.lit(0))
        return _asked(summary, items).select("item", n.alias("estimate"), (n + F.col("off")).alias("most"))

    def over(self, summary: DataFrame, threshold: int) -> DataFrame:
        """Entries that count threshold or more."""
        return entries(summary).filter(F.col("count") >= threshold)

    def heavy_hitters(self, df: DataFrame, key: str, weight: Column | str | None = None) -> DataFrame:
        """item and exact count of all items that are more than one in k: candidates, then a second pass."""
        found = written(self.summary(df, key, weight), "summary")
        seen = found.filter("item IS NULL").first()["seen"]
        return exact(df, key, found.filter("item IS NOT NULL"), weight).filter(F.col("count") * self.k > seen)


def exact(df: DataFrame, key: str, candidates: DataFrame, weight: Column | str | None = None) -> DataFrame:
    """True counts of the candidates. They are sent to all executors only where they are few; Spark decides beyond that."""
    few = F.broadcast if candidates.limit(SENT_ITEMS + 1).count() <= SENT_ITEMS else lambda df: df
    return _items(df, key, weight).join(few(candidates.select("item")), "item", "left_semi").groupBy("item").agg(F.sum("count").alias("count"))


class SpaceSavingSketch:
    """k counters: a new item takes the place, and the count, of a least one, which a heap finds."""

    def __init__(self, k: int):
        if k < 1:
            raise ValueError("k must be positive")
        self.k, self.counts, self.errors, self.seen = k, {}, {}, 0
        self.heap: list[tuple[int, str]] = []  # counts as they were when an item was put in; put right when it comes up

    def _least(self) -> tuple[int, str]:
        while True:
            c, item = self.heap[0]
            now = self.counts.get(item)
            if now == c:
                return c, item
            heapq.heapreplace(self.heap, (now, item)) if now is not None else heapq.heappop(self.heap)

    def insert(self, item: str, c: int = 1) -> None:
        self.seen += c
        if item in self.counts:
            self.counts[item] += c
            return
        low = 0
        if len(self.counts) >= self.k:
            low, old = self._least()
            heapq.heappop(self.heap)
            del self.counts[old], self.errors[old]
        self.counts[item], self.errors[item] = low + c, low
        heapq.heappush(self.heap, (low + c, item))

    @property
    def least(self) -> int:
        """What an item that is not held may have at most."""
        return self._least()[0] if len(self.counts) >= self.k else 0

    def estimate(self, item: str) -> int:
        return self.counts.get(item, self.least)

    def error(self, item: str) -> int:
        return self.errors.get(item, self.least)

    def entries(self) -> list[tuple[str, int, int]]:
        """By count, the least first."""
        return sorted(((i, c, self.errors[i]) for i, c in self.counts.items()), key=lambda x: (x[1], x[0]))

    def top(self, n: int) -> list[tuple[str, int, int]]:
        return sorted(((i, c, self.errors[i]) for i, c in self.counts.items()), key=lambda x: (-x[1], x[0]))[:n]


@dataclass(frozen=True)
class SpaceSaving:
    k: int

    def __post_init__(self) -> None:
        if self.k < 1:
            raise ValueError("k must be positive")

    def summary(self, df: DataFrame, key: Column | str, weight: Column | str | None = None) -> DataFrame:
        """item, count, error, seen; each partition's batches are counted first."""
        k = self.k

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sketch = SpaceSavingSketch(k)
            for batch in batches:
                for item, c in batch.groupby("item")["count"].sum().sort_values(ascending=False).items():
                    sketch.insert(item, int(c))
            yield pd.DataFrame([(None, 0, sketch.least, sketch.seen), *((i, c, e, 0) for i, c, e in sketch.top(k))], columns=["item", "count", "error", "seen"])

        return self.merge(written(_items(df, key, weight).mapInPandas(partial, SUMMARY), "space_saving"))

    def merge(self, *parts: DataFrame) -> DataFrame:
        """An item that a part does not hold may have had that part's least count there: it counts in full and as error."""
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        head = rows.filter("item IS NULL").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("least"), F.coalesce(F.sum("seen"), F.lit(0)).alias("all"))
        # Of the parts that hold an item the least counts are not known here, so all are added: a bound that still holds.
        sums = rows.filter("item IS NOT NULL").groupBy("item").agg(F.sum("count").alias("count"), F.sum("error").alias("error"))
        bound = sums.join(F.broadcast(head)).select("item", (F.col("count") + F.col("least")).alias("count"), (F.col("error") + F.col("least")).alias("error"), F.lit(0).cast("long").alias("seen"))
        top = bound.orderBy(F.desc(F.col("count") - F.col("error")), "item").limit(self.k)
        # Items beyond the k kept ones may have had more than those that no part holds.
        cut = bound.join(F.broadcast(top.select("item")), "item", "left_anti").agg(F.max("count").alias("cut"))
        return top.unionByName(head.join(F.broadcast(cut)).select(F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("count"), F.greatest("least", "cut").alias("error"), F.col("all").alias("seen")))

    def estimates(self, summary: DataFrame, items: DataFrame) -> DataFrame:
        """item, estimate (never below the truth; the least count if it isn't held) and error (how far it may be above)."""
        return _asked(summary, items).select("item", F.coalesce("count", "off").alias("estimate"), F.coalesce("error", "off").alias("error"))

    def top(self, df: DataFrame, key: str, n: int) -> DataFrame:
        """The n items with the largest exact counts.

        The candidates decide where the n-th of them has more than any item that is not held may have, or where no
        item is missing; else all items are counted.
        """
        found = self.summary(df, key).collect()  # once, so that bound and candidates belong together
        bound = max(r["error"] for r in found if r["item"] is None)
        held = df.sparkSession.createDataFrame([(r["item"],) for r in found if r["item"] is not None], "item string")
        counts = exact(df, key, held).orderBy(F.desc("count"), "item").limit(n)
        if not bound:
            return counts
        rows = [(r["item"], r["count"]) for r in counts.collect()]
        if len(rows) == n and rows[-1][1] > bound:
            return counts
        return _items(df, key, None).groupBy("item").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "item").limit(n)


class LossyCounter:
    """Windows of 1 / epsilon items; at the end of each, items that are surely rare are dropped."""

    def __init__(self, epsilon: float):
        if not 0 < epsilon < 1:
            raise ValueError("epsilon must lie between 0 and 1")
        self.epsilon, self.window, self.seen, self.held = epsilon, math.ceil(1 / epsilon), 0, {}

    def insert(self, item: str) -> None:
        bucket = self.seen // self.window + 1
        self.seen += 1
        count, error = self.held.get(item, (0, bucket - 1))
        self.held[item] = (count + 1, error)
        self._prune(bucket)

    def _prune(self, bucket: int) -> None:
        if self.seen % self.window == 0:
            self.held = {i: (c, e) for i, (c, e) in self.held.items() if c + e > bucket}

    def insert_all(self, items: list[str]) -> None:
        """As one by one: within a window only how often each item comes counts."""
        at = 0
        while at < len(items):
            bucket = self.seen // self.window + 1
            part = items[at : at + self.window - self.seen % self.window]
            for item, n in Counter(part).items():
                count, error = self.held.get(item, (0, bucket - 1))
                self.held[item] = (count + n, error)
            at += len(part)
            self.seen += len(part)
            self._prune(bucket)

    def estimate(self, item: str) -> int:
        return self.held.get(item, (0, 0))[0]

    def error(self, item: str) -> int:
        """How far the truth may be above the estimate."""
        return self.held[item][1] if item in self.held else self.seen // self.window

    def heavy_hitters(self, support: float) -> dict[str, int]:
        if support < self.epsilon:
            raise ValueError("support must not be below epsilon")
        return {i: c for i, (c, _) in self.held.items() if c >= (support - self.epsilon) * self.seen}


@dataclass(frozen=True)
class LossyCounting:
    epsilon: float

    def __post_init__(self) -> None:
        LossyCounter(self.epsilon)

    def summary(self, df: DataFrame, key: Column | str) -> DataFrame:
        epsilon = self.epsilon

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counter = LossyCounter(epsilon)
            for batch in batches:
                counter.insert_all(batch["item"].tolist())
            # An item that is not held may have had as many as there were full windows.
            yield pd.DataFrame([(None, 0, counter.seen // counter.window, counter.seen), *((i, c, e, 0) for i, (c, e) in counter.held.items())], columns=["item", "count", "error", "seen"])

        return self.merge(written(_items(df, key, None).mapInPandas(partial, SUMMARY), "lossy_counting"))

    def merge(self, *parts: DataFrame) -> DataFrame:
        """Counts add up; an item that a part doesn't hold may have had as many there as that part had full windows."""
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        head = rows.filter("item IS NULL").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("error"), F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"))
        sums = rows.filter("item IS NOT NULL").groupBy("item").agg(F.sum("count").alias("count"))
        kept = sums.join(F.broadcast(head)).filter("count + error > 0").select("item", "count", "error", F.lit(0).cast("long").alias("seen"))
        return kept.unionByName(head.select(F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("count"), "error", "seen"))

    def estimates(self, summary: DataFrame, items: DataFrame) -> DataFrame:
        """item, estimate (never above the truth) and error (how far the truth may be above it)."""
        return _asked(summary, items).select("item", F.coalesce("count", F.lit(0)).alias("estimate"), F.col("off").alias("error"))

    def heavy_hitters(self, df: DataFrame, key: str, support: float) -> DataFrame:
        """item and exact count of all items with at least support of the rows."""
        if support < self.epsilon:
            raise ValueError("support must not be below epsilon")
        found = written(self.summary(df, key), "summary")
        head = found.filter("item IS NULL").first()
        maybe = found.filter("item IS NOT NULL").filter(F.col("count") + head["error"] >= support * head["seen"])
        return exact(df, key, maybe).filter(F.col("count") >= support * head["seen"])


class HeavyKeeperSketch:
    """depth x width cells of fingerprint and count; a foreign fingerprint decays a cell with probability 1.08^-count."""

    def __init__(self, depth: int = 4, width: int = 1024, k: int = 100, seed: int = 0):
        if min(depth, width, k) < 1:
            raise ValueError("depth, width and k must be positive")
        self.depth, self.width, self.k = depth, width, k
        self.prints, self.counts = np.zeros((depth, width), np.int64), np.zeros((depth, width), np.int64)
        self.random, self.top = np.random.default_rng(seed), {}
        self.low = 0  # the least count of top is no smaller

    def _cells(self, item: str) -> tuple[int, list[int]]:
        raw = item.encode()
        return zlib.crc32(raw) + 1, [zlib.crc32(raw, 0x9E3779B9 * (r + 1) & 0xFFFFFFFF) % self.width for r in range(self.depth)]

    def insert(self, item: str, c: int = 1) -> None:
        own, cells = self._cells(item)
        best = 0
        for r, x in enumerate(cells):
            left, count = c, int(self.counts[r, x])
            if self.prints[r, x] != own and count:
                # So many foreign units pass until one takes effect; beyond 255 too many to matter.
                while left and count:
                    units = int(self.random.geometric(1.08**-count)) if count <= 255 else left + 1
                    if units > left:
                        left = 0
                    else:
                        left, count = left - units, count - 1
                if not count:  # the unit that empties a cell takes it over
                    left += 1
                self.counts[r, x] = count
            if left:
                self.prints[r, x] = own
                self.counts[r, x] += left
            if self.prints[r, x] == own:
                best = max(best, int(self.counts[r, x]))
        if item in self.top:
            self.top[item] = max(self.top[item], best)
        elif len(self.top) < self.k:
            self.top[item] = best
        elif best > self.low:
            self.low = min(self.top.values())
            if best > self.low:
                del self.top[next(i for i, x in self.top.items() if x == self.low)]
                self.top[item] = best

    def estimate(self, item: str) -> int:
        own, cells = self._cells(item)
        return max([self.top.get(item, 0), *(int(self.counts[r, x]) for r, x in enumerate(cells) if self.prints[r, x] == own)])


_KEEPER = "item string, row int, cell int, print long, count long"


@dataclass(frozen=True)
class HeavyKeeper:
    """State: cells (row, cell, print, count) without item, and for each item of a summary its cells and prints."""

    depth: int = 4
    width: int = 1024
    k: int = 100

    @classmethod
    def sized(cls, items: int, k: int = 100, depth: int = 4) -> HeavyKeeper:
        """Two cells in a row for each different item, so that counts that differ little keep their order."""
        return cls(depth, power_of_two(max(1024, 2 * items)), k)

    def state(self, df: DataFrame, key: Column | str) -> DataFrame:
        """The partitions' sketches, merged."""
        given = self

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sketch = HeavyKeeperSketch(given.depth, given.width, given.k)
            for batch in batches:
                for item, c in batch.groupby("item")["count"].sum().items():
                    sketch.insert(item, int(c))
            r, x = np.nonzero(sketch.counts)
            none = pd.Series([None] * len(r), dtype=object)  # of this type without rows as well
            yield pd.DataFrame({"item": none, "row": r, "cell": x, "print": sketch.prints[r, x], "count": sketch.counts[r, x]})
            held = [(i, r, x, own, 0) for i in sketch.top for own, cells in [sketch._cells(i)] for r, x in enumerate(cells)]
            yield pd.DataFrame(held, columns=["item", "row", "cell", "print", "count"])

        # Rows of an item come to one task, so that its summary tells of all of them.
        return self.merge(written(_items(df, key, None).repartition("item").mapInPandas(partial, _KEEPER), "heavy_keeper"))

    def merge(self, *parts: DataFrame) -> DataFrame:
        """In each cell counts of one print add up; of different prints the largest stays, less the next one."""
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        sums = rows.filter("item IS NULL").groupBy("row", "cell", "print").agg(F.sum("count").alias("count"))
        first = sums.groupBy("row", "cell").agg(F.max(F.struct("count", "print")).alias("x"), F.count(F.lit(1)).alias("prints"))
        second = sums.join(first.filter("prints > 1").select("row", "cell", F.col("x.print").alias("_own")), ["row", "cell"]).filter("print != _own").groupBy("row", "cell").agg(F.max("count").alias("next"))
        ranked = first.join(second, ["row", "cell"], "left")
        cells = ranked.select(F.lit(None).cast("string").alias("item"), "row", "cell", F.col("x.print").alias("print"), (F.col("x.count") - F.coalesce("next", F.lit(0))).alias("count"))
        return cells.unionByName(rows.filter("item IS NOT NULL").distinct())

    def entries(self, state: DataFrame) -> DataFrame:
        """item, count: of each item that a part's summary held the largest count in a cell with its print."""
        cells = state.filter("item IS NULL").select("row", "cell", "print", "count")
        held = state.filter("item IS NOT NULL").select("item", "row", "cell", "print")
        return held.join(cells, ["row", "cell", "print"], "left").groupBy("item").agg(F.coalesce(F.max("count"), F.lit(0)).alias("count"))

    def candidates(self, df: DataFrame, key: Column | str) -> DataFrame:
        """item, count of the k that rank first in the merged state. No guarantee that none is missed."""
        return self.entries(self.state(df, key)).orderBy(F.desc("count"), "item").limit(self.k)

    def top(self, df: DataFrame, key: str, n: int) -> DataFrame:
        return exact(df, key, self.candidates(df, key)).orderBy(F.desc("count"), "item").limit(n)
