"""Frequencies and moments from linear sketches: states are rows (group, row, cell, count), and sums merge them.

Keys are counted before they are multiplied by the number of rows: the sketches are linear in the counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import params
from quern.functions.hashing import Policy, column, row_hash
from quern.functions.sizing import cms_params, power_of_two
from quern.sources.working import written


def _counted(df: DataFrame, key: Column | str, weight: Column | str | None, group: list[str]) -> DataFrame:
    w = F.lit(1).cast("bigint") if weight is None else column(weight).cast("bigint")
    given = df.filter(column(key).isNotNull()).select(*group, column(key).alias("_key"), w.alias("_w"))
    return given.groupBy(*group, "_key").agg(F.sum("_w").alias("_w"))


def _rows(depth: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row")


def merge(*states: DataFrame) -> DataFrame:
    """Raises MismatchError where the states differ in kind, size or policy."""
    params.same(states, "cell")
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*[c for c in states[0].columns if c != "count"]).agg(F.sum("count").alias("count"))


@dataclass(frozen=True)
class CountMin:
    width: int
    depth: int
    policy: Policy = "xxhash64"

    @classmethod
    def sized(cls, epsilon: float = 0.01, delta: float = 0.01, policy: Policy = "xxhash64") -> CountMin:
        p = cms_params(epsilon, delta)
        return cls(p.width, p.depth, policy)

    def _cells(self, keys: DataFrame) -> DataFrame:
        return keys.select("*", _rows(self.depth)).withColumn("cell", params.tagged(row_hash("_key", F.col("row"), self.policy) % self.width, "cell", self))

    def state(self, df: DataFrame, key: Column | str, weight: Column | str | None = None, group: list[str] | None = None) -> DataFrame:
        group = group or []
        return self._cells(_counted(df, key, weight, group)).groupBy(*group, "row", "cell").agg(F.sum("_w").alias("count"))

    def estimate(self, keys: DataFrame, key: str, state: DataFrame, group: list[str] | None = None, name: str = "estimate") -> DataFrame:
        """A row for each distinct key (and group): never below its count."""
        group = group or []
        asked = self._cells(keys.filter(F.col(key).isNotNull()).select(*group, F.col(key).alias("_key")).distinct())
        found = asked.join(state, [*group, "row", "cell"], "left")
        return found.groupBy(*group, F.col("_key").alias(key)).agg(F.min(F.coalesce("count", F.lit(0))).alias(name))


@dataclass(frozen=True)
class CountMinLog:
    """A count-min sketch of logarithmic levels: level v stands for (base^v - 1) / (base - 1).

    Counts of a key are known after aggregation, so cells are encoded without chance and merge by decoding,
    adding and encoding.
    """

    width: int
    depth: int
    base: float = 1.082
    levels: int = 255
    policy: Policy = "xxhash64"

    @classmethod
    def sized(cls, epsilon: float = 0.01, delta: float = 0.01, bits: int = 8, policy: Policy = "xxhash64") -> CountMinLog:
        if bits not in (4, 8):
            raise ValueError("bits must be 4 or 8")
        p = cms_params(epsilon, delta)
        return cls(p.width, min(8, p.depth), 2.0 if bits == 4 else 1.082, (1 << bits) - 1, policy)

    @classmethod
    def for_keys(cls, keys: int, bits: int = 8, depth: int = 5, policy: Policy = "xxhash64") -> CountMinLog:
        """With 1.36 cells in a row for each different key at least, so that few keys share all of theirs and sums stay near the truth."""
        if bits not in (4, 8):
            raise ValueError("bits must be 4 or 8")
        return cls(power_of_two(max(2048, 2048 * keys / 1500)), depth, 2.0 if bits == 4 else 1.082, (1 << bits) - 1, policy)

    def value(self, level: int) -> int:
        return math.floor((self.base**level - 1) / (self.base - 1) + 0.5)

    def encode(self, count: Column) -> Column:
        """The nearest level, the lower one of two."""
        table = F.array(*[F.lit(self.value(v)) for v in range(self.levels + 1)])
        first = F.size(F.filter(table, lambda v: v < count))  # levels below the count
        lower, upper = F.get(table, first - 1), F.get(table, first)
        return F.when(first == 0, 0).when(first > self.levels, self.levels).otherwise(F.when(count - lower <= upper - count, first - 1).otherwise(first)).cast("int")

    def decode(self, level: Column) -> Column:
        return F.get(F.array(*[F.lit(self.value(v)).cast("bigint") for v in range(self.levels + 1)]), level)

    def state(self, df: DataFrame, key: Column | str, weight: Column | str | None = None) -> DataFrame:
        """row, cell, level. A cell takes the largest of its keys' counts: with conservative update it never holds more."""
        cells = CountMin(self.width, self.depth, self.policy)._cells(_counted(df, key, weight, []))
        return cells.groupBy("row", "cell").agg(F.max("_w").alias("_w")).select("row", "cell", self.encode(F.col("_w")).alias("level"))

    def stream_state(self, df: DataFrame, key: Column | str, weight: Column | str | None = None, seed: int = 0) -> DataFrame:
        """row, cell, level, by conservative update in the order of the rows, as for a stream that is too large to count first.

        A task keeps levels alone. Of a key's cells those at its least level rise, each unit with probability base^-level; a batch's
        equal keys come together. Tasks' levels are decoded, added and encoded, so where several tasks have a cell it is an upper bound for each key.
        """
        places = F.array(*[row_hash(column(key), i, self.policy) % self.width for i in range(self.depth)])
        w = F.lit(1) if weight is None else column(weight)
        given = df.filter(column(key).isNotNull()).select(places.alias("cells"), w.cast("long").alias("w"), F.spark_partition_id().alias("p")).filter("w > 0")
        spec = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            levels, rows, random = np.zeros((spec.depth, spec.width), np.uint8), np.arange(spec.depth), None
            for batch in batches:
                if not len(batch):
                    continue
                random = random or np.random.default_rng([seed, int(batch["p"].iloc[0])])
                cells = np.stack(batch["cells"].to_list())
                keys, inverse = np.unique(cells, axis=0, return_inverse=True)
                for at, c in zip(keys, np.bincount(inverse.ravel(), batch["w"].to_numpy()).astype(np.int64).tolist()):
                    level = spec.raised(int(levels[rows, at].min()), c, random)
                    levels[rows, at] = np.maximum(levels[rows, at], level)
            r, x = np.nonzero(levels)
            yield pd.DataFrame({"row": r.astype(np.int32), "cell": x, "level": levels[r, x].astype(np.int32)})

        parts = written(given.mapInPandas(run, "row int, cell long, level int"), "count_min_log")
        sums = parts.groupBy("row", "cell").agg(F.sum(self.decode(F.col("level"))).alias("_w"))
        tagged = params.tagged(F.col("cell"), "cell", CountMin(self.width, self.depth, self.policy))
        return sums.select("row", tagged, self.encode(F.col("_w")).alias("level"))

    def raised(self, level: int, count: int, random: np.random.Generator) -> int:
        """The level after so many more units."""
        while count > 0 and level < self.levels:
            units = int(random.geometric(self.base**-level))  # until the level rises
            if units > count:
                break
            count, level = count - units, level + 1
        return level

    @property
    def deviation(self) -> float:
        """Of an estimate of one task, as a share of the count, but for collisions."""
        return math.sqrt((self.base - 1) / 2)

    def merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """An upper bound: where the parts' different keys share a cell, the level is that of the sum of their counts."""
        params.same([a, b], "cell")
        sums = a.unionByName(b).groupBy("row", "cell").agg(F.sum(self.decode(F.col("level"))).alias("_w"))
        return sums.select("row", "cell", self.encode(F.col("_w")).alias("level"))

    def estimate(self, keys: DataFrame, key: str, state: DataFrame, name: str = "estimate") -> DataFrame:
        asked = CountMin(self.width, self.depth, self.policy)._cells(keys.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct())
        found = asked.join(state, ["row", "cell"], "left").groupBy(F.col("_key").alias(key)).agg(F.min(F.coalesce("level", F.lit(0))).alias("_level"))
        return found.select(key, self.decode(F.col("_level")).alias(name))


class CountMinLogSketch:
    """The sketch in one place, item by item: of a key's cells only those at its least level rise, each unit with probability base^-level."""

    def __init__(self, spec: CountMinLog, seed: int = 0):
        self.spec, self.random = spec, np.random.default_rng(seed)
        self.levels = np.zeros((spec.depth, spec.width), np.uint8)

    def _at(self, key: str) -> tuple[np.ndarray, np.ndarray]:
        raw = key.encode()
        return np.arange(self.spec.depth), np.array([zlib.crc32(raw, 0x9E3779B9 * (r + 1) & 0xFFFFFFFF) % self.spec.width for r in range(self.spec.depth)])

    def insert(self, key: str, count: int = 1) -> None:
        at = self._at(key)
        level = self.spec.raised(int(self.levels[at].min()), count, self.random)
        self.levels[at] = np.maximum(self.levels[at], level)

    def estimate(self, key: str) -> int:
        return self.spec.value(int(self.levels[self._at(key)].min()))

    def packed(self) -> bytes:
        """Cells row by row, two to a byte where levels fit into four bits."""
        flat = self.levels.ravel()
        if self.spec.levels > 15:
            return flat.tobytes()
        flat = np.append(flat, np.zeros(len(flat) % 2, np.uint8))
        return (flat[::2] | flat[1::2] << 4).tobytes()

    @classmethod
    def unpacked(cls, spec: CountMinLog, data: bytes) -> CountMinLogSketch:
        out, n = cls(spec), spec.depth * spec.width
        flat = np.frombuffer(data, np.uint8)
        if len(flat) != (n if spec.levels > 15 else -(-n // 2)):
            raise ValueError("bytes of a sketch of another size")
        if spec.levels <= 15:
            flat = np.column_stack([flat & 15, flat >> 4]).ravel()[:n]
        out.levels = flat.reshape(spec.depth, spec.width).copy()
        return out


@dataclass(frozen=True)
class CountSketch:
    """Signed rows: estimates are unbiased, weights may be negative."""

    width: int
    depth: int
    policy: Policy = "xxhash64"

    @classmethod
    def sized(cls, epsilon: float = 0.01, delta: float = 0.01, policy: Policy = "xxhash64") -> CountSketch:
        p = cms_params(epsilon, delta)
        return cls(p.width, p.depth, policy)

    def _cells(self, keys: DataFrame) -> DataFrame:
        out = keys.select("*", _rows(self.depth)).withColumn("_h", row_hash("_key", F.col("row"), self.policy))
        return out.withColumn("cell", params.tagged(F.shiftright("_h", 1) % self.width, "cell", self)).withColumn("sign", F.when(F.col("_h") % 2 == 1, 1).otherwise(-1).cast("bigint")).drop("_h")

    def state(self, df: DataFrame, key: Column | str, weight: Column | str | None = None, group: list[str] | None = None) -> DataFrame:
        group = group or []
        return self._cells(_counted(df, key, weight, group)).groupBy(*group, "row", "cell").agg(F.sum(F.col("sign") * F.col("_w")).alias("count"))

    def estimate(self, keys: DataFrame, key: str, state: DataFrame, name: str = "estimate") -> DataFrame:
        """The upper median over the rows, which are few."""
        asked = self._cells(keys.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct())
        each = asked.join(state, ["row", "cell"], "left").select("_key", (F.col("sign") * F.coalesce("count", F.lit(0))).alias("_x"))
        return each.groupBy(F.col("_key").alias(key)).agg(F.get(F.array_sort(F.collect_list("_x")), F.lit(self.depth // 2)).alias(name))


@dataclass(frozen=True)
class AMS:
    """Second moment: the median over rows of the sum of squared signed cells."""

    depth: int
    width: int
    policy: Policy = "xxhash64"

    @classmethod
    def sized(cls, depth: int, width: int, policy: Policy = "xxhash64") -> AMS:
        if depth < 1 or width < 1:
            raise ValueError("depth and width must be positive")
        return cls(depth, power_of_two(width), policy)

    def state(self, df: DataFrame, key: Column | str, weight: Column | str | None = None, group: list[str] | None = None) -> DataFrame:
        return CountSketch(self.width, self.depth, self.policy).state(df, key, weight, group)

    def by_row(self, state: DataFrame, group: list[str] | None = None) -> DataFrame:
        return state.groupBy(*(group or []), "row").agg(F.sum(F.col("count") * F.col("count")).alias("f2"))

    def estimate(self, state: DataFrame, group: list[str] | None = None) -> DataFrame:
        return self.by_row(state, group).groupBy(*(group or [])).agg(F.median("f2").alias("f2"))
