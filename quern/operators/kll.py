"""A KLL sketch of our own: compactors as rows, seeded compaction within partitions, merges level by level.

An item of level i stands for 2^i values. A level that is too full is sorted and every second item goes up, the first or the second of each
pair by a seeded coin; capacities shrink by 2/3 from the top level down. State: group, level, items, and in a row of level -1 how many values there
were, the least, the largest, and how many compactions made the state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import params
from quern.functions.hashing import column
from quern.sources.working import written

#: Partial states of a group that one task merges, about.
FAN = 64
_STATE = "level int, items array<double>, n long, least double, largest double, compactions long"


class Compactors:
    """One sketch. Numbers come in arrays."""

    def __init__(self, k: int, seed: int = 0):
        self.k, self.random = k, np.random.default_rng(seed)
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.n, self.least, self.largest, self.compactions = 0, math.inf, -math.inf, 0

    def capacity(self, level: int) -> int:
        return max(2, math.ceil(self.k * (2 / 3) ** (len(self.levels) - 1 - level)))

    def _compact(self) -> None:
        while sum(map(len, self.levels)) > sum(self.capacity(i) for i in range(len(self.levels))):
            i = next(i for i, x in enumerate(self.levels) if len(x) > self.capacity(i))
            if i + 1 == len(self.levels):
                self.levels.append(np.zeros(0))
            items = np.sort(self.levels[i])
            odd = len(items) % 2  # one of an odd number stays, at either end
            keep, pairs = (items[:1], items[1:]) if odd and self.random.random() < 0.5 else (items[len(items) - odd :], items[: len(items) - odd])
            self.levels[i] = keep
            self.levels[i + 1] = np.append(self.levels[i + 1], pairs[int(self.random.integers(2)) :: 2])
            self.compactions += 1

    def insert(self, values: np.ndarray) -> None:
        self.n += len(values)
        if len(values):
            self.least, self.largest = min(self.least, float(values.min())), max(self.largest, float(values.max()))
        for lo in range(0, len(values), step := 4 * self.k):
            self.levels[0] = np.append(self.levels[0], values[lo : lo + step])
            self._compact()

    def merge(self, levels: list[np.ndarray], n: int, least: float, largest: float, compactions: int) -> None:
        while len(self.levels) < len(levels):
            self.levels.append(np.zeros(0))
        for i, x in enumerate(levels):
            self.levels[i] = np.append(self.levels[i], x)
        self.n, self.least, self.largest, self.compactions = self.n + n, min(self.least, least), max(self.largest, largest), self.compactions + compactions
        self._compact()

    def rows(self) -> list[tuple]:
        head = (-1, [], self.n, self.least, self.largest, self.compactions) if self.n else (-1, [], 0, None, None, self.compactions)
        return [head, *((i, x.tolist(), 0, None, None, 0) for i, x in enumerate(self.levels) if len(x))]


@dataclass(frozen=True)
class KLL:
    k: int = 200
    seed: int = 0

    def __post_init__(self) -> None:
        if self.k < 8:
            raise ValueError("k must be at least 8")

    @property
    def error(self) -> float:
        """Share of the values by which a rank may be off, with a chance of 99 %: for one quantile of merged states of any shape."""
        return 2.3 / self.k**0.9

    def state(self, df: DataFrame, value: Column | str, group: list[str] | None = None) -> DataFrame:
        """Nulls and NaN are left out. Coins are seeded by the partition's number, so a task that runs again does the same."""
        group = group or []
        v = column(value).cast("double")
        given = df.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], v.alias("x"), F.spark_partition_id().alias("p")).filter("x IS NOT NULL AND NOT isnan(x)")
        names, k, seed, kinds = [f"g{i}" for i in range(len(group))], self.k, self.seed, dict(df.dtypes)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple, Compactors] = {}
            at = 0
            for batch in batches:
                at = int(batch["p"].iloc[0]) if len(batch) else at
                for g, rows in batch.groupby(names, dropna=False) if names else [((), batch)]:
                    g = tuple(None if isinstance(y, float) and math.isnan(y) else y for y in g)
                    if g not in held:
                        held[g] = Compactors(k, hash((seed, at, len(held))) & 0xFFFFFFFF)
                    held[g].insert(rows["x"].to_numpy())
            yield pd.DataFrame([(*g, at, *row) for g, s in held.items() for row in s.rows()], columns=[*names, "p", "level", "items", "n", "least", "largest", "compactions"])

        schema = ", ".join([*(f"{n} {kinds[c]}" for n, c in zip(names, group)), "p int", _STATE])
        # Two steps, so that no task gets the partial states of all partitions; written, so that all who read the state see the same coins.
        parts = self._merged(given.mapInPandas(partial, schema).withColumn("p", F.pmod("p", F.lit(FAN))), names, ["p"])
        out = written(self._merged(parts, names, []), "kll")
        for n, c in zip(names, group):
            out = out.withColumnRenamed(n, c)
        return out.select(*group, params.tagged(F.col("level"), "level", self), "items", "n", "least", "largest", "compactions")

    def _merged(self, parts: DataFrame, group: list[str], more: list[str]) -> DataFrame:
        k, seed = self.k, self.seed
        columns = [*group, *more, "level", "items", "n", "least", "largest", "compactions"]

        def join(rows: pd.DataFrame) -> pd.DataFrame:
            s = Compactors(k, hash((seed, len(rows), int(rows["n"].sum()))) & 0xFFFFFFFF)
            head = rows[rows["level"] < 0]
            deepest = int(rows["level"].max())
            # In the order of the items, so that the order in which parts arrive does not matter.
            levels = [np.sort(np.concatenate([np.zeros(0), *(np.asarray(x, float) for x in rows["items"][rows["level"] == i])])) for i in range(deepest + 1)]
            full = head[head["n"] > 0]
            s.merge(levels, int(head["n"].sum()), float(full["least"].min()) if len(full) else math.inf, float(full["largest"].max()) if len(full) else -math.inf, int(head["compactions"].sum()))
            own = tuple(rows[c].iloc[0] for c in (*group, *more))
            return pd.DataFrame([(*own, *row) for row in s.rows()], columns=columns)

        kinds = dict(parts.dtypes)
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*group, *more)), _STATE])
        return parts.groupBy(*group, *more).applyInPandas(join, schema)

    def merge(self, a: DataFrame, b: DataFrame, group: list[str] | None = None) -> DataFrame:
        """Raises MismatchError where the states differ in k or seed."""
        params.same([a, b], "level", self)
        group = group or []
        out = written(self._merged(a.unionByName(b), group, []), "kll")
        return out.select(*group, params.tagged(F.col("level"), "level", self), "items", "n", "least", "largest", "compactions")

    def quantiles(self, state: DataFrame, probabilities: list[float], group: list[str] | None = None) -> DataFrame:
        """group, q, value: the least item whose weights up to it reach q of all; 0 and 1 give the least and largest value."""
        group = group or []
        head = state.filter("level < 0").select(*group, "n", "least", "largest")
        items = state.filter("level >= 0").select(*group, F.explode("items").alias("value"), F.expr("shiftleft(1L, level)").alias("w"))
        order = Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)  # some hundreds of items in a group
        ranked = items.withColumn("up", F.sum("w").over(order)).withColumn("all", F.sum("w").over(Window.partitionBy(*group)))
        q = F.explode(F.array(*[F.lit(float(min(1.0, max(0.0, p)))) for p in probabilities])).alias("q")
        reached = ranked.select("*", q).filter(F.col("up") >= F.col("q") * F.col("all")).groupBy(*group, "q").agg(F.min("value").alias("_v"))
        both = reached.join(head, group) if group else reached.crossJoin(head)
        return both.select(*group, "q", F.when(F.col("q") <= 0, F.col("least")).when(F.col("q") >= 1, F.col("largest")).otherwise(F.col("_v")).alias("value"))

    def ranks(self, state: DataFrame, values: list[float], group: list[str] | None = None) -> DataFrame:
        """group, value, rank: the share of values up to each."""
        group = group or []
        items = state.filter("level >= 0").select(*group, F.explode("items").alias("_x"), F.expr("shiftleft(1L, level)").alias("w"))
        each = items.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias("value"))
        return each.groupBy(*group, "value").agg((F.sum(F.when(F.col("_x") <= F.col("value"), F.col("w")).otherwise(0)) / F.sum("w")).alias("rank"))

    def stats(self, state: DataFrame, group: list[str] | None = None) -> DataFrame:
        """group, n, least, largest, compactions, levels, items."""
        group = group or []
        return state.groupBy(*group).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.sum("compactions").alias("compactions"), (F.max("level") + 1).alias("levels"), F.sum(F.size("items")).alias("items"))
