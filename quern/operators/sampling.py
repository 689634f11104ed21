"""Uniform samples: the k rows with the least random priority, which merge exactly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.hashing import Policy, row_hash


@dataclass(frozen=True)
class Reservoir:
    """A sample of k rows, for each group where given. The priority is a hash of the row's identity and the seed."""

    k: int
    seed: int = 0
    policy: Policy = "xxhash64"

    def __post_init__(self) -> None:
        if self.k < 1:
            raise ValueError("k must be positive")

    def priority(self, identity: Column | str) -> Column:
        return row_hash(identity, self.seed, self.policy)

    def sample(self, df: DataFrame, identity: str, group: list[str] | None = None) -> DataFrame:
        given = df.withColumn("priority", self.priority(identity))
        if not group:
            return given.orderBy("priority", identity).limit(self.k)
        # Rank limits reach below the exchange, so each task sends k rows of a group at most.
        w = Window.partitionBy(*group).orderBy("priority", identity)
        return given.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= self.k).drop("_rank")

    def merge(self, a: DataFrame, b: DataFrame, identity: str, group: list[str] | None = None) -> DataFrame:
        return self.sample(a.unionByName(b).drop("priority"), identity, group)
