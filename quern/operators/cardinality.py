"""Distinct counts: HyperLogLog registers as rows, and Spark's own sketch behind the same calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import params
from quern.functions.hashing import BITS, Policy, column, key_hash


@dataclass(frozen=True)
class HyperLogLog:
    """State: group, reg, rho. A register keeps the longest run of leading zeros, plus one, among its hashes."""

    precision: int = 14
    policy: Policy = "xxhash64"

    def __post_init__(self) -> None:
        if not 4 <= self.precision <= 16:
            raise ValueError("precision must lie in 4..16")

    @property
    def m(self) -> int:
        return 1 << self.precision

    @property
    def relative_error(self) -> float:
        return 1.04 / self.m**0.5

    @property
    def alpha(self) -> float:
        return {16: 0.673, 32: 0.697, 64: 0.709}.get(self.m, 0.7213 / (1 + 1.079 / self.m))

    def state(self, df: DataFrame, key: Column | str, group: list[str] | None = None) -> DataFrame:
        width = BITS - self.precision
        h = key_hash(key, self.policy)
        low = h % (1 << width)
        # Zeros before the first one of the low bits: the width less the length of their binary form.
        rho = F.when(low == 0, width + 1).otherwise(width - F.length(F.bin(low)) + 1)
        given = df.filter(column(key).isNotNull()).select(*(group or []), params.tagged(F.shiftright(h, width).cast("int"), "reg", self), rho.cast("int").alias("rho"))
        return given.groupBy(*(group or []), "reg").agg(F.max("rho").alias("rho"))

    def merge(self, *states: DataFrame) -> DataFrame:
        """Raises MismatchError where the states differ in precision or policy."""
        params.same(states, "reg", self)
        out = states[0]
        for s in states[1:]:
            out = out.unionByName(s)
        return out.groupBy(*[c for c in states[0].columns if c != "rho"]).agg(F.max("rho").alias("rho"))

    def estimate(self, state: DataFrame, group: list[str] | None = None, name: str = "estimate") -> DataFrame:
        sums = state.groupBy(*(group or [])).agg(F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("_sum"), F.count(F.lit(1)).alias("_used"))
        zeros = F.lit(self.m) - F.col("_used")
        raw = F.lit(self.alpha * self.m * self.m) / (F.col("_sum") + zeros)
        small = F.lit(float(self.m)) * F.log(F.lit(float(self.m)) / zeros)
        chosen = F.when(F.col("_used") == 0, 0.0).when((raw <= 2.5 * self.m) & (zeros > 0), small).otherwise(raw)
        return sums.withColumn(name, F.floor(chosen + 0.5)).drop("_sum", "_used")


def native_distinct(df: DataFrame, key: Column | str, group: list[str] | None = None, log_registers: int = 12, name: str = "estimate") -> DataFrame:
    """Spark's HyperLogLog sketch: faster, with a hash of its own."""
    return df.groupBy(*(group or [])).agg(F.hll_sketch_estimate(F.hll_sketch_agg(column(key), F.lit(log_registers))).alias(name))
