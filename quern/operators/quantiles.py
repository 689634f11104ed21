"""Quantiles: logarithmic buckets as rows, Spark's KLL sketch, and t-digests built partition by partition."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quern.functions import params
from quern.functions.hashing import column


@dataclass(frozen=True)
class DDSketch:
    """State: group, sign, bucket, count. Values within a bucket differ by the factor gamma; sums merge states."""

    alpha: float = 0.01

    def __post_init__(self) -> None:
        if not 0 < self.alpha < 1:
            raise ValueError("alpha must lie between 0 and 1")

    @property
    def gamma(self) -> float:
        return (1 + self.alpha) / (1 - self.alpha)

    def state(self, df: DataFrame, value: Column | str, group: list[str] | None = None) -> DataFrame:
        """Nulls and NaN are left out."""
        v = column(value).cast("double")
        bucket = F.when(v == 0, 0).otherwise(F.ceil(F.log(F.abs(v)) / math.log(self.gamma))).cast("int")
        given = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        return given.groupBy(*(group or []), F.signum(v).cast("int").alias("sign"), params.tagged(bucket, "bucket", self)).agg(F.count(F.lit(1)).alias("count"))

    def merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Raises MismatchError where the states differ in alpha."""
        params.same([a, b], "bucket", self)
        return a.unionByName(b).groupBy(*[c for c in a.columns if c != "count"]).agg(F.sum("count").alias("count"))

    def quantiles(self, state: DataFrame, probabilities: list[float], group: list[str] | None = None) -> DataFrame:
        """group, q, value: the bucket where the cumulative count first reaches q * n. Buckets of a group are few."""
        group = group or []
        order = [F.col("sign") * F.col("bucket"), F.col("sign")]
        w = Window.partitionBy(*group).orderBy(F.col("sign"), order[0])
        ranked = state.withColumn("_up", F.sum("count").over(w)).withColumn("_n", F.sum("count").over(Window.partitionBy(*group)))
        q = F.explode(F.array(*[F.lit(float(min(1.0, max(0.0, p)))) for p in probabilities])).alias("q")
        reached = ranked.select("*", q).filter(F.col("_up") >= F.col("q") * F.col("_n"))
        value = F.col("sign") * 2 * F.pow(F.lit(self.gamma), F.col("bucket")) / (self.gamma + 1)
        return reached.groupBy(*group, "q").agg(F.min_by(F.when(F.col("sign") == 0, 0.0).otherwise(value), F.struct(F.col("sign"), order[0])).alias("value"))


def kll_state(df: DataFrame, value: Column | str, group: list[str] | None = None, k: int = 200) -> DataFrame:
    """group and Spark's KLL sketch as a binary."""
    if k < 8:
        raise ValueError("k must be at least 8")
    return df.groupBy(*(group or [])).agg(F.kll_sketch_agg_double(column(value).cast("double"), F.lit(k)).alias("sketch"))


def kll_merge(*states: DataFrame, group: list[str] | None = None) -> DataFrame:
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*(group or [])).agg(F.expr("kll_merge_agg_double(sketch)").alias("sketch"))


def kll_rank(value: float) -> Column:
    """Of a KLL state's row the share of values up to the given one."""
    return F.kll_sketch_get_rank_double("sketch", F.lit(float(value)))


def kll_quantile(q: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))


def kll_quantiles(df: DataFrame, value: Column | str, probabilities: list[float], group: list[str] | None = None, k: int = 200) -> DataFrame:
    """group, q, value and n from Spark's KLL sketch."""
    sketch = kll_state(df, value, group, k).withColumnRenamed("sketch", "_s")
    # The rank must be a literal, so each quantile is an expression of its own over the one sketch.
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("q"), F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias("value")) for p in probabilities])).alias("x")
    return sketch.select(*(group or []), F.kll_sketch_get_n_double("_s").alias("n"), each).select(*(group or []), "x.q", "x.value", "n")


# t-digest: state array of (mean, weight) by mean, with least and largest value.
DIGEST = "means array<double>, weights array<double>, least double, largest double"


def compress(means: np.ndarray, weights: np.ndarray, compression: float) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring centroids joined so that a joint one weighs about 4 W q (1 - q) / compression at most.

    On the scale k(q) = compression / 4 * log(q / (1 - q)) that is a step of 1, so centroids with their middles in
    one step are joined; single ones at the ends stay.
    """
    if not len(means):
        return means, weights
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    total = weights.sum()
    q = np.clip((np.cumsum(weights) - weights / 2) / total, 1e-12, 1 - 1e-12)
    step = np.floor(compression / 4 * np.log(q / (1 - q)))
    first = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
    joint = np.add.reduceat(weights, first)
    return np.add.reduceat(means * weights, first) / joint, joint


def _joined(rows: pd.DataFrame, compression: float) -> tuple[list[float], list[float], float, float]:
    m, w = compress(np.concatenate(rows["means"].to_list()), np.concatenate(rows["weights"].to_list()), compression)
    return m.tolist(), w.tolist(), rows["least"].min(), rows["largest"].max()


@dataclass(frozen=True)
class TDigest:
    compression: float = 100

    def __post_init__(self) -> None:
        if self.compression <= 0:
            raise ValueError("compression must be positive")

    def state(self, df: DataFrame, value: Column | str, group: str | list[str] | None = None, weight: Column | str | None = None) -> DataFrame:
        """The group's columns and a digest. Each partition makes a small digest of its own for each group, and these are merged."""
        group = [group] if isinstance(group, str) else group or []
        w = F.lit(1.0) if weight is None else column(weight).cast("double")
        given = df.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], column(value).cast("double").alias("x"), w.alias("w")).filter("x IS NOT NULL AND NOT isnan(x) AND w > 0")
        kinds, compression, names = dict(df.dtypes), self.compression, [f"g{i}" for i in range(len(group))]

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for batch in batches:
                for g, rows in batch.groupby(names, dropna=False) if names else [((), batch)]:
                    x, u = rows["x"].to_numpy(), rows["w"].to_numpy()
                    if len(x):
                        g = tuple(None if isinstance(v, float) and math.isnan(v) else v for v in g)
                        m, w, lo, hi = held.get(g, (np.zeros(0), np.zeros(0), np.inf, -np.inf))
                        held[g] = (*compress(np.append(m, x), np.append(w, u), compression), min(lo, x.min()), max(hi, x.max()))
            yield pd.DataFrame([(*g, m.tolist(), w.tolist(), lo, hi) for g, (m, w, lo, hi) in held.items()], columns=[*names, "means", "weights", "least", "largest"])

        parts = given.mapInPandas(partial, ", ".join([*(f"{n} {kinds[c]}" for n, c in zip(names, group)), DIGEST]))
        out = self._merged(parts, names)
        for n, c in zip(names, group):
            out = out.withColumnRenamed(n, c)
        return out.select(*group, params.tagged(F.col("means"), "means", self), "weights", "least", "largest")

    def _merged(self, parts: DataFrame, group: list[str]) -> DataFrame:
        compression = self.compression

        def join(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(*(rows[c].iloc[0] for c in group), *_joined(rows, compression))], columns=[*group, "means", "weights", "least", "largest"])

        return parts.groupBy(*group).applyInPandas(join, parts.schema)

    def merge(self, a: DataFrame, b: DataFrame, group: str | list[str] | None = None) -> DataFrame:
        params.same([a, b], "means", self)
        return self._merged(a.unionByName(b), [group] if isinstance(group, str) else group or [])


def digest_stats(state: DataFrame) -> DataFrame:
    """The state's groups with centroids, total weight, least and largest value."""
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    rest = [c for c in state.columns if c not in ("means", "weights", "least", "largest")]
    return state.select(*rest, F.size("means").alias("centroids"), total.alias("weight"), "least", "largest")


def digest_quantile(means: np.ndarray, weights: np.ndarray, least: float, largest: float, q: float) -> float:
    """Linear between the centroids' middles, held by the least and largest value."""
    if not len(means):
        return math.nan
    if q <= 0 or q >= 1:
        return least if q <= 0 else largest
    total = weights.sum()
    middle = np.cumsum(weights) - weights / 2
    return float(np.interp(q * total, [0, *middle, total], [least, *means, largest]))


def digest_cdf(means: np.ndarray, weights: np.ndarray, least: float, largest: float, x: float) -> float:
    if not len(means):
        return math.nan
    if x < least or x > largest:
        return 0.0 if x < least else 1.0
    if least == largest:
        return 0.5
    total = weights.sum()
    middle = np.cumsum(weights) - weights / 2
    return float(np.interp(x, [least, *means, largest], [0, *middle, total]) / total)


def _column(function, argument: float) -> Column:
    @F.pandas_udf(DoubleType())
    def at(means: pd.Series, weights: pd.Series, least: pd.Series, largest: pd.Series) -> pd.Series:
        return pd.Series([function(np.asarray(m), np.asarray(w), a, b, argument) for m, w, a, b in zip(means, weights, least, largest)], dtype=float)

    return at("means", "weights", "least", "largest")


def quantile(q: float) -> Column:
    """Of a t-digest state's row."""
    return _column(digest_quantile, q)


def cdf(x: float) -> Column:
    return _column(digest_cdf, x)
