"""A learned Bloom filter: a logistic model over features of the keys answers for most members, a Bloom filter for those that it misses.

The model is fitted on a bounded sample of members and strangers. Its threshold lets half of the wanted share of strangers pass in the
sample, the other half is the backup's; the members below the threshold are counted in full, and the backup is sized by
that count. So no member is ever missed, whatever the model has learned; a useless model only leaves the backup as large as a filter of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.hashing import Policy, column
from quern.operators.membership import Bloom

#: Rows of either kind that the model learns from at most: those with the least hashes of their keys.
SAMPLE = 20_000


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-3) -> np.ndarray:
    """Intercept and weights by iterated reweighted least squares, with a small penalty so that separable classes have a solution."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1]) * len(x)
    penalty[0, 0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class LearnedBloom:
    """weights: of each feature, as 32-bit numbers; threshold: sums from there on are members; backup: of the others, None if there are none."""

    weights: tuple[float, ...]
    threshold: float
    backup: Bloom | None
    members: int
    misses: int

    @classmethod
    def fit(cls, members: DataFrame, strangers: DataFrame, key: str, features: list[Column], fpr: float = 0.01, policy: Policy = "xxhash64", sample: int = SAMPLE) -> LearnedBloom:
        """features: numbers of a row; null counts as 0. Members are distinct keys."""
        if not 0 < fpr < 1 or not features:
            raise ValueError("fpr must lie between 0 and 1, features not be empty")
        names = [f"f{i}" for i in range(len(features))]

        def some(df: DataFrame) -> np.ndarray:
            rows = df.filter(F.col(key).isNotNull()).select(F.xxhash64(F.col(key).cast("string")).alias("_h"), *[F.coalesce(f.cast("double"), F.lit(0.0)).alias(n) for f, n in zip(features, names)])
            got = rows.orderBy("_h", *names).limit(sample).toArrow()  # so many rows at most
            return np.column_stack([got.column(n).to_numpy() for n in names]) if got.num_rows else np.zeros((0, len(names)))

        own, other = some(members), some(strangers)
        x = np.concatenate([own, other])
        mean, deviation = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(names)), np.ones(len(names)))
        deviation[deviation == 0] = 1
        w = logistic((x - mean) / deviation, np.arange(len(x)) < len(own)) if len(own) and len(other) else np.zeros(len(names) + 1)
        weights = tuple(float(np.float32(v)) for v in w[1:] / deviation)
        scores = np.sort(other @ np.array(weights)) if len(other) else np.zeros(0)
        # The least threshold that at most half of the wanted share of sampled strangers reaches.
        pass_ = int(len(scores) * fpr / 2)
        threshold = float(np.nextafter(scores[len(scores) - 1 - pass_], np.inf)) if len(scores) else 0.0
        if not any(weights):
            threshold = float("inf")
        spec = cls(weights, threshold, None, 0, 0)
        told = members.filter(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((~spec.accepts(features)).cast("long")), F.lit(0)).alias("misses")).first()
        backup = Bloom.sized(told["misses"], fpr / 2, policy) if told["misses"] else None
        return cls(weights, threshold, backup, told["n"], told["misses"])

    def score(self, features: list[Column]) -> Column:
        total = F.lit(0.0)
        for w, f in zip(self.weights, features):
            total = total + F.lit(w) * F.coalesce(f.cast("double"), F.lit(0.0))
        return total

    def accepts(self, features: list[Column]) -> Column:
        """What the model takes for a member."""
        return self.score(features) >= self.threshold

    def state(self, members: DataFrame, key: Column | str, features: list[Column]) -> DataFrame:
        """Bits of the members that the model misses."""
        missed = members.filter(~self.accepts(features))
        return (self.backup or Bloom(64, 1)).bits(missed, column(key))

    def maybe(self, df: DataFrame, key: str, features: list[Column], bits: DataFrame, flag: str = "maybe") -> DataFrame:
        """df with a flag: False only for keys that are surely no members; null keys are False."""
        if self.backup is None:
            return df.withColumn(flag, self.accepts(features) & F.col(key).isNotNull())
        both = self.backup.maybe(df, key, bits, "_backup")
        return both.withColumn(flag, F.col(key).isNotNull() & (self.accepts(features) | F.col("_backup"))).drop("_backup")

    @property
    def bits(self) -> int:
        """Of the model's numbers and the backup."""
        return 32 * len(self.weights) + 64 + (self.backup.m if self.backup else 0)

    @property
    def bits_per_key(self) -> float:
        return self.bits / max(1, self.members)
