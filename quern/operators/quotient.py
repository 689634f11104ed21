"""A quotient filter with slots: remainders in runs and clusters, and three bits for each slot, in NumPy arrays of bounded shards.

A key's hash gives its shard, and there a fingerprint of q + r bits: a quotient, its home slot, and a remainder. Fingerprints of one
quotient lie side by side, in order, as a run; runs that a neighbour pushed away from home form a cluster with it. The bits of a slot
tell whether some fingerprint has it as home (occupied), whether the slot goes on with the run before it (continuation) and
whether its remainder is away from home (shifted), so all fingerprints can be read back. Tables are laid out from sorted fingerprints
in one pass over arrays: insertion, deletion, union and intersection merge sorted fingerprints, and doubling a table only moves a bit from
remainders to quotients, which keeps their order.

A table takes 95 % of its slots at most. What comes beyond that is refused and counted, or the table doubles where asked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import params
from quern.functions.hashing import Policy, column, key_hash
from quern.functions.sizing import power_of_two
from quern.operators.static_filters import SENT_BYTES, dump, load
from quern.sources.working import written

#: Keys of a shard, about, and the share of slots that may be taken.
SHARD_KEYS, FULLEST = 50_000, 0.95
STATE = "shard int, blob binary, n long, refused long"


class FullError(ValueError):
    """Some fingerprints found no slot."""


@dataclass
class Slots:
    """One table: remainders, and which slots are occupied, continue a run, or hold a shifted remainder."""

    q: int
    r: int
    remainder: np.ndarray
    occupied: np.ndarray
    continuation: np.ndarray
    shifted: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray, q: int, r: int, most: int | None = None) -> Slots:
        """From different fingerprints in order, as many as fit; raises FullError where they do not. most: how many may, below the number of slots."""
        size = 1 << q
        if len(fingerprints) > (FULLEST * size if most is None else min(most, size - 1)):
            raise FullError(f"{len(fingerprints)} fingerprints for {size} slots")
        home = (fingerprints >> r).astype(np.int64)
        n = np.arange(len(home))
        over = 0
        while True:  # what runs over the end goes on at the beginning and pushes what is there
            slot = n + np.maximum.accumulate(np.maximum(home - n, over)) if len(n) else n
            beyond = int(np.count_nonzero(slot >= size))
            if beyond == over:
                break
            over = beyond
        slot = slot % size
        out = cls(q, r, np.zeros(size, np.uint64), *(np.zeros(size, bool) for _ in range(3)))
        out.remainder[slot] = fingerprints & np.uint64((1 << r) - 1)
        out.occupied[home] = True
        out.continuation[slot[1:]] = home[1:] == home[:-1]
        out.shifted[slot] = slot != home
        return out

    @property
    def used(self) -> np.ndarray:
        return self.occupied | self.continuation | self.shifted

    @property
    def n(self) -> int:
        return int(np.count_nonzero(self.used))

    @property
    def load(self) -> float:
        return self.n / (1 << self.q)

    def fingerprints(self) -> np.ndarray:
        """All of them in order: the k-th run from an empty slot on belongs to the k-th occupied quotient from there on."""
        used = self.used
        if not used.any():
            return np.zeros(0, np.uint64)
        begin = int(np.flatnonzero(~used)[0]) + 1
        order = (np.arange(1 << self.q) + begin) % (1 << self.q)
        taken = order[used[order]]
        run = np.cumsum(~self.continuation[taken]) - 1
        quotient = order[self.occupied[order]][run]
        return np.sort(quotient.astype(np.uint64) << np.uint64(self.r) | self.remainder[taken])

    def holds(self, fingerprint: int) -> bool:
        """One lookup by the bits alone: back to the cluster's begin, over the runs before the own one, and along it."""
        mask = (1 << self.q) - 1
        home, wanted = fingerprint >> self.r, fingerprint & ((1 << self.r) - 1)
        if not self.occupied[home]:
            return False
        at = home
        runs = 0  # occupied quotients of the cluster before the own one
        while self.shifted[at]:
            at = (at - 1) & mask
            runs += bool(self.occupied[at])
        while runs:
            at = (at + 1) & mask
            runs -= not self.continuation[at]
        while True:
            if self.remainder[at] == wanted:
                return True
            at = (at + 1) & mask
            if not self.continuation[at]:
                return False

    def clusters(self) -> tuple[int, int]:
        """How many clusters, and the slots of the longest run of used ones."""
        used = self.used
        begin = used & ~np.roll(used, 1)
        if not begin.any():
            return 0, 0
        free = np.flatnonzero(~used)
        return int(np.count_nonzero(used & ~self.shifted)), int(np.max(np.diff(np.append(free, free[0] + len(used))) - 1))

    def doubled(self) -> Slots:
        """A table of twice the slots with the same fingerprints, whose quotients take a bit from the remainders."""
        if self.r < 2:
            raise FullError("no bit of the remainders is left")
        return Slots.of(self.fingerprints(), self.q + 1, self.r - 1)

    def state(self) -> dict:
        kind = np.uint8 if self.r <= 8 else np.uint16 if self.r <= 16 else np.uint32
        return {"q": self.q, "r": self.r, "remainder": self.remainder.astype(kind), **{k: np.packbits(getattr(self, k)) for k in ("occupied", "continuation", "shifted")}}

    @classmethod
    def read(cls, state: dict) -> Slots:
        size = 1 << state["q"]
        return cls(state["q"], state["r"], state["remainder"].astype(np.uint64), *(np.unpackbits(state[k], count=size).astype(bool) for k in ("occupied", "continuation", "shifted")))


@dataclass(frozen=True)
class QuotientFilter:
    """Shards of tables with 2^q slots and remainders of r bits, when they begin. State: shard, blob, n, refused (since it was begun).

    ranges: shards are ranges of the quotients of one large table, a power of two of them, so they hold its fingerprints and together take as many.
    """

    q: int
    r: int = 13
    shards: int = 1
    policy: Policy = "xxhash64"
    grows: bool = False
    ranges: bool = False

    def __post_init__(self) -> None:
        if not 3 <= self.q <= 26 or not 1 <= self.r <= 32 or self.q + self.r > 40 or self.shards < 1:
            raise ValueError("q must lie in 3..26, r in 1..32, both together be at most 40, shards positive")
        if self.ranges and (self.shards & self.shards - 1 or self.q + self.r + self.shards.bit_length() - 1 > 60):
            raise ValueError("shards by ranges must be a power of two, with quotients and remainders of 60 bits at most")

    @classmethod
    def sized(cls, n: int, fpr: float = 2.0**-13, policy: Policy = "xxhash64", grows: bool = False, shard_keys: int = SHARD_KEYS) -> QuotientFilter:
        """Three quarters full with n keys, as many shards as keep a table in bounds."""
        if n < 1 or not 0 < fpr < 1:
            raise ValueError("n must be positive, fpr lie between 0 and 1")
        shards = -(-n // shard_keys)
        return cls(max(3, power_of_two(n / shards / 0.75).bit_length() - 1), max(1, math.ceil(-math.log2(fpr))), shards, policy, grows)

    @property
    def capacity(self) -> int:
        """Fingerprints of a table at most."""
        return math.floor(FULLEST * (1 << self.q))

    def _most(self, shard: int, q: int) -> int:
        """Fingerprints of a shard's table with 2^q slots at most; those of ranges add up to what one table of all their slots takes."""
        if not self.ranges:
            return math.floor(FULLEST * (1 << q))
        whole = math.floor(FULLEST * (self.shards << q))
        return (shard + 1) * whole // self.shards - shard * whole // self.shards

    def _shard(self, h: Column) -> Column:
        return F.pmod(F.shiftright(h, self.q + self.r if self.ranges else 40), F.lit(self.shards)).cast("int")

    @property
    def kind(self) -> QuotientFilter:
        """What tables must have in common to be merged, doubled or not."""
        return replace(self, grows=False)

    def placed(self, df: DataFrame, key: Column | str) -> DataFrame:
        """shard, f of the keys that are not null, each once."""
        h = key_hash(column(key), self.policy)
        rows = df.filter(column(key).isNotNull()).select(h.alias("_h"))
        return rows.select(self._shard(F.col("_h")).alias("shard"), F.col("_h").bitwiseAND(F.lit((1 << self.q + self.r) - 1)).alias("f")).distinct()

    def _laid(self, shard: int, f: np.ndarray, q: int, r: int) -> tuple[Slots, int]:
        """A table of sorted fingerprints, and how many it refused: the largest ones."""
        while self.grows and len(f) > FULLEST * (1 << q) and r > 1:
            q, r = q + 1, r - 1
        most = self._most(shard, q)
        return Slots.of(f[:most], q, r, most), max(0, len(f) - most)

    def _row(self, shard: int, table: Slots, refused: int) -> pd.DataFrame:
        return pd.DataFrame([(shard, dump(self.kind, table.state()), table.n, refused)], columns=["shard", "blob", "n", "refused"])

    def _read(self, blob: bytes) -> Slots:
        return Slots.read(load(self.kind, blob))

    def _tagged(self, rows: DataFrame) -> DataFrame:
        return written(rows, "quotient").select(params.tagged(F.col("shard"), "shard", self.kind), "blob", "n", "refused")

    def state(self, df: DataFrame, key: Column | str) -> DataFrame:
        def build(rows: pd.DataFrame) -> pd.DataFrame:
            shard = int(rows["shard"].iloc[0])
            return self._row(shard, *self._laid(shard, np.sort(rows["f"].to_numpy(np.int64).view(np.uint64)), self.q, self.r))

        return self._tagged(self.placed(df, key).groupBy("shard").applyInPandas(build, STATE))

    def _changed(self, state: DataFrame, keys: DataFrame, change: Callable[[int, Slots, np.ndarray], np.ndarray]) -> DataFrame:
        """Each shard's table after a change of its fingerprints by new ones."""
        params.same([state], "shard", self.kind)

        def merged(shard: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            table = self._read(old["blob"].iloc[0]) if len(old) else Slots.of(np.zeros(0, np.uint64), self.q, self.r)
            f = change(int(shard[0]), table, np.sort(new["f"].to_numpy(np.int64).view(np.uint64)))
            after, refused = self._laid(int(shard[0]), f, table.q, table.r)
            return self._row(int(shard[0]), after, refused + (int(old["refused"].iloc[0]) if len(old) else 0))

        return self._tagged(state.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(merged, STATE))

    def insert(self, state: DataFrame, df: DataFrame, key: Column | str) -> DataFrame:
        """With the keys of df besides; those in the table stay where not all fit."""

        def change(shard: int, table: Slots, new: np.ndarray) -> np.ndarray:
            held = table.fingerprints()
            room = len(held) + len(new) if self.grows else self._most(shard, table.q)
            new = np.setdiff1d(new, held, assume_unique=True)
            fit = new[: max(0, room - len(held))]
            # Refused ones go behind all others, so that the layout leaves them out and counts them.
            return np.concatenate([np.union1d(held, fit), new[len(fit) :]])

        return self._changed(state, self.placed(df, key), change)

    def remove(self, state: DataFrame, df: DataFrame, key: Column | str) -> DataFrame:
        """Without the fingerprints of df's keys; those that it lacks change nothing."""
        return self._changed(state, self.placed(df, key), lambda shard, table, gone: np.setdiff1d(table.fingerprints(), gone, assume_unique=True))

    def _both(self, a: DataFrame, b: DataFrame, how: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        params.same([a, b], "shard", self.kind)

        def merged(shard: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            tables = [self._read(t["blob"].iloc[0]) for t in (x, y) if len(t)]
            f = [t.fingerprints() for t in tables] + [np.zeros(0, np.uint64)] * (2 - len(tables))
            q = max(t.q for t in tables)
            return self._row(int(shard[0]), *self._laid(int(shard[0]), how(*f), q, tables[0].q + tables[0].r - q))

        return self._tagged(a.groupBy("shard").cogroup(b.groupBy("shard")).applyInPandas(merged, STATE))

    def union(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return self._both(a, b, np.union1d)

    def intersection(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return self._both(a, b, lambda x, y: np.intersect1d(x, y, assume_unique=True))

    def maybe(self, df: DataFrame, key: str, state: DataFrame, flag: str = "maybe") -> DataFrame:
        """df with a flag: False only for keys that were surely not inserted, or refused; null keys are False."""
        params.same([state], "shard", self.kind)
        h = key_hash(F.col(key), self.policy)
        rows = df.withColumn("_shard", self._shard(h)).withColumn("_f", h.bitwiseAND(F.lit((1 << self.q + self.r) - 1)))
        size = state.agg(F.sum(F.length("blob"))).first()[0] or 0
        read = self._read
        if size <= SENT_BYTES:
            sent = df.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in state.select("shard", "blob").collect()})

            @F.pandas_udf("boolean")
            def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
                held: dict[int, np.ndarray] = {}
                for shard, f in batches:
                    out = np.zeros(len(f), bool)
                    for k in shard.dropna().unique().tolist():
                        if k in sent.value:
                            at = np.flatnonzero(shard == k)
                            held[k] = held[k] if k in held else read(sent.value[k]).fingerprints()  # once for each task
                            wanted = f.to_numpy()[at].astype(np.uint64)
                            place = np.minimum(np.searchsorted(held[k], wanted), max(0, len(held[k]) - 1))
                            out[at] = held[k][place] == wanted if len(held[k]) else False
                    yield pd.Series(out)

            return rows.withColumn(flag, probe("_shard", "_f")).drop("_shard", "_f")
        pairs = self.pairs(state).select(F.col("shard").alias("_s"), F.col("f").alias("_g"))
        found = rows.join(pairs, (F.col("_shard") == F.col("_s")) & (F.col("_f") == F.col("_g")), "left")
        return found.withColumn(flag, F.col("_g").isNotNull()).drop("_shard", "_f", "_s", "_g")

    def pairs(self, state: DataFrame) -> DataFrame:
        """shard, f of all fingerprints, read back from the slots."""
        read = self._read

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard, blob in zip(batch["shard"], batch["blob"]):
                    f = read(blob).fingerprints().view(np.int64)
                    yield pd.DataFrame({"shard": np.full(len(f), shard, np.int32), "f": f})

        return state.select("shard", "blob").mapInPandas(run, "shard int, f long")

    def stats(self, state: DataFrame) -> DataFrame:
        """shard, n, refused, slots, occupied, shifted, clusters, longest, load, expected_fpr, bytes."""
        read = self._read

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for shard, blob, n, refused in zip(batch["shard"], batch["blob"], batch["n"], batch["refused"]):
                    t = read(blob)
                    rows.append((shard, n, refused, 1 << t.q, int(t.occupied.sum()), int(t.shifted.sum()), *t.clusters(), t.load, -math.expm1(-t.load / (1 << t.r)), len(blob)))
                yield pd.DataFrame(rows, columns=["shard", "n", "refused", "slots", "occupied", "shifted", "clusters", "longest", "load", "expected_fpr", "bytes"])

        return state.select("shard", "blob", "n", "refused").mapInPandas(run, "shard int, n long, refused long, slots long, occupied long, shifted long, clusters long, longest long, load double, expected_fpr double, bytes long")

