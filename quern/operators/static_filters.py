"""Filters built once from a full set of keys, as byte arrays: binary fuse, xor, ribbon, and the cuckoo filter with deletion.

Keys are dropped to distinct hashes and dealt over shards by hash, so a build is one bounded task; the state is a row for
each shard. Builds and probes work on whole arrays of hashes.

A saved state is bytes: a magic word, the length of a JSON header with the filter's kind, parameters and the kinds and lengths of its
arrays, and these arrays, little-endian. Loading runs no code and refuses a state of another kind or other parameters.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.hashing import Policy, key_hash
from quern.functions.sizing import cuckoo_params, fuse_params, power_of_two
from quern.sources.working import written

#: Keys for each shard, about; bytes of all shards that are sent to all executors.
SHARD_KEYS, SENT_BYTES = 50_000, 64 << 20
SALTS = 16
U = np.uint64


class BuildError(RuntimeError):
    """No seed gave a solvable system."""


class FormatError(ValueError):
    """Bytes that are no state of this filter."""


MAGIC = b"QSF1"


def dump(filter_, state: dict) -> bytes:
    """A state as bytes."""
    arrays = {k: v for k, v in state.items() if isinstance(v, np.ndarray)}
    head = {"filter": repr(filter_), "values": {k: v for k, v in state.items() if k not in arrays}, "arrays": [[k, v.dtype.str, len(v)] for k, v in arrays.items()]}
    raw = json.dumps(head).encode()
    return b"".join((MAGIC, len(raw).to_bytes(4, "little"), raw, *(np.ascontiguousarray(v).tobytes() for v in arrays.values())))


def load(filter_, data: bytes) -> dict:
    """The state behind the bytes; raises FormatError where they are of another filter."""
    data = bytes(data)
    if data[:4] != MAGIC:
        raise FormatError("not a filter's state")
    at = 8 + int.from_bytes(data[4:8], "little")
    try:
        head = json.loads(data[8:at])
    except ValueError as error:
        raise FormatError("a broken header") from error
    if head["filter"] != repr(filter_):
        raise FormatError(f"a state of {head['filter']}, not of {filter_!r}")
    out = {k: tuple(v) if isinstance(v, list) else v for k, v in head["values"].items()}
    for name, kind, n in head["arrays"]:
        if np.dtype(kind).kind not in "ui" or at + n * np.dtype(kind).itemsize > len(data):
            raise FormatError("arrays do not fit")
        out[name] = np.frombuffer(data, kind, n, at)
        at += out[name].nbytes
    return out


def scramble(h: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64 bits from a hash and a seed, or each hash's own one."""
    x = h.astype(U) + np.atleast_1d(seed).astype(U) * U(0x9E3779B97F4A7C15) + U(0x632BE59BD9B4E019)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> U(shift))) * U(factor)
    return x ^ (x >> U(31))


def peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, their own slot): each slot alone in what earlier rounds leave. None if some keys stay.

    slots: three for each key. All slots with one key are taken at once.
    """
    keys = np.arange(len(slots))
    count = np.bincount(slots.ravel(), minlength=size)
    which = np.zeros(size, np.int64)
    np.add.at(which, slots.ravel(), np.repeat(keys, 3))
    left, rounds = np.ones(len(slots), bool), []
    single = np.flatnonzero(count == 1)
    while len(single):
        taken, at = np.unique(which[single], return_index=True)
        rounds.append((taken, single[at]))
        left[taken] = False
        gone = slots[taken].ravel()
        np.subtract.at(count, gone, 1)
        np.subtract.at(which, gone, np.repeat(taken, 3))
        touched = np.unique(gone)
        single = touched[count[touched] == 1]
    return None if left.any() else rounds


@dataclass(frozen=True)
class Peeled:
    """What xor and fuse filters share: a key's fingerprint is the XOR of three slots."""

    bits: int = 8
    seeds: int = 100

    def __post_init__(self) -> None:
        if self.bits not in (8, 16):
            raise ValueError("bits must be 8 or 16")

    def geometry(self, n: int) -> tuple[int, ...]:
        raise NotImplementedError

    def size(self, shape: tuple[int, ...]) -> int:
        raise NotImplementedError

    def slots(self, x: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
        raise NotImplementedError

    def _print(self, x: np.ndarray) -> np.ndarray:
        return (scramble(x, 1) >> U(64 - self.bits)).astype(np.uint8 if self.bits == 8 else np.uint16)

    def build(self, h: np.ndarray) -> dict:
        h = np.unique(np.asarray(h, U))
        shape = self.geometry(len(h))
        for seed in range(self.seeds):
            x = scramble(h, seed + 17)
            slots = self.slots(x, shape)
            rounds = peel(slots, self.size(shape))
            if rounds is not None:
                prints = self._print(x)
                cells = np.zeros(self.size(shape), prints.dtype)
                for keys, own in reversed(rounds):
                    cells[own] = prints[keys] ^ np.bitwise_xor.reduce(cells[slots[keys]], axis=1)
                return {"seed": seed, "shape": shape, "n": len(h), "cells": cells}
        raise BuildError(f"{len(h)} keys, {self.seeds} seeds")

    def probe(self, state: dict, h: np.ndarray) -> np.ndarray:
        if not state["n"]:
            return np.zeros(len(h), bool)
        return self.told(state, h)

    def told(self, state: dict, h: np.ndarray) -> np.ndarray:
        """Seed, shape and base, where a key's cells begin, may be one or those of each key (``Stack``)."""
        x = scramble(np.asarray(h, U), state["seed"] + 17)
        at = self.slots(x, state["shape"]) + np.atleast_1d(state.get("base", 0))[:, None]
        return np.bitwise_xor.reduce(state["cells"][at], axis=1) == self._print(x)

    @property
    def fpr(self) -> float:
        return 2.0**-self.bits


@dataclass(frozen=True)
class Xor(Peeled):
    """Three blocks of a power of two slots, 1.23 slots or more for each key."""

    seeds: int = 10

    def geometry(self, n: int) -> tuple[int, ...]:
        return (max(32, power_of_two(1.23 * n / 3)),)

    def size(self, shape: tuple[int, ...]) -> int:
        return 3 * shape[0]

    def slots(self, x: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
        mask = np.asarray(shape[0]).astype(U) - U(1)
        return np.column_stack([((x >> U(21 * k)) & mask).astype(np.int64) + k * shape[0] for k in range(3)])


@dataclass(frozen=True)
class BinaryFuse(Peeled):
    """Three neighbouring segments of a row of them, 1.125 slots or more for each key."""

    def geometry(self, n: int) -> tuple[int, ...]:
        p = fuse_params(max(2, n))
        return (p["segment_length"], p["segments"])

    def size(self, shape: tuple[int, ...]) -> int:
        return (shape[1] + 2) * shape[0]

    def slots(self, x: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
        length, segments = (np.asarray(n).astype(U) for n in shape)
        first = ((x >> U(32)) * (length * segments)) >> U(32)
        mask = length - U(1)
        second = (first + length) ^ ((x >> U(18)) & mask)
        third = (first + U(2) * length) ^ (x & mask)
        return np.column_stack([first, second, third]).astype(np.int64)


@dataclass(frozen=True)
class Ribbon:
    """A band matrix: a key's fingerprint is the XOR of the solution rows that its coefficients pick behind its start."""

    bits: int = 8
    width: int = 64
    seeds: int = 10

    def __post_init__(self) -> None:
        if self.bits not in (8, 16) or self.width not in (64, 128):
            raise ValueError("bits must be 8 or 16, width 64 or 128")

    @property
    def fpr(self) -> float:
        return 2.0**-self.bits

    def _rows(self, h: np.ndarray, seed: int, starts: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        x = scramble(np.asarray(h, U), seed + 29)
        parts = [scramble(x, 2 + k) for k in range(self.width // 64)]
        parts[0] |= U(1)  # a row begins at its start
        return (x & (np.asarray(starts).astype(U) - U(1))).astype(np.int64), parts, (scramble(x, 9) >> U(64 - self.bits)).astype(np.int64)

    def build(self, h: np.ndarray) -> dict:
        h = np.unique(np.asarray(h, U))
        factor = 1.08 if self.width == 64 else 1.05
        starts = power_of_two(max(64, factor * len(h) - self.width))
        for seed in range(self.seeds):
            start, parts, prints = self._rows(h, seed, starts)
            coefficients, results = [0] * (starts + self.width), [0] * (starts + self.width)
            rows = parts[0].tolist() if len(parts) == 1 else [a | b << 64 for a, b in zip(parts[0].tolist(), parts[1].tolist())]
            for s, c, r in zip(start.tolist(), rows, prints.tolist()):
                while c:
                    step = (c & -c).bit_length() - 1
                    s, c = s + step, c >> step
                    if not coefficients[s]:
                        coefficients[s], results[s] = c, r
                        break
                    c ^= coefficients[s]
                    r ^= results[s]
                else:
                    if r:
                        break
            else:
                cells = np.zeros(starts + self.width, np.uint8 if self.bits == 8 else np.uint16)
                solution = [0] * (starts + 2 * self.width)
                for s in range(starts + self.width - 1, -1, -1):
                    c, r = coefficients[s] >> 1, results[s] if coefficients[s] else 0
                    if coefficients[s]:
                        at = s + 1
                        while c:
                            step = (c & -c).bit_length() - 1
                            at, c = at + step, c >> step >> 1
                            r ^= solution[at]
                            at += 1
                    solution[s] = r
                cells[:] = solution[: len(cells)]
                return {"seed": seed, "starts": starts, "n": len(h), "cells": cells}
        raise BuildError(f"{len(h)} keys, {self.seeds} seeds")

    def probe(self, state: dict, h: np.ndarray) -> np.ndarray:
        if not state["n"]:
            return np.zeros(len(h), bool)
        return self.told(state, h)

    def told(self, state: dict, h: np.ndarray) -> np.ndarray:
        """Seed, starts and base may be one or those of each key (``Stack``)."""
        start, parts, prints = self._rows(h, state["seed"], state["starts"])
        start = start + state.get("base", 0)
        got = np.zeros(len(h), np.int64)
        for k in range(self.width):
            bit = ((parts[k // 64] >> U(k % 64)) & U(1)).astype(np.int64)
            got ^= bit * state["cells"][start + k]
        return got == prints


def cuckoo_places(h: np.ndarray, buckets: int | np.ndarray, bits: int | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each hash the fingerprint and the two buckets; sizes may be those of each hash."""
    x, last = scramble(np.asarray(h, U), 5), np.asarray(buckets).astype(np.int64) - 1
    own = (x & ((U(1) << np.asarray(bits).astype(U)) - U(1))).astype(np.int64)
    own[own == 0] = 1
    first = (x >> U(32)).astype(np.int64) & last
    return own, first, first ^ ((own * 0x5BD1E995 >> 3) & last)


def cuckoo_told(state: dict, h: np.ndarray) -> np.ndarray:
    """Tables in a row: base is the bucket at which a key's tables begin, depth how many bits of the fingerprint name one, aside what waits, as bucket * 256 + fingerprint."""
    own, a, b = cuckoo_places(h, state["buckets"], state["bits"])
    base = state["base"] + (own & ((1 << np.asarray(state["depth"], np.int64)) - 1)) * state["buckets"]
    cells, a, b = state["cells"].reshape(-1, 4), base + a, base + b
    out = (cells[a] == own[:, None]).any(1) | (cells[b] == own[:, None]).any(1)
    return out | np.isin(a * 256 + own, state["aside"]) | np.isin(b * 256 + own, state["aside"]) if len(state["aside"]) else out


class Stack:
    """The states of all shards in a row, so a batch is probed at once, however many shards its keys belong to."""

    def __init__(self, filter_, states: dict[int, dict]):
        self.told = filter_.told
        kept = sorted(k for k, x in states.items() if x.get("n", 1) or len(x.get("at", ())) or "table" in x)
        of = [states[k] for k in kept]
        cells, unit = ("table", 4) if of and "table" in of[0] else ("cells", 1)
        self.shards = np.array(kept, np.int64)
        self.cells = np.concatenate([x[cells] for x in of]) if of else np.zeros(0, np.uint8)
        base = np.cumsum([0, *(len(x[cells]) // unit for x in of)], dtype=np.int64)[:-1] if of else np.zeros(0, np.int64)
        self.each = {k: np.array([x[k] for x in of], np.int64) for k in ("seed", "starts", "buckets", "bits", "depth") if of and k in of[0]} | {"base": base}
        if unit == 4:
            self.each.setdefault("depth", np.zeros(len(of), np.int64))
        self.shape = [np.array(x, np.int64) for x in zip(*(x["shape"] for x in of))] if of and "shape" in of[0] else None
        waiting = [(b + x.get("of", 0) * x["buckets"] + x["at"]) * 256 + x["own"] for b, x in zip(base, of) if len(x.get("at", ()))]
        self.aside = np.concatenate(waiting) if waiting else np.zeros(0, np.int64)

    def probe(self, shard: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        if len(self.shards):
            at = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
            rows = np.flatnonzero(self.shards[at] == shard)
            at = at[rows]
            one = {k: x[at] for k, x in self.each.items()} | {"cells": self.cells, "aside": self.aside}
            out[rows] = self.told(one if self.shape is None else one | {"shape": tuple(x[at] for x in self.shape)}, h[rows].astype(np.int64).view(U))
        return out


@dataclass
class Cuckoo:
    """Buckets of four fingerprints; a key has two buckets. Fingerprints that find no place are kept aside, so none is lost.

    Equal keys take a place each, as often as they are inserted. ``full`` tells that some insertion found no place.
    """

    buckets: int
    bits: int = 8
    kicks: int = 500
    table: bytearray = field(default_factory=bytearray)
    aside: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def sized(cls, n: int, fpr: float = 0.01) -> Cuckoo:
        p = cuckoo_params(n, fpr)
        return cls(p.capacity // 4, p.fingerprint_bits)

    def __post_init__(self) -> None:
        if self.buckets < 2 or self.buckets & (self.buckets - 1) or not 1 <= self.bits <= 8:
            raise ValueError("buckets must be a power of two, bits lie in 1..8")
        self.table = self.table or bytearray(4 * self.buckets)  # 0 is a free place

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each hash the fingerprint and the two buckets."""
        return cuckoo_places(h, self.buckets, self.bits)

    def _places(self, h: int) -> tuple[int, int, int]:
        return tuple(int(x[0]) for x in self.places(np.array([h], U)))

    def _other(self, bucket: int, own: int) -> int:
        return bucket ^ (own * 0x5BD1E995 >> 3 & (self.buckets - 1))

    def _put(self, bucket: int, own: int) -> bool:
        at = self.table.find(0, 4 * bucket, 4 * bucket + 4)
        if at < 0:
            return False
        self.table[at] = own
        return True

    def _insert(self, own: int, a: int, b: int) -> bool:
        if self._put(a, own) or self._put(b, own):
            return True
        at = a
        for k in range(self.kicks):
            slot = 4 * at + (own + k) % 4
            own, self.table[slot] = self.table[slot], own
            at = self._other(at, own)
            if self._put(at, own):
                return True
        self.aside.append((at, own))
        return False

    def insert(self, h: int) -> bool:
        """False if the filter is full; the key is found all the same."""
        return self._insert(*self._places(h))

    def insert_all(self, h: np.ndarray) -> int:
        """How many found a place. Whole arrays fill free places of first, then of second buckets; only what is left then kicks others out."""
        own, a, b = self.places(h)
        cells = np.frombuffer(self.table, np.uint8).reshape(-1, 4)
        left = np.arange(len(own))
        for bucket in (a, b):
            at = bucket[left]
            order = np.argsort(at, kind="stable")
            at, rows = at[order], left[order]
            nth = np.arange(len(at)) - np.searchsorted(at, at)  # among those for this bucket
            used = (cells != 0).sum(1)  # places fill from the left unless some were removed
            free = np.argsort(cells != 0, axis=1, kind="stable")
            fits = nth < 4 - used[at]
            cells[at[fits], free[at[fits], nth[fits]]] = own[rows[fits]]
            left = np.sort(rows[~fits])
        del cells
        return len(own) - sum(not self._insert(*x) for x in zip(own[left].tolist(), a[left].tolist(), b[left].tolist()))

    def contains(self, h: int) -> bool:
        return bool(self.contains_all(np.array([h], U))[0])

    def contains_all(self, h: np.ndarray) -> np.ndarray:
        own, a, b = self.places(h)
        cells = np.frombuffer(self.table, np.uint8).reshape(-1, 4)
        out = (cells[a] == own[:, None]).any(1) | (cells[b] == own[:, None]).any(1)
        for at, x in self.aside:
            out |= (own == x) & ((a == at) | (b == at))
        return out

    def remove(self, h: int) -> bool:
        return self._remove(*self._places(h))

    def _remove(self, own: int, a: int, b: int) -> bool:
        for x in (a, b):
            place = self.table.find(own, 4 * x, 4 * x + 4)
            if place >= 0:
                self.table[place] = 0
                for k, (at, other) in enumerate(self.aside):  # one that waits may have room now
                    if x in (at, self._other(at, other)):
                        self._put(x, self.aside.pop(k)[1])
                        break
                return True
        for k, (at, x) in enumerate(self.aside):
            if x == own and at in (a, b):
                del self.aside[k]
                return True
        return False

    @property
    def full(self) -> bool:
        return bool(self.aside)

    @property
    def load(self) -> float:
        return (len(self.table) - self.table.count(0)) / len(self.table)

    @property
    def expected_fpr(self) -> float:
        return 8 / (1 << self.bits)


@dataclass(frozen=True)
class CuckooFilter:
    """The cuckoo filter in shards, with the calls of the other filters. multiset: equal keys count as often as they come."""

    fpr: float = 0.01
    multiset: bool = False

    def build(self, h: np.ndarray, removed: np.ndarray = np.zeros(0, np.int64)) -> dict:
        h = np.asarray(h, np.int64).view(U) if np.asarray(h).dtype == np.int64 else np.asarray(h, U)
        out = Cuckoo.sized(max(1, math.ceil(len(h) / 0.95)), self.fpr)
        out.insert_all(h)
        for x in zip(*(x.tolist() for x in out.places(np.asarray(removed).astype(np.int64).view(U)))):
            out._remove(*x)
        aside = np.array(out.aside, np.int64).reshape(-1, 2)
        return {"n": len(h) - len(removed), "buckets": out.buckets, "bits": out.bits, "table": np.frombuffer(bytes(out.table), np.uint8), "at": aside[:, 0].copy(), "own": aside[:, 1].copy()}

    @staticmethod
    def told(state: dict, h: np.ndarray) -> np.ndarray:
        return cuckoo_told(state, h)

    def filter(self, state: dict) -> Cuckoo:
        return Cuckoo(state["buckets"], state["bits"], table=bytearray(state["table"].tobytes()), aside=list(zip(state["at"].tolist(), state["own"].tolist())))

    def probe(self, state: dict, h: np.ndarray) -> np.ndarray:
        return self.filter(state).contains_all(np.asarray(h).astype(np.int64).view(U))


@dataclass(frozen=True)
class Sharded:
    """Builds and probes a filter over a table of keys."""

    filter: Peeled | Ribbon | CuckooFilter
    shards: int = 1
    policy: Policy = "xxhash64"

    @classmethod
    def over(cls, filter_, keys: int, policy: Policy = "xxhash64") -> Sharded:
        return cls(filter_, max(1, -(-keys // SHARD_KEYS)), policy)

    def _placed(self, df: DataFrame, key: str) -> DataFrame:
        h = key_hash(F.col(key), self.policy)
        return df.withColumn("_h", h).withColumn("shard", F.pmod(F.shiftright("_h", 40), F.lit(self.shards)).cast("int"))

    def state(self, df: DataFrame, key: str, removed: DataFrame | None = None) -> DataFrame:
        """shard, blob, n. removed: keys to delete again, for filters that can."""
        once = (lambda d: d) if getattr(self.filter, "multiset", False) else DataFrame.distinct
        placed = lambda d: once(self._placed(d.select(key).filter(F.col(key).isNotNull()), key).select("shard", "_h"))
        keys = placed(df).withColumn("_gone", F.lit(False))
        if removed is not None:
            keys = keys.unionByName(placed(removed).withColumn("_gone", F.lit(True)))
        filter_ = self.filter

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            gone = rows["_gone"].to_numpy(bool)
            h = rows["_h"].to_numpy(np.int64)
            state = filter_.build(np.sort(h[~gone]), np.sort(h[gone])) if gone.any() else filter_.build(np.sort(h))
            return pd.DataFrame([(rows["shard"].iloc[0], dump(filter_, state), state["n"])], columns=["shard", "blob", "n"])

        # Written, so that each shard is built once however often the state is read.
        return written(keys.groupBy("shard").applyInPandas(build, "shard int, blob binary, n long"), "filter")

    def maybe(self, df: DataFrame, key: str, state: DataFrame, flag: str = "maybe") -> DataFrame:
        filter_ = self.filter
        placed = self._placed(df, key)
        size = state.agg(F.sum(F.length("blob"))).first()[0] or 0
        if size <= SENT_BYTES:
            blobs = {r["shard"]: r["blob"] for r in state.collect()}
            sent = df.sparkSession.sparkContext.broadcast(blobs)

            @F.pandas_udf("boolean")
            def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
                stack = Stack(filter_, {k: load(filter_, x) for k, x in sent.value.items()})  # once for each task
                for h, shard in batches:
                    yield pd.Series(stack.probe(shard.fillna(-1).to_numpy().astype(np.int64), h.fillna(0).to_numpy()))

            return placed.withColumn(flag, probe("_h", "shard")).drop("_h", "shard")
        salted = state.select("shard", "blob", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        rows = placed.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
        schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{flag}` boolean"
        names = df.columns

        def check(rows: pd.DataFrame, blob: pd.DataFrame) -> pd.DataFrame:
            out = rows[names].copy()
            out[flag] = filter_.probe(load(filter_, blob["blob"].iloc[0]), rows["_h"].to_numpy(np.int64)) if len(blob) and len(rows) else False
            return out

        return rows.groupBy("shard", "_salt").cogroup(salted.groupBy("shard", "_salt")).applyInPandas(check, schema)

    def stats(self, state: DataFrame) -> DataFrame:
        """Shards, keys and bytes of a state, and bits for each key."""
        out = state.agg(F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("n"), F.lit(0)).alias("keys"), F.coalesce(F.sum(F.length("blob")), F.lit(0)).cast("long").alias("bytes"))
        return out.withColumn("bits_per_key", F.when(F.col("keys") > 0, 8 * F.col("bytes") / F.col("keys")))

    def semi_join(self, df: DataFrame, key: str, members: DataFrame, member_key: str) -> DataFrame:
        """Rows of df whose key is among the members, exactly."""
        state = self.state(members.select(F.col(member_key).alias(key)), key)
        rest = self.maybe(df, key, state, "_maybe").filter("_maybe").drop("_maybe")
        return rest.join(members.select(F.col(member_key).alias("_member")), rest[key] == F.col("_member"), "left_semi")

