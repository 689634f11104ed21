"""A cuckoo filter that is updated after it was saved: batches of insertions and deletions meet their shards in a cogroup.

A shard that is full splits: a bit of the fingerprint tells which of two tables an entry belongs to. Both of a key's buckets depend on its
hash and fingerprint alone, so entries keep their places, no key is needed again, and answers stay those of a shard that had as
many tables from the start. What a deletion asks for and a shard lacks is counted, as are insertions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import params
from quern.functions.hashing import Policy, key_hash
from quern.operators.static_filters import SENT_BYTES, SHARD_KEYS, Cuckoo, Stack, cuckoo_told, dump, load
from quern.sources.working import written

U = np.uint64
#: Tables of a shard at most: further bits of the fingerprint stay in use.
DEEPEST = 5
STATE = "shard int, blob binary, n long, inserted long, removed long, missing long, depth int"


class CuckooTree:
    """A shard: 2^depth tables of one geometry; an entry is in the one that the low bits of its fingerprint name."""

    def __init__(self, buckets: int, bits: int, depth: int = 0, tables: list[Cuckoo] | None = None):
        self.buckets, self.bits, self.depth = buckets, bits, depth
        self.tables = tables or [Cuckoo(buckets, bits) for _ in range(1 << depth)]

    def split(self) -> bool:
        """Each table becomes two, by the next bit of the fingerprint; False where no further bit may be spent."""
        if self.depth >= min(DEEPEST, self.bits - 2):
            return False
        out = []
        for bit in (0, 1):
            for t in self.tables:
                cells = np.frombuffer(bytes(t.table), np.uint8)
                mine = np.where((cells >> self.depth) & 1 == bit, cells, 0).astype(np.uint8)
                out.append(Cuckoo(self.buckets, self.bits, table=bytearray(mine.tobytes())))
                for at, own in t.aside:  # what waited finds a place now, or waits on
                    if own >> self.depth & 1 == bit:
                        out[-1]._insert(own, at, out[-1]._other(at, own))
        self.tables, self.depth = out, self.depth + 1
        return True

    @property
    def full(self) -> bool:
        return any(t.full for t in self.tables)

    @property
    def load(self) -> float:
        return sum(t.load for t in self.tables) / len(self.tables)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own, a, b = self.tables[0].places(h)
        return own & ((1 << self.depth) - 1), own, a, b

    def insert_all(self, h: np.ndarray) -> None:
        """A table that is full splits before it takes more; entries without a place are kept aside, so no key is lost."""
        part = 2 * self.buckets  # half of a table at a time, so a split comes in time
        for lo in range(0, len(h), part):
            some = h[lo : lo + part]
            which = self._places(some)[0]
            for k in np.unique(which).tolist():
                self.tables[k].insert_all(some[which == k])
            while self.full and self.split():
                pass

    def contains_all(self, h: np.ndarray) -> np.ndarray:
        out, which = np.zeros(len(h), bool), self._places(h)[0]
        for k in np.unique(which).tolist():
            out[which == k] = self.tables[k].contains_all(h[which == k])
        return out

    def remove_all(self, h: np.ndarray) -> int:
        """How many were there, each once."""
        which, own, a, b = (x.tolist() for x in self._places(h))
        return sum(self.tables[k]._remove(x, p, q) for k, x, p, q in zip(which, own, a, b))

    def state(self) -> dict:
        aside = [(k, *x) for k, t in enumerate(self.tables) for x in t.aside]
        waiting = np.array(aside, np.int64).reshape(-1, 3)
        table = np.frombuffer(b"".join(bytes(t.table) for t in self.tables), np.uint8)
        return {"buckets": self.buckets, "bits": self.bits, "depth": self.depth, "table": table, "of": waiting[:, 0].copy(), "at": waiting[:, 1].copy(), "own": waiting[:, 2].copy()}

    @classmethod
    def read(cls, state: dict) -> CuckooTree:
        size, tables = 4 * state["buckets"], []
        for k in range(1 << state["depth"]):
            mine = state["of"] == k
            tables.append(Cuckoo(state["buckets"], state["bits"], table=bytearray(state["table"][k * size : (k + 1) * size].tobytes()), aside=list(zip(state["at"][mine].tolist(), state["own"][mine].tolist()))))
        return cls(state["buckets"], state["bits"], state["depth"], tables)


@dataclass(frozen=True)
class IncrementalCuckoo:
    """Shards of cuckoo tables, begun for so many keys each. State: shard, blob, n, inserted, removed, missing, depth."""

    keys: int
    shards: int = 1
    fpr: float = 0.04
    policy: Policy = "xxhash64"

    @classmethod
    def sized(cls, n: int, fpr: float = 0.04, policy: Policy = "xxhash64", shard_keys: int = SHARD_KEYS) -> IncrementalCuckoo:
        """For n keys; more of them make shards split."""
        if n < 1:
            raise ValueError("n must be positive")
        shards = -(-n // shard_keys)
        return cls(-(-n // shards), shards, fpr, policy)

    def _empty(self) -> CuckooTree:
        table = Cuckoo.sized(max(1, self.keys), self.fpr)
        return CuckooTree(table.buckets, table.bits)

    def _placed(self, df: DataFrame, key: str) -> DataFrame:
        h = key_hash(F.col(key), self.policy)
        return df.select(h.alias("_h")).filter("_h IS NOT NULL").select(F.pmod(F.shiftright("_h", 40), F.lit(self.shards)).cast("int").alias("shard"), "_h")

    @staticmethod
    def told(state: dict, h: np.ndarray) -> np.ndarray:
        return cuckoo_told(state, h)

    def empty(self, df: DataFrame) -> DataFrame:
        """The state without keys, of df's session."""
        return df.sparkSession.createDataFrame([], STATE).select(params.tagged(F.col("shard"), "shard", self), "blob", "n", "inserted", "removed", "missing", "depth")

    def update(self, state: DataFrame, inserts: DataFrame | None, deletes: DataFrame | None, key: str) -> DataFrame:
        """State after a batch: its deletions, then its insertions. Equal keys count as often as they come."""
        params.same([state], "shard", self)
        batch = None
        for df, gone in ((inserts, False), (deletes, True)):
            if df is not None:
                part = self._placed(df, key).withColumn("_gone", F.lit(gone))
                batch = part if batch is None else batch.unionByName(part)
        if batch is None:
            return state
        given, empty = self, self._empty

        def updated(shard: tuple, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            tree = CuckooTree.read(load(given, old["blob"].iloc[0])) if len(old) else empty()
            n, inserted, removed, missing = (int(old[c].iloc[0]) for c in ("n", "inserted", "removed", "missing")) if len(old) else (0, 0, 0, 0)
            gone, h = rows["_gone"].to_numpy(bool), rows["_h"].to_numpy(np.int64)
            found = tree.remove_all(np.sort(h[gone]).view(U))
            tree.insert_all(np.sort(h[~gone]).view(U))
            new, lacking = int((~gone).sum()), int(gone.sum()) - found
            return pd.DataFrame([(int(shard[0]), dump(given, tree.state()), n + new - found, inserted + new, removed + found, missing + lacking, tree.depth)], columns=["shard", "blob", "n", "inserted", "removed", "missing", "depth"])

        rows = written(state.groupBy("shard").cogroup(batch.groupBy("shard")).applyInPandas(updated, STATE), "cuckoo")
        return rows.select(params.tagged(F.col("shard"), "shard", self), "blob", "n", "inserted", "removed", "missing", "depth")

    def insert(self, state: DataFrame, df: DataFrame, key: str) -> DataFrame:
        return self.update(state, df, None, key)

    def remove(self, state: DataFrame, df: DataFrame, key: str) -> DataFrame:
        return self.update(state, None, df, key)

    def maybe(self, df: DataFrame, key: str, state: DataFrame, flag: str = "maybe") -> DataFrame:
        """df with a flag: False only for keys that are surely not there; null keys are False."""
        params.same([state], "shard", self)
        h = key_hash(F.col(key), self.policy)
        rows = df.withColumn("_h", h).withColumn("_shard", F.pmod(F.shiftright(h, 40), F.lit(self.shards)).cast("int"))
        given = self
        if (state.agg(F.sum(F.length("blob"))).first()[0] or 0) <= SENT_BYTES:
            sent = df.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in state.select("shard", "blob").collect()})

            @F.pandas_udf("boolean")
            def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
                stack = Stack(given, {k: load(given, x) for k, x in sent.value.items()})  # once for each task
                for h, shard in batches:
                    yield pd.Series(stack.probe(shard.fillna(-1).to_numpy().astype(np.int64), h.fillna(0).to_numpy()))

            return rows.withColumn(flag, probe("_h", "_shard")).drop("_h", "_shard")
        keys = rows.select("_shard", "_h").filter("_h IS NOT NULL").distinct()

        def check(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if len(held) and len(asked):
                asked = asked[CuckooTree.read(load(given, held["blob"].iloc[0])).contains_all(asked["_h"].to_numpy(np.int64).view(U))]
            return asked[["_h"]] if len(held) else asked[["_h"]].iloc[:0]

        found = keys.groupBy("_shard").cogroup(state.groupBy("shard")).applyInPandas(check, "_h long").withColumnRenamed("_h", "_found")
        return rows.join(found, F.col("_h") == F.col("_found"), "left").withColumn(flag, F.col("_found").isNotNull()).drop("_h", "_shard", "_found")

    def stats(self, state: DataFrame) -> DataFrame:
        """n, inserted, removed, missing, shards, deepest, bytes of all shards."""
        total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "inserted", "removed", "missing")]
        return state.agg(*total, F.count(F.lit(1)).alias("shards"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"), F.coalesce(F.sum(F.length("blob")), F.lit(0)).cast("long").alias("bytes"))
