"""Set and document similarity: MinHash and its b-bit and weighted kinds, odd sketches, SimHash.

Input: rows (set, item[, weight]). Items are hashed once and folded into slots by aggregates with partial sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import params
from quern.functions.hashing import Policy, key_hash, row_hash
from quern.functions.sizing import power_of_two
from quern.sources.working import written

#: A Mersenne prime: products of two values below it stay below 2^62.
PRIME = (1 << 31) - 1
#: Items whose slots ``MinHash.signature`` makes at a time.
SIGNED = 1 << 15


def coefficients(slot: int) -> tuple[int, int]:
    """Multiplier and shift of a slot's permutation."""
    return (48_271 * (slot + 1) * (slot + 7) + 12_345) % (PRIME - 1) + 1, (69_621 * (slot + 3) * (slot + 11) + 54_321) % PRIME


def _slots(k: int) -> None:
    if k < 1:
        raise ValueError("the number of slots must be positive")


def signatures(state: DataFrame, set_col: str, values: list[str], name: str = "_s", slot: str = "slot") -> DataFrame:
    """set, and an array of its slots' values: a set moves as one row."""
    value = F.col(values[0]) if len(values) == 1 else F.struct(*values)
    rows = state.groupBy(set_col).agg(F.sort_array(F.collect_list(F.struct(F.col(slot).alias("slot"), value.alias("value")))).alias("_x"))
    return rows.select(set_col, F.transform("_x", lambda x: x["value"]).alias(name))


def beside(sets: DataFrame, pairs: DataFrame, set_col: str, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with a column of both sets, under its name and _a or _b."""
    side = lambda x, end: sets.select(F.col(set_col).alias(x), F.col(name).alias(f"{name}_{end}"))
    return pairs.select(a, b).join(side(a, "a"), a).join(side(b, "b"), b)


#: Queries and sets of one block of ``every_pair``.
BLOCK = 1_024


def equal_slots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of a query's values x and the columns y of sets: how many are equal."""
    total = np.zeros(y.shape[1], np.int64)
    for lo in range(0, len(x), 255):  # sums that fit into bytes
        total += np.add.reduce((y[lo : lo + 255] == x[lo : lo + 255, None]).view(np.uint8), axis=0, dtype=np.uint8)
    return total


def differing_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    other = y ^ x[:, None]
    # Of signed numbers those of the absolute value would be counted.
    return np.add.reduce(np.bitwise_count(other.view(f"u{other.dtype.itemsize}")), axis=0, dtype=np.int64)


def every_pair(sets: DataFrame, asked: str, set_col: str, compare: Callable[[np.ndarray, np.ndarray], np.ndarray], common: DataFrame | None = None, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """a, b, n: each of the sets that are asked for (a condition) beside each other one, compared in blocks of bounded size, so no pair moves.

    sets: set, _x (an array of whole numbers, as long for each set) and, with common, _w; compare takes a query's values and a block's, a column for each set.
    common: rows a, b, _m of the pairs that have more to tell; then _w of both sides and _m, 0 for other pairs, stand in the row as well.
    most: pairs with a larger n are left out.
    """
    kind = dict(sets.dtypes)[set_col]
    sets = written(sets.filter(F.col(set_col).isNotNull()), "compared")
    queries, width = sets.filter(asked), max(1, block)
    across, down = (max(1, -(-df.count() // width)) for df in (queries, sets))
    place = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    weighted = common is not None
    given = ["_x", "_w"] if weighted else ["_x"]
    left = queries.select(F.col(set_col).alias("a"), F.lit(None).cast(kind).alias("b"), *given, *([F.lit(None).cast("double").alias("_m")] if weighted else []), place(set_col, across).alias("_q"), every(down).alias("_r"))
    if weighted:
        none = [F.lit(None).cast(dict(sets.dtypes)[c]).alias(c) for c in given]
        left = left.unionByName(common.select("a", "b", *none, F.col("_m").cast("double").alias("_m"), place("a", across).alias("_q"), place("b", down).alias("_r")))
    right = sets.select(F.col(set_col).alias("b"), *[F.col(c).alias(f"_own{c}") for c in given], place(set_col, down).alias("_r"), every(across).alias("_q"))

    def values(rows: pa.Table, name: str) -> np.ndarray:
        return pc.list_flatten(rows.column(name)).to_numpy().reshape(len(rows), -1)

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        own = one.filter(pc.is_null(one.column("b")))
        a, b = (t.column(c).combine_chunks() for t, c in ((own, "a"), (other, "b")))
        rows, cols, counts, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(a) and len(b):
            x, y = values(own, "_x"), np.ascontiguousarray(values(other, "_own_x").T)
            at = lambda ids, among: pc.fill_null(pc.index_in(ids, value_set=among), -1).to_numpy(zero_copy_only=False)
            itself = at(a, b)
            if weighted:
                more = one.filter(pc.is_valid(one.column("b")))
                m = more.column("_m").to_numpy()
                i, j = at(more.column("a").combine_chunks(), a), at(more.column("b").combine_chunks(), b)
                order = np.argsort(i, kind="stable")
                i, j, m = i[order], j[order], m[order]
                ends = np.searchsorted(i, np.arange(len(a) + 1))
            for k in range(len(a)):
                n = compare(x[k], y)
                keep = np.ones(len(b), bool) if most is None else n <= most
                if itself[k] >= 0:
                    keep[itself[k]] = False
                beside = np.flatnonzero(keep)
                rows.append(np.full(len(beside), k))
                cols.append(beside)
                counts.append(n[beside])
                if weighted:
                    line = np.zeros(len(b))
                    line[j[ends[k] : ends[k + 1]]] = m[ends[k] : ends[k + 1]]
                    sums.append(line[beside])
        i, j = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
        out = {"a": a.take(i), "b": b.take(j), "n": pa.array(np.concatenate(counts))}
        if weighted:
            out |= {"_wa": own.column("_w").take(i), "_wb": other.column("_own_w").take(j), "_m": pa.array(np.concatenate(sums))}
        return pa.table(out)

    schema = f"a {kind}, b {kind}, n long" + (", _wa double, _wb double, _m double" if weighted else "")
    return left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInArrow(run, schema)


def _equal_share(state: DataFrame, pairs: DataFrame, set_col: str, values: list[str], k: int, a: str, b: str) -> DataFrame:
    both = beside(signatures(state, set_col, values), pairs, set_col, "_s", a, b)
    same = F.aggregate(F.zip_with("_s_a", "_s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return both.select(a, b, (same / k).alias("jaccard"))


def banded(state: DataFrame, set_col: str, rows: int, value: str = "value") -> DataFrame:
    """set, band, bucket: sets whose slots of a band agree share its bucket. rows: slots to a band."""
    parts = state.groupBy(set_col, F.floor(F.col("slot") / rows).cast("int").alias("band")).agg(F.sort_array(F.collect_list(F.struct("slot", value))).alias("_x"))
    return parts.select(set_col, "band", F.xxhash64(F.transform("_x", lambda x: x[value])).alias("bucket"))


def met(queries: DataFrame, buckets: DataFrame, set_col: str, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of a query and another set that share a bucket. queries, buckets: rows (set, band, bucket)."""
    x = queries.select(F.col(set_col).alias(a), "band", "bucket")
    y = buckets.select(F.col(set_col).alias(b), "band", "bucket")
    return x.join(y, ["band", "bucket"]).filter(F.col(a) != F.col(b)).select(a, b).distinct()


@dataclass(frozen=True)
class MinHash:
    """State: set, slot, value."""

    k: int = 128
    policy: Policy = "xxhash64"

    def __post_init__(self) -> None:
        _slots(self.k)

    def state(self, df: DataFrame, set_col: str, item: str) -> DataFrame:
        x = key_hash(item, self.policy) % PRIME
        items = df.filter(F.col(item).isNotNull()).select(set_col, x.alias("_x")).distinct()
        least = [F.min((F.lit(a).cast("bigint") * F.col("_x") + F.lit(b).cast("bigint")) % PRIME).alias(f"_{i}") for i, (a, b) in enumerate(map(coefficients, range(self.k)))]
        signature = items.groupBy(set_col).agg(*least).select(set_col, F.array(*[f"_{i}" for i in range(self.k)]).alias("_s"))
        return signature.select(set_col, F.posexplode("_s").alias("_slot", "value")).select(set_col, params.tagged(F.col("_slot"), "slot", self), "value")

    def signature(self, items: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row of all slots' values for each set, as ``state`` has them: items are hashes by the policy, side by side; ends has the n + 1 places at which sets begin. No set may be empty."""
        out, lo = np.empty((len(ends) - 1, self.k), np.int32), 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SIGNED, "right")) - 1)
            x, starts = items[ends[lo] : ends[hi]] % PRIME, ends[lo:hi] - ends[lo]
            for i, (a, b) in enumerate(map(coefficients, range(self.k))):
                v = x * a + b
                for _ in range(2):  # modulo a Mersenne prime
                    v = (v & PRIME) + (v >> 31)
                v[v == PRIME] = 0
                out[lo:hi, i] = np.minimum.reduceat(v, starts)
            lo = hi
        return out

    def merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Raises MismatchError where the states differ in size or policy."""
        params.same([a, b], "slot", self)
        return a.unionByName(b).groupBy(*[c for c in a.columns if c != "value"]).agg(F.min("value").alias("value"))

    def jaccard(self, state: DataFrame, pairs: DataFrame, set_col: str, a: str = "a", b: str = "b") -> DataFrame:
        """pairs with the share of equal slots."""
        return _equal_share(state, pairs, set_col, ["value"], self.k, a, b)

    def search(self, state: DataFrame, asked: str, set_col: str) -> DataFrame:
        """a, b, jaccard: every set that is asked for beside every other one."""
        slots = signatures(state, set_col, ["value"], "_x").withColumn("_x", F.col("_x").cast("array<int>"))
        return every_pair(slots, asked, set_col, equal_slots).select("a", "b", (F.col("n") / self.k).alias("jaccard"))


@dataclass(frozen=True)
class BBitMinHash:
    """The low bits of a MinHash signature. Packed signatures compare, but no longer merge."""

    k: int = 128
    bits: int = 2
    policy: Policy = "xxhash64"

    def __post_init__(self) -> None:
        _slots(self.k)
        if not 1 <= self.bits <= 8:
            raise ValueError("bits must lie in 1..8")

    def state(self, df: DataFrame, set_col: str, item: str) -> DataFrame:
        full = MinHash(self.k, self.policy).state(df, set_col, item)
        return full.withColumn("value", F.col("value") % (1 << self.bits))

    def jaccard(self, state: DataFrame, pairs: DataFrame, set_col: str, a: str = "a", b: str = "b") -> DataFrame:
        """Chance agreement of the low bits is taken out."""
        return self._corrected(MinHash(self.k, self.policy).jaccard(state, pairs, set_col, a, b))

    def search(self, state: DataFrame, asked: str, set_col: str) -> DataFrame:
        """a, b, jaccard: every set that is asked for beside every other one."""
        slots = signatures(state, set_col, ["value"], "_x").withColumn("_x", F.col("_x").cast("array<short>"))
        return self._corrected(every_pair(slots, asked, set_col, equal_slots).select("a", "b", (F.col("n") / self.k).alias("jaccard")))

    def packed(self, state: DataFrame, set_col: str) -> DataFrame:
        """set, and its values as a binary of bits * k bits, the first slot's lowest bit first."""
        digits = F.transform("_s", lambda v: F.reverse(F.lpad(F.bin(v), self.bits, "0")))
        text = F.rpad(F.concat_ws("", digits), -(-self.k * self.bits // 8) * 8, "0")
        octets = F.transform(F.sequence(F.lit(0), F.lit(-(-self.k * self.bits // 8) - 1)), lambda i: F.lpad(F.conv(F.reverse(F.substring(text, i * 8 + 1, F.lit(8))), 2, 16), 2, "0"))
        return signatures(state, set_col, ["value"]).select(set_col, F.unhex(F.concat_ws("", octets)).alias("packed"))

    def _corrected(self, raw: DataFrame) -> DataFrame:
        chance = 2.0**-self.bits
        return raw.withColumn("jaccard", F.greatest(F.lit(0.0), (F.col("jaccard") - chance) / (1 - chance)))


@dataclass(frozen=True)
class WeightedMinHash:
    """Consistent weighted sampling: state set, slot, item (its hash), t. Slots agree with the probability of the weighted Jaccard."""

    k: int = 128
    policy: Policy = "xxhash64"

    def __post_init__(self) -> None:
        _slots(self.k)

    def state(self, df: DataFrame, set_col: str, item: str, weight: str) -> DataFrame:
        """Numbers of an item's slots are drawn once in a batch of rows; of each set only the least of each slot leave a task."""
        given = df.filter(F.col(item).isNotNull() & (F.col(weight) > 0)).groupBy(set_col, item).agg(F.sum(F.col(weight).cast("double")).alias("_w"))
        rows = given.select(F.col(set_col).alias("set"), key_hash(item, self.policy).alias("h"), F.log("_w").alias("w"))
        kind = dict(df.dtypes)[set_col]
        parts = rows.mapInArrow(_least_samples(self.k), f"set {kind}, slot array<int>, a array<double>, item array<long>, t array<long>")
        each = parts.select("set", F.explode(F.arrays_zip("slot", "a", "item", "t")).alias("x")).select(F.col("set").alias(set_col), "x.*")
        least = each.groupBy(set_col, "slot").agg(F.min(F.struct("a", "item", "t")).alias("_m"))
        return least.select(set_col, params.tagged(F.col("slot"), "slot", self), "_m.a", "_m.item", "_m.t")

    def merge(self, a: DataFrame, b: DataFrame, set_col: str) -> DataFrame:
        """Raises MismatchError where the states differ in size or policy."""
        params.same([a, b], "slot", self)
        return a.unionByName(b).groupBy(set_col, "slot").agg(F.min(F.struct("a", "item", "t")).alias("_m")).select(set_col, "slot", "_m.a", "_m.item", "_m.t")

    def jaccard(self, state: DataFrame, pairs: DataFrame, set_col: str, a: str = "a", b: str = "b") -> DataFrame:
        return _equal_share(state, pairs, set_col, ["item", "t"], self.k, a, b)

    def search(self, state: DataFrame, asked: str, set_col: str, whole: DataFrame, common: DataFrame) -> DataFrame:
        """a, b, jaccard, exact: every set that is asked for beside every other one; a slot's sample is known by 64 bits.

        whole: rows set, w of the sets' weights. common: rows a, b, m of the sums of least weights, where those are positive.
        """
        hashed = state.withColumn("_h", F.xxhash64("item", "t"))
        slots = signatures(hashed, set_col, ["_h"], "_x").join(whole.select(set_col, F.col("w").cast("double").alias("_w")), set_col)
        got = every_pair(slots, asked, set_col, equal_slots, common.select("a", "b", F.col("m").alias("_m")))
        return got.select("a", "b", (F.col("n") / self.k).alias("jaccard"), (F.col("_m") / (F.col("_wa") + F.col("_wb") - F.col("_m"))).alias("exact"))


#: Sets whose least samples a task holds at a time.
HELD_SETS = 2_048
_U = np.uint64


def _uniform(h: np.ndarray, k: int, draw: int) -> np.ndarray:
    """Numbers in (0, 1) of each hash and slot."""
    x = h[:, None] + (np.arange(k, dtype=_U) * _U(8) + _U(draw))[None, :] * _U(0x9E3779B97F4A7C15)
    moved = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x ^= np.right_shift(x, _U(shift), out=moved)
        x *= _U(factor)
    out = np.right_shift(x, _U(11), out=moved).astype(np.float64)
    out *= 2.0**-53
    out += 2.0**-54
    return out


def _draws(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, the logarithm of c, and beta of each hash and slot."""
    r, c, more = _uniform(h, k, 1), _uniform(h, k, 3), _uniform(h, k, 2)
    r *= more
    c *= _uniform(h, k, 4)
    for x in (r, c):
        np.negative(np.log(x, out=x), out=x)
    return r, np.log(c, out=c), _uniform(h, k, 5)


def least_samples(items: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one set's items (their hashes and logarithms of weights) each slot's least sample: its value, its item and t."""
    r, c, b = _draws(items.astype(_U), k)
    t = w[:, None] / r
    np.floor(np.add(t, b, out=t), out=t)
    np.subtract(t, b, out=b)
    b += 1
    b *= r
    a = np.subtract(c, b, out=c)
    least, slots = a.argmin(0), np.arange(k)
    return a[least, slots], items[least], t[least, slots].astype(np.int64)


def _least_samples(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            sets, best = list(held), list(held.values())
            held.clear()
            columns = [pa.array(sets, kind), pa.array([list(range(k))] * len(sets), pa.list_(pa.int32()))]
            columns += [pa.array([x[i].tolist() for x in best], pa.list_(t)) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["set", "slot", "a", "item", "t"])

        for batch in batches:
            kind = batch.schema.field("set").type
            items = batch.column("h").to_numpy(zero_copy_only=False)
            h, place = np.unique(items.astype(_U), return_inverse=True)
            r, c, b = _draws(h, k)
            w = batch.column("w").to_numpy(zero_copy_only=False)
            codes = batch.column("set").dictionary_encode()
            names, code = codes.dictionary.to_pylist(), codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]])) if len(order) else []
            for lo, hi in zip(first, [*first[1:], len(order)]):
                own = order[lo:hi]
                at = place[own]
                t = np.floor(w[own, None] / r[at] + b[at])
                a = c[at] - r[at] * (t - b[at] + 1)
                least = a.argmin(0)
                new = (a[least, np.arange(k)], items[own[least]], t[least, np.arange(k)].astype(np.int64))
                key = names[code[own[0]]] if code[own[0]] < len(names) else None
                old = held.get(key)
                if old is None:
                    held[key] = new
                else:
                    less = new[0] < old[0]
                    held[key] = tuple(np.where(less, x, y) for x, y in zip(new, old))
                if len(held) >= HELD_SETS:
                    yield out()
        if held:
            yield out()

    return run


@dataclass(frozen=True)
class OddSketch:
    """Parities of hashed items: state set, word, value (32 bits each). XOR of two states is that of the symmetric difference."""

    m: int = 4096
    policy: Policy = "xxhash64"

    @classmethod
    def sized(cls, m: int, policy: Policy = "xxhash64") -> OddSketch:
        if m < 1:
            raise ValueError("m must be positive")
        return cls(power_of_two(max(64, m)), policy)

    def state(self, df: DataFrame, set_col: str, item: str) -> DataFrame:
        pos = key_hash(item, self.policy) % self.m
        items = df.filter(F.col(item).isNotNull()).select(set_col, item).distinct().withColumn("_p", pos)
        bit = F.expr("shiftleft(1L, cast(_p % 32 as int))")
        return items.groupBy(set_col, params.tagged(F.floor(F.col("_p") / 32), "word", self)).agg(F.bit_xor(bit).alias("value"))

    def merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Raises MismatchError where the states differ in size or policy."""
        params.same([a, b], "word", self)
        return a.unionByName(b).groupBy(*[c for c in a.columns if c != "value"]).agg(F.bit_xor("value").alias("value"))

    def size(self, odd: Column) -> Column:
        """Items behind so many odd bits; infinite beyond half of the bits."""
        return F.when(odd >= self.m / 2, float("inf")).otherwise(F.log(1 - 2 * odd / F.lit(float(self.m))) / F.log(F.lit(1 - 2 / self.m)))

    def cardinality(self, state: DataFrame, set_col: str) -> DataFrame:
        return state.groupBy(set_col).agg(F.sum(F.bit_count("value")).alias("odd")).withColumn("estimate", self.size(F.col("odd")))

    def dense(self, state: DataFrame, set_col: str) -> DataFrame:
        """set, and an array of all its words."""
        words = state.groupBy(set_col).agg(F.map_from_entries(F.collect_list(F.struct("word", "value"))).alias("_m"))
        return words.select(set_col, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max(1, self.m // 32) - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long"))).alias("_s"))

    def difference(self, state: DataFrame, pairs: DataFrame, set_col: str, a: str = "a", b: str = "b") -> DataFrame:
        """pairs with their odd bits and the size of their symmetric difference."""
        both = beside(self.dense(state, set_col), pairs, set_col, "_s", a, b)
        odd = F.aggregate(F.zip_with("_s_a", "_s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("long"), lambda n, x: n + x)
        return both.select(a, b, odd.alias("odd")).withColumn("estimate", self.size(F.col("odd")))

    def search(self, state: DataFrame, asked: str, set_col: str) -> DataFrame:
        """a, b, odd, estimate: every set that is asked for beside every other one."""
        signed = lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int")
        words = self.dense(state, set_col).select(set_col, F.transform("_s", signed).alias("_x"))
        return every_pair(words, asked, set_col, differing_bits).select("a", "b", F.col("n").alias("odd")).withColumn("estimate", self.size(F.col("odd")))


@dataclass(frozen=True)
class SimHash:
    """60 signed sums of item weights; a set's fingerprint has the bits of the positive ones."""

    policy: Policy = "xxhash64"
    bits: int = 60

    def state(self, df: DataFrame, set_col: str, item: str, weight: str | None = None) -> DataFrame:
        """set, and an array of sums; integer weights keep the sums exact."""
        w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
        items = df.filter(F.col(item).isNotNull()).groupBy(set_col, item).agg(F.sum(w).alias("_w")).withColumn("_h", key_hash(item, self.policy))
        sums = [F.sum(F.when(F.shiftright("_h", i).bitwiseAND(F.lit(1).cast("bigint")) == 1, F.col("_w")).otherwise(-F.col("_w"))).alias(f"_{i}") for i in range(self.bits)]
        return items.groupBy(set_col).agg(*sums).select(set_col, params.tagged(F.array(*[f"_{i}" for i in range(self.bits)]), "sums", self))

    def merge(self, a: DataFrame, b: DataFrame, set_col: str) -> DataFrame:
        """Raises MismatchError where the states differ in bits or policy."""
        params.same([a, b], "sums", self)
        both = a.unionByName(b)
        return both.groupBy(set_col).agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"_{i}") for i in range(self.bits)]).select(set_col, F.array(*[f"_{i}" for i in range(self.bits)]).alias("sums"))

    def bands(self, prints: DataFrame, set_col: str, bands: int = 4, name: str = "fingerprint") -> DataFrame:
        """set, band, bucket: of two fingerprints that differ in fewer bits than there are bands some band agrees."""
        width = -(-self.bits // bands)
        each = F.posexplode(F.array(*[F.shiftright(name, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")) for i in range(bands)])).alias("band", "bucket")
        return prints.select(set_col, each)

    def fingerprint(self, state: DataFrame, name: str = "fingerprint") -> DataFrame:
        total = None
        for i in range(self.bits):
            bit = F.when(F.get("sums", F.lit(i)) > 0, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            total = bit if total is None else total + bit
        return state.withColumn(name, total).drop("sums")

    def distance(self, a: Column, b: Column) -> Column:
        return F.bit_count(a.bitwiseXOR(b))

    def similarity(self, a: Column, b: Column) -> Column:
        """The cosine that this many differing bits stand for."""
        return self.cosine(self.distance(a, b))

    def cosine(self, distance: Column) -> Column:
        return F.cos(F.lit(3.141592653589793) * distance / self.bits)

    def search(self, prints: DataFrame, asked: str, set_col: str, name: str = "fingerprint", most: int | None = None, block: int = 4 * BLOCK) -> DataFrame:
        """a, b, distance, similarity: every set that is asked for beside every other one, or those that differ in so many bits at most."""
        given = prints.select(set_col, F.array(name).alias("_x"), F.expr(asked).alias("_asked"))
        block = block if most is not None else BLOCK
        return every_pair(given, "_asked", set_col, differing_bits, most=most, block=block).select("a", "b", F.col("n").alias("distance"), self.cosine(F.col("n")).alias("similarity"))
