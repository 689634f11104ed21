"""Membership filters whose state is rows: Bloom and its counting, scalable and blocked kinds, quotient, learned.

States group and merge with ordinary aggregates. Where a filter is probed, a state of a known bounded size
is sent to the executors as a bit array; a larger one is joined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import params
from quern.functions.hashing import Policy, column, key_hash, lanes, positions
from quern.functions.sizing import blocked_bloom_params, bloom_params, power_of_two
from quern.sources.working import written

#: The largest bit array that is sent to all executors.
SENT_BYTES = 64 << 20


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter's size, number of hashes and hash policy."""

    m: int
    k: int
    policy: Policy = "xxhash64"

    @classmethod
    def sized(cls, n: int, fpr: float = 0.01, policy: Policy = "xxhash64") -> Bloom:
        p = bloom_params(n, fpr)
        return cls(p.m, p.k, policy)

    def bits(self, df: DataFrame, key: Column | str, group: list[str] | None = None) -> DataFrame:
        """State: group, bit. Equal keys are dropped before they are multiplied by the number of hashes."""
        group = group or []
        keys = df.filter(column(key).isNotNull()).select(*group, column(key).alias("_key")).distinct()
        return keys.select(*group, F.explode(positions(key_hash("_key", self.policy), self.k, self.m)).alias("_bit")).select(*group, params.tagged(F.col("_bit"), "bit", self)).distinct()

    def words(self, bits: DataFrame, group: list[str] | None = None) -> DataFrame:
        """The same state in 64-bit words: group, word, value."""
        group = group or []
        return bits.groupBy(*group, F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("value"))

    def stats(self, bits: DataFrame, group: list[str] | None = None) -> DataFrame:
        """Bits set, fill ratio and the share of false positives to expect at that fill."""
        agg = bits.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("bits_set"))
        return agg.withColumn("fill_ratio", F.col("bits_set") / self.m).withColumn("expected_fpr", F.pow(F.col("fill_ratio"), self.k))

    def compatible(self, other: Bloom) -> None:
        if (self.m, self.k, self.policy) != (other.m, other.k, other.policy):
            raise ValueError("filters differ in size, hashes or policy")

    def maybe(self, df: DataFrame, key: Column | str, bits: DataFrame, flag: str = "maybe") -> DataFrame:
        """df with a flag: False only for keys that were surely not inserted; null keys are False."""
        if self.m // 8 <= SENT_BYTES:
            params.same([bits], "bit", self)
            array, words = np.zeros(self.m // 64 or 1, np.int64), self.words(bits).toArrow()  # at most m / 64 rows, in columns
            array[words.column("word").to_numpy()] = words.column("value").to_numpy()
            sent = df.sparkSession.sparkContext.broadcast(array.view(np.uint64))
            k, m = self.k, self.m

            @F.pandas_udf("boolean")
            def probe(h: pd.Series) -> pd.Series:
                words, null = sent.value, h.isna().to_numpy()
                h = h.fillna(0).to_numpy().astype(np.int64)
                a, b = h % (1 << 30), (h >> 30) | 1
                out = ~null
                for i in range(k):
                    at = (a + i * b) % m
                    out &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                return pd.Series(out)

            return df.withColumn(flag, probe(key_hash(key, self.policy)))
        keys = df.select(column(key).alias("_key")).filter("_key IS NOT NULL").distinct()
        hits = keys.select("_key", F.explode(positions(key_hash("_key", self.policy), self.k, self.m)).alias("bit")).distinct()
        need = hits.groupBy("_key").agg(F.count(F.lit(1)).alias("need"))
        got = hits.join(bits.select("bit"), "bit").groupBy("_key").agg(F.count(F.lit(1)).alias("got"))
        found = need.join(got, "_key").filter("need = got").select("_key", F.lit(True).alias("_hit"))
        return df.join(found, column(key) == F.col("_key"), "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")

    def semi_join(self, df: DataFrame, key: str, members: DataFrame, member_key: str) -> DataFrame:
        """Rows of df whose key is among the members: the filter drops most others before the exact join."""
        rest = self.maybe(df, key, self.bits(members, member_key), "_maybe").filter("_maybe").drop("_maybe")
        return rest.join(members.select(F.col(member_key).alias("_member")), rest[key] == F.col("_member"), "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of states of equal parameters, as for one filter over both inputs; raises MismatchError where they differ."""
    params.same([a, b], "bit")
    params.same([a, b], "q")
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of states of equal parameters; raises MismatchError where they differ."""
    params.same([a, b], "bit")
    params.same([a, b], "q")
    return a.intersect(b.select(*a.columns))


# Counting Bloom filter: state group, pos, count, counters end at LIMIT and then stay.
LIMIT = 255


def counting(bloom: Bloom, df: DataFrame, key: Column | str, group: list[str] | None = None, sign: Column | None = None) -> DataFrame:
    """Inserts rows where sign is positive, then removes those where it is negative."""
    group = group or []
    sign = F.lit(1) if sign is None else sign
    keys = df.filter(column(key).isNotNull()).select(*group, column(key).alias("_key"), sign.alias("_sign"))
    keys = keys.groupBy(*group, "_key").agg(F.sum(F.greatest("_sign", F.lit(0))).alias("up"), F.sum(F.greatest(-F.col("_sign"), F.lit(0))).alias("down"))
    cells = keys.select(*group, "up", "down", F.explode(positions(key_hash("_key", bloom.policy), bloom.k, bloom.m)).alias("_pos"))
    cells = cells.select(*group, "up", "down", params.tagged(F.col("_pos"), "pos", bloom))
    sums = cells.groupBy(*group, "pos").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    count = F.when(F.col("up") >= LIMIT, LIMIT).otherwise(F.greatest(F.col("up") - F.col("down"), F.lit(0)))
    return sums.select(*group, "pos", count.cast("int").alias("count")).filter("count > 0")


def counting_maybe(bloom: Bloom, df: DataFrame, key: str, state: DataFrame, flag: str = "maybe") -> DataFrame:
    """df with a flag: True where all counters of the key are above 0, as after its insertion; null keys are False."""
    params.same([state], "pos", bloom)
    return bloom.maybe(df, key, state.select(params.untagged(F.col("pos"), "bit")), flag)


def counting_remove(bloom: Bloom, state: DataFrame, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The state without keys of df that it may hold, and df with a flag ``removed``; keys that it surely lacks change nothing.

    A key goes as often as df has it. Counters at LIMIT stay there.
    """
    rows = counting_maybe(bloom, df, key, state, "removed")
    gone = rows.filter("removed").groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    cells = gone.select("_n", F.explode(positions(key_hash("_key", bloom.policy), bloom.k, bloom.m)).alias("pos")).groupBy("pos").agg(F.sum("_n").alias("_n"))
    left = state.join(cells, "pos", "left")
    count = F.when(F.col("count") >= LIMIT, LIMIT).otherwise(F.greatest(F.col("count") - F.coalesce("_n", F.lit(0)), F.lit(0))).cast("int")
    return left.withColumn("count", count).drop("_n").filter("count > 0").select(*state.columns), rows


def counting_stats(bloom: Bloom, state: DataFrame) -> DataFrame:
    """Counters in use and at LIMIT, their share of all, and false positives to expect."""
    out = state.agg(F.count(F.lit(1)).alias("used"), F.sum((F.col("count") >= LIMIT).cast("long")).alias("at_limit"))
    return out.withColumn("fill_ratio", F.col("used") / bloom.m).withColumn("expected_fpr", F.pow(F.col("fill_ratio"), bloom.k))


def counting_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """As for one filter over both inputs: counters add up to LIMIT."""
    params.same([a, b], "pos")
    keys = [c for c in a.columns if c != "count"]
    return a.unionByName(b).groupBy(*keys).agg(F.least(F.sum("count"), F.lit(LIMIT)).cast("int").alias("count"))


def counting_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise maximum."""
    params.same([a, b], "pos")
    keys = [c for c in a.columns if c != "count"]
    return a.unionByName(b).groupBy(*keys).agg(F.max("count").alias("count"))


def counting_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise minimum."""
    params.same([a, b], "pos")
    keys = [c for c in a.columns if c != "count"]
    return a.join(b.withColumnRenamed("count", "_other"), keys).select(*keys, F.least("count", "_other").alias("count"))


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """df with a number from 1 in the given order, without putting all rows into one task.

    Rows are dealt over ranges once and written with their range and their place in it; sizes of the ranges are
    counted from what was written, so they belong to the same ranges whatever the columns.
    """
    place = F.monotonically_increasing_id()  # the partition's number in the upper bits, the row's in the lower 33
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), "numbered")
    rows = rows.withColumn("_range", F.shiftright("_place", 33))
    before = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))  # a row for each task
    before = before.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    number = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("_before")
    return rows.join(F.broadcast(before), "_range").withColumn(name, number).drop("_range", "_place", "_before")


@dataclass(frozen=True)
class Scalable:
    """A row of Bloom filters: stage i for first * growth^i keys at fpr * (1 - ratio) * ratio^i."""

    first: int
    fpr: float = 0.01
    growth: int = 2
    ratio: float = 0.8
    policy: Policy = "xxhash64"

    def __post_init__(self) -> None:
        if self.first < 1 or self.growth < 1 or not 0 < self.fpr < 1 or not 0 < self.ratio < 1:
            raise ValueError("first and growth must be positive, fpr and ratio between 0 and 1")

    def capacity(self, stage: int) -> int:
        return self.first * self.growth**stage

    def filter(self, stage: int) -> Bloom:
        return Bloom.sized(self.capacity(stage), self.fpr * (1 - self.ratio) * self.ratio**stage, self.policy)

    def stages(self, n: int) -> int:
        """Stages in use for n keys."""
        out, left = 1, n - self.first
        while left > 0:
            left -= self.capacity(out)
            out += 1
        return out

    def stage_of(self, number: Column, n: int) -> Column:
        """The stage that the key with this number, from 1, goes to."""
        total, out = 0, None
        for i in range(self.stages(n)):
            total += self.capacity(i)
            out = F.when(number <= total, F.lit(i)) if out is None else out.when(number <= total, F.lit(i))
        return out

    def bits(self, df: DataFrame, key: str, order: list[Column]) -> DataFrame:
        """State: stage, bit. Distinct keys in the order of their first appearance."""
        keys = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order)).alias("_first"))
        n = keys.count()
        placed = numbered(keys, [F.col("_first"), F.col("_key")]).withColumn("stage", self.stage_of(F.col("n"), max(1, n)))
        out = None
        for i in range(self.stages(max(1, n))):
            part = self.filter(i).bits(placed.filter(F.col("stage") == i), "_key").select(F.lit(i).alias("stage"), params.untagged(F.col("bit"), "bit"))
            out = part if out is None else out.unionByName(part)
        return out

    def maybe(self, df: DataFrame, key: str, state: DataFrame, stages: int, flag: str = "maybe") -> DataFrame:
        """True where any stage has the key, newest first."""
        out, flags = df, []
        for i in reversed(range(stages)):
            out = self.filter(i).maybe(out, key, state.filter(F.col("stage") == i).select("bit"), f"_stage{i}")
            flags.append(f"_stage{i}")
        hit = F.lit(False)
        for f in flags:
            hit = hit | F.col(f)
        return out.withColumn(flag, hit).drop(*flags)

    def combine(self, a: DataFrame, b: DataFrame, how: str = "union") -> DataFrame:
        """Union or intersection stage by stage, of states with as many stages."""
        if {r[0] for r in a.select("stage").distinct().collect()} != {r[0] for r in b.select("stage").distinct().collect()}:
            raise ValueError("states differ in their stages")
        return union(a, b) if how == "union" else intersection(a, b)

    def fill_ratio(self, state: DataFrame) -> DataFrame:
        """The mean over the stages."""
        sizes = {r["stage"]: r["n"] / self.filter(r["stage"]).m for r in state.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).collect()}
        return state.sparkSession.createDataFrame([(sum(sizes.values()) / max(1, len(sizes)),)], "fill_ratio double")

    def expected_fpr(self, stages: int) -> float:
        miss = 1.0
        for i in range(stages):
            miss *= 1 - self.fpr * (1 - self.ratio) * self.ratio**i
        return 1 - miss


@dataclass(frozen=True)
class Blocked:
    """A Bloom filter whose hashes of a key all fall into one block of 512 bits: a probe meets its block in one equi-join."""

    blocks: int
    k: int
    policy: Policy = "xxhash64"

    @classmethod
    def sized(cls, n: int, fpr: float = 0.01, policy: Policy = "xxhash64") -> Blocked:
        p = blocked_bloom_params(n, fpr)
        return cls(p.blocks, p.k, policy)

    def places(self, key: Column) -> tuple[Column, Column]:
        """Block, and bits in it."""
        a, b = lanes(key_hash(key, self.policy))
        # The block takes the low bits of one lane, the first bit its upper ones; the odd step comes from the other lane.
        first = F.shiftright(a, self.blocks.bit_length() - 1)
        bits = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(self.k - 1).cast("bigint")), lambda i: (first + i * b) % 512)
        return a % self.blocks, F.array_distinct(bits)

    def state(self, df: DataFrame, key: Column | str) -> DataFrame:
        """block, bit."""
        keys = df.filter(column(key).isNotNull()).select(column(key).alias("_key")).distinct()
        block, bits = self.places(F.col("_key"))
        return keys.select(params.tagged(block, "block", self), F.explode(bits).alias("bit")).distinct()

    def stats(self, state: DataFrame) -> DataFrame:
        """Blocks in use, bits set, their share of all, and false positives to expect from the blocks' own fills."""
        each = state.groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
        out = each.agg(F.count(F.lit(1)).alias("blocks_used"), F.sum("_n").alias("bits_set"), F.sum(F.pow(F.col("_n") / 512, self.k)).alias("_p"))
        return out.select("blocks_used", "bits_set", (F.col("bits_set") / (512 * self.blocks)).alias("fill_ratio"), (F.col("_p") / self.blocks).alias("expected_fpr"))

    def union(self, a: DataFrame, b: DataFrame) -> DataFrame:
        params.same([a, b], "block", self)
        return a.unionByName(b).distinct()

    def intersection(self, a: DataFrame, b: DataFrame) -> DataFrame:
        params.same([a, b], "block", self)
        return a.intersect(b.select(*a.columns))

    def maybe(self, df: DataFrame, key: str, state: DataFrame, flag: str = "maybe") -> DataFrame:
        """One row of bits for each block meets all keys of the block."""
        held = state.groupBy("block").agg(F.collect_set("bit").alias("_bits"))  # 512 at most
        block, bits = self.places(F.col(key))
        out = df.withColumn("_block", block).withColumn("_need", bits).join(held, F.col("_block") == F.col("block"), "left")
        hit = F.size(F.array_except("_need", F.coalesce("_bits", F.array().cast("array<bigint>")))) == 0
        return out.withColumn(flag, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).drop("_block", "_need", "block", "_bits")


@dataclass(frozen=True)
class Quotient:
    """A quotient filter as rows (q, r): sets of pairs, so union, intersection and deletion are set operations."""

    q: int
    r: int = 13
    policy: Policy = "xxhash64"

    @classmethod
    def sized(cls, n: int, r: int = 13, policy: Policy = "xxhash64") -> Quotient:
        if n < 1:
            raise ValueError("n must be positive")
        return cls(max(3, power_of_two(n / 0.75).bit_length() - 1), r, policy)

    @property
    def slots(self) -> int:
        return 1 << self.q

    def pair(self, key: Column) -> tuple[Column, Column]:
        h = key_hash(key, self.policy)
        return F.shiftright(h, self.r) % self.slots, h % (1 << self.r)

    def state(self, df: DataFrame, key: Column | str) -> DataFrame:
        q, r = self.pair(column(key))
        return df.filter(column(key).isNotNull()).select(params.tagged(q, "q", self), r.alias("r")).distinct()

    def stats(self, state: DataFrame) -> DataFrame:
        """Pairs, their share of the slots, and false positives to expect at that load; above 0.95 a table of slots would be full."""
        out = state.agg(F.count(F.lit(1)).alias("pairs")).withColumn("load", F.col("pairs") / self.slots)
        return out.withColumn("expected_fpr", 1 - F.exp(-F.col("load") / (1 << self.r))).withColumn("full", F.col("load") > 0.95)

    def remove(self, state: DataFrame, df: DataFrame, key: str) -> DataFrame:
        return state.join(self.state(df, key), ["q", "r"], "left_anti")

    def maybe(self, df: DataFrame, key: str, state: DataFrame) -> DataFrame:
        """Rows of df whose pair is present."""
        q, r = self.pair(F.col(key))
        given = df.withColumn("_q", q).withColumn("_r", r)
        return given.join(state, (F.col("_q") == F.col("q")) & (F.col("_r") == F.col("r")), "left_semi").drop("_q", "_r")


def learned_state(df: DataFrame, key: str, classifier: Column, backup: Bloom) -> DataFrame:
    """The bits of the keys that the classifier misses."""
    return backup.bits(df.filter(~F.coalesce(classifier, F.lit(False))), key)


def learned_maybe(df: DataFrame, key: str, classifier: Column, backup: Bloom, bits: DataFrame, flag: str = "maybe") -> DataFrame:
    return backup.maybe(df, key, bits, "_backup").withColumn(flag, F.coalesce(classifier, F.lit(False)) | F.col("_backup")).drop("_backup")
