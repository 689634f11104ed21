"""Searches for near sets and fingerprints, and exact neighbours to measure them by.

``within``: all pairs of fingerprints that differ in few bits, by the pigeonhole: of distance + 1 blocks of bits one has to agree. Values that
very many fingerprints have in a block are met by a second block of the remaining bits, so none is left out and no hot value meets in full.
``every_within``: the same pairs from comparing every query with every fingerprint, to measure the former by.
``neighbours``: all sets with a Jaccard similarity of at least a threshold, from the rarest items of each, which near sets must share, in blocks of queries.
They take distinct fingerprints and sets: copies are counted by those who ask.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.hashing import column
from quern.operators.near_sets import near_sets
from quern.sources.working import path as working_path
from quern.sources.working import written

#: Fingerprints with one value of a block beyond which further blocks decide.
HOT = 1_000
#: Fingerprints that a task of ``every_within`` lays beside the queries at a time, queries it reads at a time, and pairs that leave it together.
LAID, READ, SENT = 1 << 14, 1 << 18, 1 << 16


def _block(name: str | Column, lo: int, width: int) -> Column:
    return F.shiftright(name, lo).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _edges(bits: int, parts: int) -> list[tuple[int, int]]:
    """Where each of the blocks begins, and its width."""
    ends = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _rest(name: str | Column, band: int, bits: int, parts: int) -> list[Column]:
    """Sub-blocks of the bits besides a block."""
    lo, width = _edges(bits, parts)[band]
    # The bits behind the block move down over it, so the rest lies side by side.
    rest = F.shiftright(name, lo + width)
    rest = F.shiftleft(rest, lo).bitwiseOR(column(name).bitwiseAND(F.lit((1 << lo) - 1).cast("bigint")))
    return [F.shiftright(rest, a).bitwiseAND(F.lit((1 << w) - 1).cast("bigint")) for a, w in _edges(bits - width, parts)]


def _second(name: str, band: int, bits: int, parts: int) -> Column:
    """The same as structs (sub, own)."""
    return F.array(*[F.struct(F.lit(i).alias("sub"), x.alias("own")) for i, x in enumerate(_rest(name, band, bits, parts))])


def within(queries: DataFrame, prints: DataFrame, distance: int, bits: int = 60, hot: int = HOT) -> DataFrame:
    """q, f, distance: all pairs of a query (a column q) and a fingerprint (a column f) that differ in so many bits at most."""
    parts = distance + 1
    if not 0 < parts <= bits:
        raise ValueError("distance must be at least 0 and below the number of bits")
    if parts == 1:
        return queries.select("q").distinct().join(prints.select("f").distinct(), F.col("q") == F.col("f")).withColumn("distance", F.lit(0))

    def banded(df: DataFrame, name: str) -> DataFrame:
        blocks = F.array(*[_block(name, lo, w) for lo, w in _edges(bits, parts)])
        return df.select(name).distinct().select(name, F.posexplode(blocks).alias("band", "bucket"))

    asked, held = banded(queries, "q"), banded(prints, "f")
    crowded = held.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("band", "bucket", F.lit(True).alias("crowded"))
    flagged = lambda df: df.join(crowded, ["band", "bucket"], "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    finer = lambda name: F.element_at(F.array(*[_second(name, b, bits, parts) for b in range(parts)]), F.col("band") + 1)
    keyed = lambda df, name: flagged(df).select(name, "band", "bucket", F.explode(F.when(F.col("crowded"), finer(name)).otherwise(F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("own"))))).alias("x")).select(name, "band", "bucket", "x.*")
    both = keyed(asked, "q").join(keyed(held, "f"), ["band", "bucket", "sub", "own"])
    apart = F.bit_count(F.col("q").bitwiseXOR(F.col("f")))
    # A near pair counts in the first block that agrees, and there in the first finer one, so each is one row without moving them.
    differ = F.col("q").bitwiseXOR(F.col("f"))
    first = lambda blocks: F.coalesce(*[F.when(x == 0, F.lit(i)) for i, x in enumerate(blocks)])
    inner = [first(_rest(differ, b, bits, parts)) for b in range(parts)]
    own = F.element_at(F.array(*inner), F.col("band") + 1)
    once = (F.col("band") == first([_block(differ, lo, w) for lo, w in _edges(bits, parts)])) & ((F.col("sub") == -1) | (F.col("sub") == own))
    return both.filter((apart <= distance) & once).select("q", "f").withColumn("distance", apart)


def _queries(folder: str) -> Iterator[np.ndarray]:
    fs, base = pafs.FileSystem.from_uri(folder)
    for f in sorted(fs.get_file_info(pafs.FileSelector(base)), key=lambda f: f.path):
        if f.is_file and f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=READ, columns=["q"]):
                    yield batch.column("q").to_numpy()


def compared(folder: str, distance: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """q, f of the queries in a folder and a task's fingerprints."""
    held: list[np.ndarray] = []

    def laid() -> Iterator[pa.RecordBatch]:
        f = np.concatenate(held)
        q, found, count = [], [], 0
        for queries in _queries(folder):
            for x in queries:
                near = np.flatnonzero(np.bitwise_count((f ^ x).view(np.uint64)) <= distance)
                if len(near):
                    q.append(np.full(len(near), x))
                    found.append(f[near])
                    count += len(near)
                    if count >= SENT:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (q, found)], ["q", "f"])
                        q, found, count = [], [], 0
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (q, found)], ["q", "f"])

    for batch in batches:
        given = batch.column("f").drop_null().to_numpy()
        for lo in range(0, len(given), LAID):
            held.append(given[lo : lo + LAID])
            if sum(map(len, held)) >= LAID:
                yield from laid()
                held.clear()
    if held:
        yield from laid()


def every_within(queries: DataFrame, prints: DataFrame, distance: int) -> DataFrame:
    """q, f: the pairs of ``within``, from comparing every query with every fingerprint: fingerprints move once, queries are read from the shared folder, and only near pairs leave a task."""
    folder = working_path(queries.sparkSession, "asked")
    queries.select(F.col("q").cast("long").alias("q")).filter("q IS NOT NULL").distinct().write.parquet(folder)
    held = prints.select(F.col("f").cast("long").alias("f")).distinct()
    dealt = held.repartition(max(1, -(-held.count() // LAID)), "f")
    return dealt.mapInArrow(lambda batches: compared(folder, distance, batches), "q long, f long")


def neighbours(queries: DataFrame, sets: DataFrame, set_col: str, item: str, threshold: float) -> DataFrame:
    """a, b, jaccard: all pairs of a query and another set with at least that similarity. Rows (set, item), each once; queries are some of the sets.

    Items are known by 64 bits; sets are compared in blocks (``near_sets``), so neither candidates nor their items become rows.
    """
    whole = written(sets.groupBy(set_col).agg(F.array_distinct(F.collect_list(F.xxhash64(item))).alias("_x")), "sets")
    asked = whole.join(queries.select(set_col).distinct(), set_col, "left_semi").withColumnRenamed(set_col, "a")
    near = near_sets(asked, whole.withColumnRenamed(set_col, "b"), threshold)
    return near.select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """A row: how many pairs (a, b) there are, how many of them were found, and the share, 1 where there are none."""
    both = exact.select("a", "b").join(found.select("a", "b", F.lit(True).alias("_hit")).distinct(), ["a", "b"], "left")
    out = both.agg(F.count(F.lit(1)).alias("pairs"), F.count("_hit").alias("found"))
    return out.withColumn("recall", F.when(F.col("pairs") == 0, 1.0).otherwise(F.col("found") / F.greatest("pairs", F.lit(1))))


def least_similarity(rows: int, bands: int, wanted: float) -> float:
    """The similarity from which on sets meet in one of so many bands with that chance."""
    return (1 - (1 - wanted) ** (1 / bands)) ** (1 / rows) if 0 < wanted < 1 else math.nan
