"""Weighted similarity of every query and every other set, by samples and exactly, without rows of items that pair.

Rows are dealt by set and move once. A task makes the samples of its sets, each from all of its items, and lays them beside blocks of queries that
lie in the shared folder: neither samples, nor sums that two sets share, nor pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.hashing import key_hash
from quern.operators import similarity
from quern.operators.similarity import WeightedMinHash, equal_slots, least_samples
from quern.sources.working import path as working_path

#: Items of the sets that are compared at a time, of a block of queries, whose samples are drawn at a time, and meetings of equal items held at a time.
CHUNK_ITEMS, BLOCK_ITEMS, DRAWN, MEETINGS = 1 << 20, 1 << 20, 1 << 7, 1 << 21
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _rows(df: DataFrame, set_col: str, item: str, weight: str, sketch: WeightedMinHash) -> DataFrame:
    """set, i (the item as a number, null for none), h (its hash), w (its weight): rows of a set side by side in one task."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.filter(F.col(set_col).isNotNull()).select(F.col(set_col).alias("set"), F.col(item).alias("item"), F.col(weight).cast("double").alias("w")).repartition(parts, "set")
    number = F.col("item").cast("long") if dict(df.dtypes)[item] in _WHOLE else F.when(F.col("item").isNotNull(), F.xxhash64("item"))
    each = dealt.groupBy("set", "item").agg(F.sum("w").alias("w"))
    return each.select("set", number.alias("i"), key_hash("item", sketch.policy).alias("h"), "w").sortWithinPartitions("set")


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sets, so many at a time that their items are bounded: names, samples (a row for each), total weights, items, their weights, and the n + 1 places at which sets begin."""
    names, samples, totals, items, weights, sizes = [], [], [], [], [], []
    own: dict = {}

    def drawn() -> None:
        """Of the rows that wait the least samples join those of the set so far."""
        if not own["wait"]:
            return
        h, w = (np.concatenate(x) for x in zip(*own["wait"]))
        for lo in range(0, len(h), DRAWN):
            new = least_samples(h[lo : lo + DRAWN], np.log(w[lo : lo + DRAWN]), k)
            if own["best"] is None:
                own["best"] = new
            else:
                less = new[0] < own["best"][0]
                own["best"] = tuple(np.where(less, x, y) for x, y in zip(new, own["best"]))
        own["wait"], own["waiting"] = [], 0

    def ended() -> None:
        drawn()
        best = own["best"]
        names.append(own["name"])
        # A sample is known by 64 bits of its item and its t; what has no samples agrees with none.
        samples.append(_known(best[1], best[2]) if best else None)
        totals.append(own["total"])
        i, v = (np.concatenate(x) for x in zip(*own["items"]))
        items.append(i)
        weights.append(v)
        sizes.append(len(i))

    def out(kind: pa.DataType) -> tuple:
        x = pa.array(names, kind), np.stack([s if s is not None else np.zeros(k, np.int64) for s in samples]), np.array(totals), np.concatenate(items), np.concatenate(weights), np.concatenate([[0], np.cumsum(sizes)])
        for column in (names, samples, totals, items, weights, sizes):
            column.clear()
        return x

    kind = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, sets = batch.schema.field("set").type, batch.column("set")
        given = batch.column("i").is_valid().to_numpy(zero_copy_only=False)
        i = batch.column("i").fill_null(0).to_numpy()
        h = batch.column("h").fill_null(0).to_numpy()
        v = batch.column("w").to_numpy(zero_copy_only=False)  # nulls are NaN
        positive = given & (v > 0)
        starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(sets.slice(1), sets.slice(0, len(sets) - 1)).to_numpy(zero_copy_only=False)]))
        for lo, hi in zip(starts, [*starts[1:], len(sets)]):
            name = sets[int(lo)].as_py()
            if own and own["name"] != name:
                ended()
                own = {}
                if len(names) >= similarity.BLOCK or sum(sizes) >= CHUNK_ITEMS:
                    yield out(kind)
            if not own:
                own = {"name": name, "wait": [], "waiting": 0, "best": None, "total": 0.0, "items": []}
            some, drawable = np.arange(lo, hi)[given[lo:hi]], np.arange(lo, hi)[positive[lo:hi]]
            own["total"] += float(np.nansum(v[lo:hi]))
            own["items"].append((i[some], v[some]))
            if len(drawable):
                own["wait"].append((h[drawable], v[drawable]))
                own["waiting"] += len(drawable)
                if own["waiting"] >= DRAWN:
                    drawn()
    if own:
        ended()
        yield out(kind)


def _known(item: np.ndarray, t: np.ndarray) -> np.ndarray:
    """64 bits of an item's hash and t, never 0 or 1."""
    x = item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + t.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.maximum(x ^ (x >> np.uint64(31)), np.uint64(2)).view(np.int64)


def _blocks(folder: str) -> Iterator[pa.Table]:
    """The queries, so many at a time, from all files of the folder."""
    fs, base = pafs.FileSystem.from_uri(folder)
    held, count, items = [], 0, 0
    for f in sorted(fs.get_file_info(pafs.FileSelector(base)), key=lambda f: f.path):
        if not f.is_file or not f.path.endswith(".parquet"):
            continue
        with fs.open_input_file(f.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=64):
                own = int(pc.sum(pc.list_value_length(batch.column("_i"))).as_py() or 0)
                if held and (count + batch.num_rows > similarity.BLOCK or items + own > BLOCK_ITEMS):
                    yield pa.Table.from_batches(held)
                    held, count, items = [], 0, 0
                held.append(batch)
                count, items = count + batch.num_rows, items + own
    if held:
        yield pa.Table.from_batches(held)


def shared(row: np.ndarray, values: np.ndarray, weights: np.ndarray, other: np.ndarray, own: np.ndarray, theirs: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sums of the least weights of equal items: of queries (rows, items, weights) and sets (rows, items, weights), a matrix of queries and sets."""
    out = np.zeros(shape[0] * shape[1])
    order = np.argsort(values, kind="stable")
    row, values, weights = row[order], values[order], weights[order]
    lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
    some = np.flatnonzero(hi > lo)
    lo, many = lo[some], (hi - lo)[some]
    ends, at = np.concatenate([[0], np.cumsum(many)]), 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + MEETINGS, "right")) - 1)
        n = many[at:to]
        met = np.repeat(lo[at:to] - (ends[at:to] - ends[at]), n) + np.arange(ends[to] - ends[at])
        mine = np.repeat(some[at:to], n)
        least = np.nan_to_num(np.fmin(weights[met], theirs[mine]))
        # A sum for each pair in one step, as a pair may meet many times.
        np.add.at(out, row[met] * shape[1] + other[mine], least)
        at = to
    return out.reshape(shape)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return pc.list_flatten(table.column(name)).to_numpy()


def weighted_search(df: DataFrame, asked: str, set_col: str, item: str, weight: str, sketch: WeightedMinHash) -> DataFrame:
    """a, b, jaccard, exact: every set that is asked for (a condition) beside every other one, by samples and exactly. Rows (set, item, weight); weights of an item add up."""
    k, kind, folder = sketch.k, dict(df.dtypes)[set_col], working_path(df.sparkSession, "asked")

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, samples, totals, items, weights, ends in _signed(batches, k):
            for lo in range(0, len(names), 64):
                hi = min(lo + 64, len(names))
                at = pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x[ends[lo] : ends[hi]])) for x in (items, weights)]
                slots = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * k), pa.array(samples[lo:hi].ravel()))
                yield pa.RecordBatch.from_arrays([names.slice(lo, hi - lo), slots, pa.array(totals[lo:hi]), *lists], ["a", "_x", "_w", "_i", "_v"])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, samples, totals, items, weights, ends in _signed(batches, k):
            y, other = np.ascontiguousarray(np.where(samples == 0, 1, samples).T), np.repeat(np.arange(len(b)), np.diff(ends))
            for block in _blocks(folder):
                a, x = block.column("a").combine_chunks(), _flat(block, "_x").reshape(-1, k)
                whole = block.column("_w").to_numpy()
                row = np.repeat(np.arange(len(a)), pc.list_value_length(block.column("_i")).to_numpy())
                m = shared(row, _flat(block, "_i"), _flat(block, "_v"), other, items, weights, (len(a), len(b)))
                itself = pc.fill_null(pc.index_in(a, value_set=b), -1).to_numpy(zero_copy_only=False)
                step = max(1, (1 << 16) // len(b))
                for lo in range(0, len(a), step):  # some 65,536 pairs at a time
                    n = np.stack([equal_slots(q, y) for q in x[lo : lo + step]])
                    keep = np.ones(n.shape, bool)
                    own = itself[lo : lo + step]
                    keep[np.flatnonzero(own >= 0), own[own >= 0]] = False
                    i, j = np.nonzero(keep)
                    both = m[lo : lo + step][i, j]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        exact = both / (whole[lo : lo + step][i] + totals[j] - both)
                    yield pa.RecordBatch.from_arrays([a.take(pa.array(lo + i)), b.take(pa.array(j)), pa.array(n[i, j] / k), pa.array(exact)], ["a", "b", "jaccard", "exact"])

    _rows(df.filter(asked), set_col, item, weight, sketch).mapInArrow(queries, f"a {kind}, _x array<long>, _w double, _i array<long>, _v array<double>").write.parquet(folder)
    return _rows(df, set_col, item, weight, sketch).mapInArrow(beside, f"a {kind}, b {kind}, jaccard double, exact double")
