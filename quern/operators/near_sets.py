"""Near sets without rows of pairs: every set is laid beside blocks of queries, and only near pairs leave a task.

A block is as large as a number of items allows, lies in the shared folder and is read by the tasks, one at a time; the other sets are read once
and not shuffled. Within a block items are ordered by how many of its queries have them: a set shares one of its n - ceil(threshold * n) + 1
rarest items with each near query, so a set with too few items of the block is passed over. The lengths and the places of what two sets
share rule out most others; the rest are intersected in full.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.similarity import MinHash
from quern.sources.working import path as working_path

#: Items of the queries of a block, items of the sets that a task lays beside it at a time, and meetings of rare items held at a time.
BLOCK_ITEMS, CHUNK_ITEMS, MEETINGS = 1 << 22, 1 << 22, 1 << 21
SLACK = 1e-9


def _least(n: np.ndarray, threshold: float) -> np.ndarray:
    """Items that a near set shares with one of n items at least."""
    return np.ceil(threshold * n - SLACK).astype(np.int64)


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of so many each, in a row."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of arrays, and the n + 1 places at which they begin."""
    sizes = pc.list_value_length(column).to_numpy().astype(np.int64)
    return pc.list_flatten(column).to_numpy(), np.concatenate([[0], np.cumsum(sizes)])


class Block:
    """Queries by the ranks of their items, rarest first, and for each item the queries that have it in front."""

    def __init__(self, ids: pa.Array, values: np.ndarray, ends: np.ndarray, threshold: float):
        self.ids, self.ends, self.threshold, self.n = ids, ends, threshold, np.diff(ends)
        self.items, place, often = np.unique(values, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.items), np.int64)
        self.rank[np.argsort(often, kind="stable")] = np.arange(len(self.items))
        row = np.repeat(np.arange(len(self.n)), self.n)
        self.ranks = np.sort(row << 32 | self.rank[place]) & (1 << 32) - 1
        at = np.arange(len(values)) - ends[row]
        front = np.flatnonzero(at <= (self.n - _least(self.n, threshold))[row])
        front = front[np.argsort(self.ranks[front], kind="stable")]
        self.query, self.place = row[front].astype(np.int32), at[front].astype(np.int32)
        self.first = np.searchsorted(self.ranks[front], np.arange(len(self.items) + 1))
        self.ranks, self.held = self.ranks.astype(np.int32), np.zeros(len(self.items), bool)

    def near(self, values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of queries, rows of sets and how many items they share, of all near pairs."""
        none = np.zeros(0, np.int64)
        n, t = np.diff(ends), self.threshold
        if not len(self.items) or not len(values):
            return none, none, none
        at = np.minimum(np.searchsorted(self.items, values), len(self.items) - 1)
        known = self.items[at] == values
        row = np.repeat(np.arange(len(n)), n)
        strange = n - np.bincount(row[known], minlength=len(n))  # rarer than all others, and met by none
        known &= (strange <= n - _least(n, t))[row]
        key = np.sort(row[known] << 32 | self.rank[at[known]])
        row, rank = key >> 32, key & (1 << 32) - 1
        begins = np.searchsorted(row, np.arange(len(n) + 1))
        place = np.arange(len(row)) - begins[row] + strange[row]
        front = np.flatnonzero(place <= (n - _least(n, t))[row])
        meetings = self.first[rank[front] + 1] - self.first[rank[front]]
        front, meetings = front[meetings > 0], meetings[meetings > 0]
        owner, total = row[front], np.concatenate([[0], np.cumsum(meetings)])
        out, lo = [], 0
        while lo < len(front):  # whole sets, so many at a time that their meetings are bounded
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + MEETINGS, "right")) - 1)
            hi = int(np.searchsorted(owner, owner[hi], "left")) if hi < len(front) else hi
            if hi <= lo:
                hi = int(np.searchsorted(owner, owner[lo], "right"))
            some, many = front[lo:hi], meetings[lo:hi]
            met = _runs(self.first[rank[some]], many)
            a, b = self.query[met].astype(np.int64), np.repeat(row[some], many)
            pa_, pb = self.place[met], np.repeat(place[some], many)
            fits = np.minimum(self.n[a], n[b]) >= t * np.maximum(self.n[a], n[b]) - SLACK
            a, b, pa_, pb = a[fits], b[fits], pa_[fits], pb[fits]
            order = np.argsort(b * len(self.n) + a, kind="stable")
            a, b, pa_, pb = a[order], b[order], pa_[order], pb[order]
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else none
            if len(starts):
                shared = np.diff(np.concatenate([starts, [len(a)]]))
                a, b, pa_, pb = a[starts], b[starts], np.maximum.reduceat(pa_, starts), np.maximum.reduceat(pb, starts)
                # What may follow the last meeting in both.
                may = shared + np.minimum(self.n[a] - 1 - pa_, n[b] - 1 - pb) >= t / (1 + t) * (self.n[a] + n[b]) - SLACK
                out.append(self._confirmed(a[may], b[may], rank, begins, n))
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)

    def _confirmed(self, a: np.ndarray, b: np.ndarray, rank: np.ndarray, begins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        common = np.zeros(len(a), np.int64)
        ends = np.flatnonzero(np.concatenate([b[1:] != b[:-1], [True]])) + 1 if len(b) else []
        lo = 0
        for hi in ends:
            mine, asked = rank[begins[b[lo]] : begins[b[lo] + 1]], a[lo:hi]
            self.held[mine] = True
            theirs = self.held[self.ranks[_runs(self.ends[asked], self.n[asked])]]
            common[lo:hi] = np.add.reduceat(theirs, np.cumsum(self.n[asked]) - self.n[asked], dtype=np.int64)
            self.held[mine] = False
            lo = hi
        near = common >= self.threshold * (self.n[a] + n[b] - common) - SLACK
        return a[near], b[near], common[near]


@functools.lru_cache(maxsize=1)
def _load(folder: str, block: int, threshold: float, index: MinHash | None) -> tuple[Block, np.ndarray | None]:
    """A block of the shared folder and its queries' signatures; a worker keeps the last one for its next task."""
    fs, base = pafs.FileSystem.from_uri(folder)
    parts = []
    for f in sorted(fs.get_file_info(pafs.FileSelector(f"{base}/block={block}", allow_not_found=True)), key=lambda f: f.path):
        if f.is_file and f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                parts.append(pq.ParquetFile(source).read(columns=["a", "_x"]))
    if not parts:
        return Block(pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(1, np.int64), threshold), None
    table = pa.concat_tables(parts)
    values, ends = _flat(table.column("_x"))
    return Block(table.column("a").combine_chunks(), values, ends, threshold), index.signature(values, ends) if index else None


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with so many items together, about."""
    held, items = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = sizes[lo - 1] if lo else 0
            hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(sizes, before + CHUNK_ITEMS - items, "right"))))
            held.append(batch.slice(lo, hi - lo))
            items += int(sizes[hi - 1] - before)
            lo = hi
            if items >= CHUNK_ITEMS:
                yield pa.Table.from_batches(held)
                held, items = [], 0
    if held:
        yield pa.Table.from_batches(held)


def near_sets(queries: DataFrame, sets: DataFrame, threshold: float, index: MinHash | None = None, rows: int = 4, block_items: int | None = None) -> DataFrame:
    """a, na, b, nb, common: all pairs of a query and another set with at least that Jaccard similarity, their sizes and how many items they share.

    queries: a, _x; sets: b, _x (the set's items, each once, as whole numbers of 64 bits). Empty sets are near none.
    index: then there is a column met besides: whether the MinHash signatures of the two, as made for every set, agree in a band of so many slots.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    folder = working_path(queries.sparkSession, "asked")
    asked = queries.select("a", "_x").filter(F.col("a").isNotNull() & (F.size("_x") > 0))
    blocks = max(1, -(-(asked.agg(F.sum(F.size("_x").cast("long"))).first()[0] or 0) // (block_items or BLOCK_ITEMS)))
    asked.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int")).repartition(blocks, "block").write.partitionBy("block").parquet(folder)
    kinds, names = (dict(queries.dtypes)["a"], dict(sets.dtypes)["b"]), ["a", "na", "b", "nb", "common"] + (["met"] if index else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Empty sets go here, as a filter before would make what the items are derived from twice.
        filled = (b.filter(pc.and_(b.column(0).is_valid(), pc.greater(pc.fill_null(pc.list_value_length(b.column(1)), 0), 0))) for b in batches)
        for chunk in _chunks(b for b in filled if b.num_rows):
            values, ends = _flat(chunk.column("_x"))
            own, n = chunk.column("b").combine_chunks(), np.diff(ends)
            signed = index.signature(values, ends) if index else None
            for k in range(blocks):
                block, signatures = _load(folder, k, threshold, index)
                a, b, common = block.near(values, ends)
                if not len(a):
                    continue
                columns = [block.ids.take(pa.array(a)), pa.array(block.n[a]), own.take(pa.array(b)), pa.array(n[b]), pa.array(common)]
                if index:
                    met = [(signatures[a[i : i + 65_536]] == signed[b[i : i + 65_536]]).reshape(-1, index.k // rows, rows).all(2).any(1) for i in range(0, len(a), 65_536)]
                    columns.append(pa.array(np.concatenate(met)))
                out = pa.table(columns, names)
                yield from out.filter(pc.invert(pc.equal(out.column("a"), out.column("b")))).to_batches(10_000)

    return sets.select("b", "_x").mapInArrow(run, f"a {kinds[0]}, na long, b {kinds[1]}, nb long, common long" + (", met boolean" if index else ""))
