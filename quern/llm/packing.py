"""Best-fit packing into training sequences of several permitted lengths.

Documents become token counts; one longer than the longest permitted length is cut into parts. Parts
are dealt by a hash of their document over groups of a bounded number of rows, and each group is packed
on its own: the parts from long to short, each into the open bin that it leaves least room in. Where
none has room, a bin is opened at the length whose cost for each token it may yet receive is least:
cost(L) = fixed + L + L^2 / (2 * scale), the fixed cost of a sequence, its linear and its attention cost.
In the end each bin shrinks to the least permitted length that holds its contents.

A group leaves a few bins part empty, whatever the size of the table, so this costs one narrow shuffle
and loses next to nothing against packing all at once.

Defined cases: null text is empty and takes the end token alone; rows with equal ids are parts of their
own; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import id_and_text, id_type, lean, table
from quern.llm.encoder import encoder

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Documents for each group, about.
GROUP = 20_000


def _counter(tokenizer_path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        try:
            for batch in batches:
                n = np.concatenate([np.zeros(0, np.int64), *encode.lengths(batch.column("text"))]) + 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n)], ["doc_id", "n_tokens"])
        finally:
            encode.forget()  # later stages need the room

    return count


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = "") -> DataFrame:
    """doc_id, n_tokens: ids of the text and an end id."""
    return id_and_text(docs, id_col, text_col).mapInArrow(lean(_counter(tokenizer_path)), f"doc_id {id_type(docs, id_col)}, n_tokens long")


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, fixed: int = 64, scale: int = 32_768) -> tuple[list[int], list[int], list[int]]:
    """Sizes must come from long to short. For each its bin and its offset there; and the bins' lengths."""
    cost = {n: fixed + n + n * n / (2 * scale) for n in lengths}
    left = sum(sizes)
    by_room: list[list[int]] = [[] for _ in range(max(lengths) + 1)]
    rooms = 0  # bit r: some open bin has room for r
    bins, offsets, used, opened = [], [], [], []
    for size in sizes:
        fitting = rooms >> size << size
        if fitting:
            room = (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            k = len(used)
            used.append(0)
            opened.append(min((n for n in lengths if n >= size), key=lambda n: (cost[n] / min(n, left), n)))
        bins.append(k)
        offsets.append(used[k])
        used[k] += size
        left -= size
        room = opened[k] - used[k]
        if room:
            by_room[room].append(k)
            rooms |= 1 << room
    return bins, offsets, [min(n for n in lengths if n >= u) for u in used]


def _packer(lengths: tuple[int, ...]):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("part", "ascending")])
        bins, offsets, final = pack(t.column("n_tokens").to_pylist(), lengths)
        ids = [(g << 32) | k for g, k in zip(t.column("grp").to_pylist(), bins)]
        return pa.table([t.column("doc_id"), t.column("part"), t.column("n_tokens"), pa.array(ids, pa.int64()), pa.array([final[k] for k in bins], pa.int64()), pa.array(offsets, pa.int64())], ["doc_id", "part", "n_tokens", "bin_id", "bin_length", "bin_offset"])

    return run


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, tokenizer_path: str = "", group: int = GROUP) -> DataFrame:
    """doc_id, part, n_tokens, bin_id, bin_length, bin_offset: where each part of each document lies."""
    if not lengths or min(lengths) < 1:
        raise ValueError("lengths must be positive")
    lengths = tuple(sorted(set(lengths)))
    longest, groups = lengths[-1], max(1, -(-docs.count() // group))
    sizes = token_counts(docs, id_col, text_col, tokenizer_path)
    # The number of the input partition parts rows that agree in id, length and part, and is the same if a task runs again.
    # Each document's parts are full but for the last; a long one has few of them next to its text.
    parts = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {longest}"))).alias("part"))
    parts = parts.select("doc_id", "part", F.least(F.lit(longest), F.col("n_tokens") - F.col("part") * longest).cast("long").alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "n_tokens", "part", F.spark_partition_id()), F.lit(groups)).alias("grp"))
    return parts.groupBy("grp").applyInArrow(_packer(lengths), f"doc_id {id_type(docs, id_col)}, part long, n_tokens long, bin_id long, bin_length long, bin_offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
