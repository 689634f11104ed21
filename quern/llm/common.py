"""What the operators of this subpackage share: working tables, Arrow text buffers, word tables.

Text never becomes one Python object per word where arrays serve: ``words`` finds word bounds in the
UTF-8 bytes of a whole group of documents and ``word_hashes`` gives each word a 64-bit value.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import gc
import hashlib

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.sizing import power_of_two
from quern.sources.working import made, release, released, shared_dir, written
from quern.sources.working import path as working_path

__all__ = ["made", "release", "released", "shared_dir", "working_path", "written"]

#: Bytes of text that are turned into arrays at a time in a Python worker.
PIECE = 1 << 19

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _libc():
    return ctypes.CDLL(ctypes.util.find_library("c"))


def _trimmed() -> None:
    """Gives free memory of this process back."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def collected(spark: SparkSession) -> None:
    """Between the steps of a long operator: what finished plans left on the driver goes, and so do their shuffle files and broadcast tables.

    Without it the driver's heap grows to its limit before the JVM collects that.
    """
    gc.collect()
    _trimmed()
    spark.sparkContext._jvm.System.gc()


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """For mapInArrow: gives a task's memory back at its end, as workers are kept for later tasks of any kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _trimmed()

    return run


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that count, under fixed names; other columns can't clash. Null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.select(id_col).dtypes[0][1]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE):
    """Row ranges of at most limit bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """For each byte 0 if it separates words, else itself plus 1, A-Z as a-z where asked."""
    out = np.arange(1, 257, dtype=np.uint16)
    if lower:
        out[65:91] += 32
    out[list(separators)] = 0
    return out


#: Words are what lies between spaces, tabs, line ends, vertical tabs and form feeds.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
PLAIN = byte_table(SPACES, lower=False)
LOWER = byte_table(SPACES, lower=True)


def words(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the n + 1 places in them at which documents begin."""
    inside = kinds[data] > 0
    full = offsets[:-1][np.diff(offsets) > 0]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[full] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[full[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_ORDER = np.uint64(0xA0761D6478BD642F)
#: By the number of a word's bytes from a place on, which of eight bytes count.
_COUNTED = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words, in bytes, are digested one by one.
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word, eight bytes at a time; words of over 64 bytes take theirs from BLAKE2b.

    No step is linear in the bytes, so words made for sums or polynomials to agree differ here as any others do: two
    words have one value with a chance of 2^-64.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    letters = np.zeros(len(data) // 8 * 8 + 16, np.uint8)
    letters[: len(data)] = (kinds - 1).astype(np.uint8)[data]
    eight = letters.view("<u8")

    def read(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        shift, at = (at & 7).astype(np.uint64) * np.uint64(8), at >> 3
        return (eight[at] >> shift | eight[at + 1] << np.uint64(63) - shift << np.uint64(1)) & _COUNTED[np.minimum(n, 8)]

    n = ends - starts
    value = mix(read(starts, n) ^ n.astype(np.uint64) * _ORDER)
    done, left = 8, np.flatnonzero((n > 8) & (n <= LONG_WORD))
    while len(left):
        part = read(starts[left] + done, n[left] - done)
        value[left] = mix(value[left] ^ part) + part * _ORDER
        done += 8
        left = left[n[left] > done]
    view = memoryview(letters)
    for k in np.flatnonzero(n > LONG_WORD).tolist():
        value[k] = int.from_bytes(hashlib.blake2b(view[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return mix(value ^ np.uint64(0x9E3779B97F4A7C15))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Values of all runs of n consecutive words: len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _ORDER + h[k : len(h) - n + 1 + k]
    return mix(out)


def text_pieces(batch: pa.RecordBatch, kinds: np.ndarray, limit: int = PIECE):
    """Of a batch with a column text: (first row, data, starts, ends, begins) piece by piece."""
    data, offsets = buffer(batch.column("text"))
    for lo, hi in pieces(offsets, limit):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        yield lo, part, *words(part, at, kinds)


#: Bits of a filter at most, and for each key; where a value's bits of six begin that name its places in a word.
FILTER_BITS, BITS, PLACES = 1 << 29, 16, (0, 6, 12, 18)


@dataclass(frozen=True)
class Filter:
    """Values that may be in a set: 64-bit words, in each of which a value has four bits, so none is missing that was put in."""

    words: np.ndarray

    @classmethod
    def of(cls, values: DataFrame, bits_each: int = BITS) -> Filter:
        """From rows k. At most FILTER_BITS / 64 words come to the driver."""
        size = min(FILTER_BITS, power_of_two(max(64, bits_each * values.count()))) // 64
        bits = " | ".join(f"shiftleft(1L, cast(shiftright(k, {at}) & 63L as int))" for at in PLACES)
        word = F.shiftrightunsigned("k", 6 * len(PLACES)).bitwiseAND(F.lit(size - 1))
        got = values.groupBy(word.alias("word")).agg(F.expr(f"bit_or({bits})").alias("value")).toArrow()
        out = np.zeros(size, np.int64)
        out[got.column("word").to_numpy()] = got.column("value").to_numpy()
        return cls(out.view(np.uint64))

    def has(self, values: np.ndarray) -> np.ndarray:
        word = self.words[((values >> np.uint64(6 * len(PLACES))) & np.uint64(len(self.words) - 1)).astype(np.int64)]
        out = np.ones(len(values), bool)
        for at in PLACES:
            out &= (word >> ((values >> np.uint64(at)) & np.uint64(63))) & np.uint64(1) == 1
        return out
