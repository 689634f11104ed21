"""Token ids in binary files with Elias-Fano encoded document bounds.

A file holds one array of ids of all its documents, the n + 1 bounds of the documents in it, and the documents'
own ids. Bounds and document ids rise, so each is split: the lower bits are packed as they are, the upper ones are a
bit vector with a one for each value, and a list of the places of every 64th one lets ``select`` find any value, or a run of
them, without reading those before. That takes about 2 + log2(ids per document) bits for a document's bounds and
2 + log2(distance of ids) bits for its id; the manifest says how many bytes it came to.

Layout, little-endian: 4 bytes magic, then 64-bit integers: bytes per id, documents, documents without id (these come
first), ids, least document id; for the bounds and then for the document ids: lower bits per value, bytes of lower
bits, bytes of upper bits, number of select places; then these parts, then the token ids.

Files are made in ascending order of document id (null first): ranges of ids go to tasks, and a task
writes files of a bounded size. Names are unique for each attempt; a manifest that is committed with
the tasks says which files count, so lost executors and repeated tasks leave no wrong rows.

Defined cases: null text is empty and has the end id alone; rows of equal document ids come in the order of their
texts' first PREFIX characters, then of the texts' hashes, so that one id, however frequent, is no single task's work; a very long text is
written whole, in a file of its own if it fills one; an empty table gives no file and an empty result; other columns are never looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import id_and_text, lean, table, working_path, written
from quern.llm.encoder import encoder

MAGIC, HEAD = b"QTF2", "<4s13q"
#: Bytes of ids after which a task begins the next file.
FILE_BYTES = 16 << 20
STEP = 64
#: Characters of texts that order rows of one id; documents that are read at a time.
PREFIX, READ = 32, 4_096
U = np.uint64


class EliasFano:
    """A rising sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, U)
        n = len(values)
        low_bits = max(0, int(values[-1] // U(n)).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=U)) & U(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> U(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), ones[::STEP].astype("<i8"))

    def select(self, i: int) -> int:
        """The value number i, from at most a few bytes after a select place."""
        return int(self.selected(i, 1)[0])

    def selected(self, first: int, n: int) -> np.ndarray:
        """The n values from number first on: only the bits from the select place before them to the one behind are read."""
        if n <= 0:
            return np.zeros(0, U)
        k, behind = first // STEP, (first + n - 1) // STEP + 1
        begin = int(self.places[k])
        end = int(self.places[behind]) if behind < len(self.places) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin >> 3 : (end + 7) >> 3], bitorder="little")
        bits[: begin & 7] = 0
        ones = np.flatnonzero(bits)[first % STEP : first % STEP + n] + (begin & ~7)
        at = first * self.low_bits
        low = np.unpackbits(self.low[at >> 3 : (at + n * self.low_bits + 7) >> 3], bitorder="little")[at & 7 :][: n * self.low_bits].reshape(n, self.low_bits)
        low = low.astype(U) @ (U(1) << np.arange(self.low_bits, dtype=U))
        return ((ones - np.arange(first, first + n)).astype(U) << U(self.low_bits)) + low.astype(U)

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.places]


def pack(doc_ids: list[int | None], ids: list[bytes], width: int) -> tuple[bytes, int]:
    """A file's bytes, and how many of them are bounds and document ids. ids: of each document, 32-bit little-endian."""
    bounds = EliasFano.encode(np.cumsum([0, *(len(x) // 4 for x in ids)]))
    tokens = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}")
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    keys = EliasFano.encode(known.view(U) - U(least & (1 << 64) - 1))
    sizes = [x for e in (bounds, keys) for x in (e.low_bits, *(len(p) for p in e.parts))]
    head = struct.pack(HEAD, MAGIC, width, len(doc_ids), len(doc_ids) - len(known), len(tokens), least, *sizes)
    index = b"".join([head, *(p.tobytes() for e in (bounds, keys) for p in e.parts)])
    return index + tokens.tobytes(), len(index)


class TokenFile:
    """A file's parts, without copies."""

    def __init__(self, content: bytes):
        magic, width, self.n_docs, self.n_nulls, self.n_ids, self.least, *sizes = struct.unpack_from(HEAD, content)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(HEAD)

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        def sequence(n: int, low_bits: int, n_low: int, n_high: int, n_places: int) -> EliasFano:
            return EliasFano(n, low_bits, part("u1", n_low), part("u1", n_high), part("<i8", n_places))

        self.bounds = sequence(self.n_docs + 1, *sizes[:4])
        self.keys = sequence(self.n_docs - self.n_nulls, *sizes[4:])
        self.ids = part(f"<u{width}", self.n_ids)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds.selected(i, 2).tolist()
        return self.ids[a:b]

    def doc_ids(self, first: int, n: int) -> pa.Array:
        """Ids of the n documents from number first on."""
        nulls = min(n, max(0, self.n_nulls - first))
        known = self.keys.selected(first + nulls - self.n_nulls, n - nulls) + U(self.least & (1 << 64) - 1)
        return pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(known.view(np.int64))])


def _writer(folder: str, tokenizer_path: str, end_id: int, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        width = 2 if encode.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
        end = struct.pack("<I", end_id)
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        ids: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, size
            name = f"{part:08d}-{seq:06d}-{uuid.uuid4().hex}.qtf"
            with fs.open_output_stream(f"{base}/{name}") as out:
                content, index = pack(keys, ids, width)
                out.write(content)
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "name": [name], "n_docs": [len(keys)], "n_ids": [sum(map(len, ids)) // 4], "index_bytes": [index]})
            keys.clear()
            ids.clear()
            seq, size = seq + 1, 0
            return row

        for batch in batches:
            all_keys, row = batch.column("doc_id").to_pylist(), 0
            for flat, n in encode.encoded(batch.column("text")):
                at = 0
                for count in n.tolist():
                    keys.append(all_keys[row])
                    ids.append(flat[at : at + count].tobytes() + end)
                    row, at, size = row + 1, at + count, size + (count + 1) * width
                    if size >= file_bytes:
                        yield close()
        if keys:
            yield close()

    return write


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = "", end_id: int = 1, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files; returns the manifest: part, seq, name, n_docs, n_ids, index_bytes (of bounds and document ids), first (ids in all files before)."""
    given = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ties = [F.substring("text", 1, PREFIX), F.xxhash64("text")]
    ordered = given.repartitionByRange("doc_id", *ties).sortWithinPartitions("doc_id", *ties, "text")
    manifest = written(ordered.mapInArrow(lean(_writer(folder, tokenizer_path, end_id, file_bytes)), "part long, seq long, name string, n_docs long, n_ids long, index_bytes long"), "manifest")
    # Sums of the parts, of which there are as many as tasks, come together; files only with those of their part.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("_sum"))
    parts = parts.withColumn("_first", F.coalesce(F.sum("_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "part").withColumn("first", F.col("_first") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("_first")


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
            f = TokenFile(content.as_py())
            for k in range(0, f.n_docs, READ):
                n = min(READ, f.n_docs - k)
                at = f.bounds.selected(k, n + 1).astype(np.int64)
                crc = [zlib.crc32(f.ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), f.doc_ids(k, n), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["name", "doc_id", "at", "n_tokens", "ids_crc32"],
                )


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files that the manifest names."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = files.mapInArrow(lean(_read_batches), "name string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(manifest.select("name", "first"), "name").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = working_path(spark, "token_files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder, manifest)


QUERIES = {"op5_token_files": op5_token_files}
ORACLES: dict[str, str] = {}
