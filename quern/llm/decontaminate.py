"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items.

Items and documents are lower-cased (A-Z) and cut into words; an item's patterns are its runs of
``window`` words, or its whole sequence if it is shorter. The automaton reads each document's word
sequence once; matched word ranges are mapped back to offsets in the document as it came.

Items are written to the shared folder in blocks of about ``block_words`` words; an item with more is cut into parts that
overlap by one word less than a window, so that no window is lost. A task holds one automaton at a time, and neither the driver nor a
closure holds any. There is one automaton for all items unless they have more words than a block. Where there are several, each is
built once and saved beside its items, and a bit filter of all blocks' windows, of a bounded size, tells which texts may hold any: a task
gathers ``GATHERED`` bytes of these and takes them through the automatons in turn. Documents are read once and nothing of them is shuffled.

Defined cases: null text has no words, an item without words has no pattern, a null item id is the
empty string in the digest and counts as an item, repeated rows are judged each on their own, very long texts and items are read whole,
an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Filter, buffer, byte_table, id_type, lean, mix, ngrams, pieces, table, word_hashes, words, working_path, written

#: Words of a text as it came: A-Z belong to them.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A-Z to a-z, what separates words to a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The same for words in arrays of bytes.
KINDS = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()), lower=True)
#: Bits of the filter for each window.
WINDOW_BITS = 48
#: Words of items in one automaton, about; it takes some hundred bytes for each place of a window.
BLOCK_WORDS = 200_000
#: Rows that are objects at a time where there is one automaton.
ROWS = 512
#: Bytes of text that pass through one automaton before the next is built.
GATHERED = 64 << 20


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def build(items: list[tuple[str, list[bytes]]], window: int) -> tuple[dict[bytes, int], ahocorasick.Automaton | None]:
    """Word numbers, and the automaton over sequences of them; a pattern's value is (its length, its items)."""
    numbers: dict[bytes, int] = {}
    patterns: dict[tuple[int, ...], list[int]] = {}
    for k, (_, words) in enumerate(items):
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words]
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            own = patterns.setdefault(tuple(ids[i : i + window]), [])
            if not own or own[-1] != k:
                own.append(k)
    if not patterns:
        return numbers, None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for pattern, own in patterns.items():
        automaton.add_word(pattern, (len(pattern), own))
    automaton.make_automaton()
    return numbers, automaton


def hits(ids: tuple[int, ...], automaton: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[int]]:
    """Word ranges inside any match, joined where they overlap, and the items that match."""
    ranges: list[tuple[int, int]] = []
    items: set[int] = set()
    for end, (length, own) in automaton.iter(ids):
        lo = end - length + 1
        while ranges and ranges[-1][1] > lo:
            lo = min(lo, ranges.pop()[0])
        ranges.append((lo, end + 1))
        items.update(own)
    return ranges, items


def offsets_of(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point ranges in the original text of ranges of words."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


_RANGES = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_COLUMNS = "n_words long, ranges array<struct<lo:long,hi:long>>, spans array<struct<start:long,end:long>>, items array<string>"


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges by place, joined where they overlap."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and out[-1][1] > lo:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _parter(window: int, limit: int):
    """Words of items, in parts of at most limit words and what the next part's first window needs besides."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"item": [], "words": []}
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary())):
                words = split_words(text.as_py() or b"")
                for a in range(0, max(1, len(words) - window + 1) if words else 0, limit):
                    rows["item"].append(item)
                    rows["words"].append(b" ".join(words[a : a + limit + window - 1]))
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("item", pa.string()), ("words", pa.binary())]))

    return cut


def window_values(h: np.ndarray, n: int) -> np.ndarray:
    """A value for each run of n words."""
    return mix(ngrams(h, n) + np.uint64(n))


def _windows(window: int):
    """Rows n, k of the patterns of items' words: their length and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer(batch.column("words"))
            lengths, values = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
            starts, ends, begins = words(data, offsets, KINDS)
            h = word_hashes(data, starts, ends, KINDS)
            for a, b in zip(begins[:-1], begins[1:]):
                if b > a:
                    values.append(window_values(h[a:b], min(window, b - a)))
                    lengths.append(np.full(len(values[-1]), min(window, b - a), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lengths)), pa.array(np.concatenate(values).view(np.int64))], ["n", "k"])

    return run


class Blocks:
    """The benchmark in the shared folder, and how a task reads it."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int):
        rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        parts = rows.mapInArrow(lean(_parter(window, block_words)), "item string, words binary").distinct()
        size = F.size(F.split(F.col("words").cast("string"), " "))
        # Items may share their texts, so it is the words of all of them that count.
        self.count = max(1, -(-(parts.agg(F.sum(size)).first()[0] or 0) // block_words))
        self.folder, self.window = working_path(benchmark.sparkSession, "items"), window
        parts = parts.select("item", "words", F.pmod(F.xxhash64("item", "words"), F.lit(self.count)).cast("int").alias("block"))
        parts.repartition(self.count, "block").write.partitionBy("block").parquet(self.folder)
        self.built, self.sent, self.lengths = "", None, []
        if self.count > 1:
            self._prepare(benchmark.sparkSession)

    def _prepare(self, spark: SparkSession) -> None:
        """Builds the automaton of each block once, in tasks of its own, and the filter of all windows."""
        load = self._from_items

        def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps(load(k), 5)], pa.binary())], ["block", "data"])

        built = working_path(spark, "automata")
        spark.range(0, self.count, 1, self.count).mapInArrow(lean(save), "block int, data binary").write.partitionBy("block").parquet(built)
        items = spark.read.parquet(self.folder).select("words")
        values = written(items.mapInArrow(lean(_windows(self.window)), "n int, k long").distinct(), "windows")
        self.lengths = sorted(r["n"] for r in values.select("n").distinct().collect())  # as many as a window has words at most
        self.sent = spark.sparkContext.broadcast(Filter.of(values.select("k"), WINDOW_BITS))
        self.built = built

    def __getstate__(self) -> dict:
        return {"count": self.count, "folder": self.folder, "window": self.window, "built": self.built, "sent": self.sent, "lengths": self.lengths}

    def load(self, block: int) -> tuple[list[str], dict[bytes, int], ahocorasick.Automaton | None]:
        """Names of the block's items, word numbers, and its automaton."""
        if not self.built:
            return self._from_items(block)
        fs, base = pafs.FileSystem.from_uri(self.built)
        for f in fs.get_file_info(pafs.FileSelector(f"{base}/block={block}")):
            if f.is_file and f.path.endswith(".parquet"):
                with fs.open_input_file(f.path) as source:
                    return pickle.loads(pq.ParquetFile(source).read(columns=["data"]).column("data")[0].as_buffer())
        raise FileNotFoundError(f"{self.built}: block {block}")

    def _from_items(self, block: int) -> tuple[list[str], dict[bytes, int], ahocorasick.Automaton | None]:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        found = fs.get_file_info(pafs.FileSelector(f"{base}/block={block}", allow_not_found=True))
        files = sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))
        items: list[tuple[str, list[bytes]]] = []
        for path in files:
            with fs.open_input_file(path) as source:
                t = pq.ParquetFile(source).read(columns=["item", "words"])
            items += [(item, words.split(b" ")) for item, words in zip(t.column("item").to_pylist(), t.column("words").to_pylist())]
        items.sort()
        return [k for k, _ in items], *build(items, self.window)

    def search(self, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, int, list[tuple[int, int]], list[str]]]]]:
        """Each batch, and for each of its texts (in that column): the text, its number of words, ranges inside matches, items."""
        if self.count == 1:
            one = self.load(0)
            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):  # a few rows at a time, so that no more than these are held as objects
                    yield from self._all([batch.slice(k, ROWS)], column, one)
            return
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                count, maybe = self._maybe(part.column(column))
                if not maybe.any():
                    yield part, [(b"", n, [], []) for n in count.tolist()]
                    continue
                # What surely holds no window is done; the rest waits for the automatons.
                clean = np.flatnonzero(~maybe)
                if len(clean):
                    yield part.take(pa.array(clean)), [(b"", n, [], []) for n in count[clean].tolist()]
                held.append(part.take(pa.array(np.flatnonzero(maybe))))
                size += held[-1].nbytes
                if size >= GATHERED:
                    yield from self._all(held, column, None)
                    held, size = [], 0
        if held:
            yield from self._all(held, column, None)

    def _maybe(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the number of words, and whether some window's value may be in the filter."""
        data, offsets = buffer(texts)
        count, maybe = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for lo, hi in pieces(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, begins = words(part, at, KINDS)
            h = word_hashes(part, starts, ends, KINDS)
            count[lo:hi] = np.diff(begins)
            for n in self.lengths:
                found = np.flatnonzero(self.sent.value.has(window_values(h, n)))
                row = np.searchsorted(begins, found, "right") - 1
                maybe[lo + row[found + n <= begins[row + 1]]] = True
        return count, maybe

    def _all(self, held: list[pa.RecordBatch], column: int, one):
        texts = [[x.as_py() or b"" for x in batch.column(column).cast(pa.binary())] for batch in held]
        out = [[[text, 0, [], set()] for text in own] for own in texts]
        for k in range(self.count):
            names, numbers, automaton = one or self.load(k)
            number = numbers.get
            for own in out:
                for row in own:
                    words = split_words(row[0])
                    row[1] = len(words)
                    if automaton and words:
                        ranges, which = hits(tuple([number(w, 0) for w in words]), automaton)
                        row[2] += ranges
                        row[3].update(names[i] for i in which)
        for batch, own in zip(held, out):
            yield batch, [(text, n, merged(ranges), sorted(items)) for text, n, ranges, items in own]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, ranges (of words), spans (of code points), items (ids of matched items, sorted as strings)."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = Blocks(benchmark, item_col, item_text_col, window, block_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in blocks.search(batches, 1):
            ranges = [[{"lo": a, "hi": b} for a, b in own] for _, _, own, _ in rows]
            spans = [[{"start": a, "end": b} for a, b in offsets_of(text.decode(), own)] if own else [] for text, _, own, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array(ranges, _RANGES), pa.array(spans, _SPANS), pa.array([r[3] for r in rows], pa.list_(pa.string()))],
                ["doc_id", "n_words", "ranges", "spans", "items"],
            )

    return given.mapInArrow(lean(scan), f"doc_id {id_type(docs, id_col)}, {_COLUMNS}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, in which no item's window occurs. No row is moved."""
    place = docs.columns.index(text_col)
    blocks = Blocks(benchmark, item_col, item_text_col, window, block_words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in blocks.search(batches, place):
            yield batch.filter(pa.array([not r[2] for r in rows], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0
), pat AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM bw
), sizes AS (SELECT DISTINCT n FROM pat
), dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n
), found AS (
  SELECT dw.doc_id, dw.i, dw.n, pat.item_id FROM dw JOIN pat ON pat.n = dw.n AND pat.s = array_to_string(list_slice(dw.w, dw.i, dw.i + dw.n - 1), ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES = {"op2_decontaminate": ORACLE}
