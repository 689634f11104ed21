"""Substring dedup: an FM-index per shard finds the word windows that an earlier document has too.

A window is ``width`` consecutive words. Each is assigned the least value among its runs of ``gram`` words,
its anchor; windows with equal words have equal anchors, and neighbours mostly share theirs. So:

1. Runs of windows with one anchor become segments, of a bounded length, each known by 128 bits of its words. Segments
   with equal words are one class, which its least document stands for: in all later documents all of it goes, as the
   index would say of a text that it holds. Anchors that only one document has are left out, and with them nearly
   all text that repeats nowhere.
2. Where an anchor has several classes, these meet in one shard, with the words of their least documents. A
   compressed FM-index over the shard's segments is searched backwards with each of them in turn, which tells
   for every word whether it lies in a window that occurs in a document with a lesser id.
3. The words so found are joined by document and taken out of it.

An anchor whose classes have more than ``anchor_words`` words, such as a phrase that stands in very many contexts, would make
a shard too large. The windows of such classes get finer anchors, from runs of twice as many words, and go through the
same steps; contexts that are their own then have anchors of their own and drop out. The last anchor is the whole
window, which has one class. So shards are bounded by their words on any corpus, and no step sees all copies of a passage.

Defined cases: null, empty or short text has no window and loses nothing; of rows with equal ids none is
earlier; a null id is later than all others; very long and repetitive texts are read whole; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.common import PLAIN, id_and_text, id_type, lean, mix, ngrams, table, text_pieces, word_hashes, written
from quern.llm.fm_index import FMIndex, matched_windows

WIDTH, GRAM = 50, 8
#: Words of one anchor's classes in a shard at most; words in a shard, about; windows in a segment at most.
ANCHOR_WORDS, SHARD_WORDS, LONGEST = 250_000, 1_000_000, 2_000
#: So many ids at most are sent to all executors.
SENT = 200_000


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    width, out = 1, values
    while 2 * width <= n:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    return np.minimum(out[: len(values) - n + 1], out[n - width :]) if len(values) >= n else values[:0]


def segments(h: np.ndarray, begins: np.ndarray, width: int, gram: int, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of word values of documents that begin at begins: document, first window, last window (in the document), anchor."""
    none = np.zeros(0, np.int64)
    count = np.maximum(np.diff(begins) - width + 1, 0)
    if not count.sum():
        return none, none, none, np.zeros(0, np.uint64)
    anchor = _least(ngrams(h, gram), width - gram + 1)
    doc = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    window = np.arange(len(doc)) - first[doc]
    anchor = anchor[begins[doc] + window]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
    at = np.flatnonzero(new)
    many = -(-np.diff(np.append(at, len(doc))) // longest)  # parts of each run
    if many.max() > 1:
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(at, many) + nth * longest
    end = np.append(at[1:], len(doc)) - 1
    return doc[at], window[at], window[end], anchor[at]


#: The prime 2^61 - 1, and two fixed bases of polynomials modulo it.
PRIME = np.uint64((1 << 61) - 1)
BASES = (0x0B2D3A9F4C6E8157, 0x15F1C7A3528D6E4B)
_POWERS: dict[int, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of values below it, from halves of 31 bits, since 2^61 is 1."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * a1 * b1 + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + a0 * b0)


def powers(base: int, n: int) -> np.ndarray:
    """Powers of a base modulo PRIME from the power 0 on: n of them at least."""
    out = _POWERS.get(base, np.ones(1, np.uint64))
    while len(out) < n:
        out = np.concatenate([out, times(out, np.uint64(pow(base, len(out), int(PRIME))))])
    _POWERS[base] = out
    return out


def contents(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two values of the n words from each first on: polynomials over their values modulo a prime of 61 bits, with two bases."""
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    out, h, half = [], _reduced(h), np.uint64(31)
    for base in BASES:
        terms = times(h, powers(base, len(h))[: len(h)])
        low, high = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (terms & np.uint64((1 << 31) - 1), terms >> half))
        low, high = low[first + n] - low[first], high[first + n] - high[first]
        total = _reduced(_reduced(low) + times(_reduced(high), np.uint64(1 << 31)))
        out.append(mix(times(total, powers(pow(base, -1, int(PRIME)), len(h))[first]) ^ n.astype(np.uint64) << np.uint64(40)))
    return out[0], out[1]


_LISTS = "anchor array<long>, n array<int>, k1 array<long>, k2 array<long>, at array<array<int>>"


def _grouped(doc: np.ndarray, a: np.ndarray, n: np.ndarray, anchor: np.ndarray, k1: np.ndarray, k2: np.ndarray, rows: int) -> list[pa.Array]:
    """Lists for each document of its different segments, each with all its places."""
    order = np.lexsort((a, k2, k1, doc))
    doc, a, n, anchor, k1, k2 = (x[order] for x in (doc, a, n, anchor, k1, k2))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    at = np.flatnonzero(new)
    cut = pa.array(np.searchsorted(doc[at], np.arange(rows + 1)).astype(np.int32))
    places = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)).astype(np.int32)), pa.array(a.astype(np.int32)))
    return [pa.ListArray.from_arrays(cut, x) for x in (pa.array(anchor[at].view(np.int64)), pa.array(n[at].astype(np.int32)), pa.array(k1[at].view(np.int64)), pa.array(k2[at].view(np.int64)), places)]


_NAMES = ["doc_id", "th", "anchor", "n", "k1", "k2", "at"]


def _finder(width: int, gram: int, longest: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, starts, ends, begins in text_pieces(batch, PLAIN):
                h = word_hashes(data, starts, ends, PLAIN)
                doc, a, b, anchor = segments(h, begins, width, gram, longest)
                n = b - a + width
                lists = _grouped(doc, a, n, anchor, *contents(h, begins[doc] + a, n), len(begins) - 1)
                own = batch.slice(lo, len(begins) - 1)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("th"), *lists], _NAMES)

    return find


def _refiner(width: int, gram: int, longest: int, least: int):
    """Finer segments, by runs of gram words, of the segments that come with each text."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, starts, ends, begins in text_pieces(batch, PLAIN):
                h = word_hashes(data, starts, ends, PLAIN)
                held, firsts, doc_of = [], [], []
                for k in range(len(begins) - 1):
                    for s in batch.column("segments")[lo + k].as_py():
                        for place in s["at"]:
                            first = int(begins[k]) + place
                            held.append(h[first : first + s["n"]])
                            firsts.append(place)
                            doc_of.append(k)
                own = np.concatenate([*held, np.zeros(0, np.uint64)])
                at = np.cumsum([0, *map(len, held)])
                part, a, b, anchor = segments(own, at, width, gram, longest)
                n = b - a + width
                doc = np.array(doc_of, np.int64)[part]
                lists = _grouped(doc, np.array(firsts, np.int64)[part] + a, n, anchor, *contents(own, at[part] + a, n), len(begins) - 1)
                rows = batch.slice(lo, len(begins) - 1)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("th"), *lists], _NAMES)

    return refine


def _cutter(kind: pa.DataType):
    """Segments with their places and the values of their words."""
    schema = pa.schema([("doc_id", kind), ("th", pa.int64()), ("at", pa.list_(pa.int32())), ("anchor", pa.int64()), ("words", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, starts, ends, begins in text_pieces(batch, PLAIN):
                h = word_hashes(data, starts, ends, PLAIN)
                rows: dict[str, list] = {f.name: [] for f in schema}
                for k in range(len(begins) - 1):
                    own = h[begins[k] : begins[k + 1]]
                    key, th = batch.column("doc_id")[lo + k].as_py(), batch.column("th")[lo + k].as_py()
                    for s in batch.column("segments")[lo + k].as_py():
                        rows["doc_id"].append(key)
                        rows["th"].append(th)
                        rows["at"].append(s["at"])
                        rows["anchor"].append(s["anchor"])
                        rows["words"].append(own[s["at"][0] : s["at"][0] + s["n"]].astype("<u8").tobytes())
                yield pa.RecordBatch.from_pydict(rows, schema)

    return cut


def _searcher(width: int, kind: pa.DataType):
    schema = pa.schema([("doc_id", kind), ("th", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def search(shard: pa.Table) -> pa.Table:
        ids = shard.column("doc_id").to_pylist()
        ranks = {x: k for k, x in enumerate(sorted({x for x in ids if x is not None}))}
        rank = [ranks.get(x, len(ranks)) for x in ids]
        words, places = shard.column("words").to_pylist(), shard.column("at").to_pylist()
        equal: dict[bytes, list[int]] = {}  # rows of one class: one document, or rows that share its id
        for k, w in enumerate(words):
            equal.setdefault(w, []).append(k)
        kept = [own[0] for own in equal.values()]
        lengths = np.array([len(words[k]) // 8 for k in kept])
        start = np.cumsum(np.append(0, lengths + 1))[:-1]
        values, symbols = np.unique(np.frombuffer(b"".join([words[k] for k in kept]), "<u8"), return_inverse=True)
        text = np.zeros(int(lengths.sum()) + len(kept), np.int64)  # a 0 ends each segment
        text[np.arange(len(symbols)) + np.repeat(np.arange(len(kept)), lengths)] = symbols + 1
        owner = np.array([rank[k] for k in kept])
        index = FMIndex(text, len(values) + 1, np.repeat(owner, lengths + 1))
        q, at = matched_windows(index, text, start, lengths - width + 1, owner, width)
        rows, lo = [], []
        for k, a in zip(np.array(kept)[q].tolist(), at.tolist()):
            for same in equal[words[k]]:
                for place in places[same]:
                    rows.append(same)
                    lo.append(place + a)
        take = pa.array(rows, pa.int64())
        lo = pa.array(lo, pa.int64())
        return pa.table([shard.column("doc_id").take(take), shard.column("th").take(take), lo, pc.add(lo, width)], schema)

    return search


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, anchor_words: int = ANCHOR_WORDS, shard_words: int = SHARD_WORDS, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, th, text) and their ranges of words to remove (doc_id, th, ranges: arrays of lo, hi, unmerged)."""
    if width <= gram:
        raise ValueError("width must exceed gram")
    kind, arrow = id_type(docs, id_col), to_arrow_type(docs.schema[id_col].dataType)
    given = id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    lists = f"doc_id {kind}, th long, {_LISTS}"
    cuts = given.mapInArrow(lean(_finder(width, gram, longest)), lists)
    gone: list[DataFrame] = []
    finer = gram

    def with_text(rows: DataFrame, level: int) -> DataFrame:
        texts = given
        if level:  # rows of few documents: where their ids can be sent, only their texts move
            ids = rows.select("doc_id").distinct()
            if ids.count() <= SENT:
                texts = given.join(F.broadcast(ids), given["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
        own = rows.groupBy("doc_id", "th").agg(F.collect_set(F.struct("anchor", "n", "at")).alias("segments"))
        same = texts["doc_id"].eqNullSafe(own["doc_id"]) & (texts["th"] == own["th"])
        return texts.join(own, same).select(texts["doc_id"], texts["th"], "text", "segments")

    level = 0
    while True:
        cuts = written(cuts, "cuts")
        each = cuts.select("doc_id", "th", F.explode(F.arrays_zip("anchor", "n", "k1", "k2", "at")).alias("s")).select("doc_id", "th", "s.*")
        same = ["anchor", "k1", "k2", "n"]
        # Anchors of one document go first: nearly all.
        met = written(each.groupBy("anchor").agg(F.min(order).alias("x"), F.max(order).alias("y")).filter("x != y").select("anchor"), "anchors")
        each = written(each.join(met, "anchor"), "met")
        classes = written(each.groupBy(*same).agg(F.min(order).alias("x"), F.max(order).alias("y")), "classes")
        mixed = written(classes.groupBy("anchor").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("words")).filter("lo != hi").select("anchor", "words"), "mixed")
        marked = classes.join(mixed, "anchor", "left").filter("x != y OR words IS NOT NULL")
        rows = written(each.join(marked.drop("y"), same).select("doc_id", "th", "anchor", "n", "at", "words", (order > F.col("x")).alias("later")).filter("later OR words IS NOT NULL"), "segments")
        gone.append(rows.filter("later").select("doc_id", "th", "n", F.explode("at").alias("a")).select("doc_id", "th", F.col("a").cast("long").alias("lo"), (F.col("a") + F.col("n")).cast("long").alias("hi")))
        first = rows.filter("NOT later")
        calm = F.col("words") <= anchor_words
        total = first.agg(F.sum(F.when(calm, F.col("n"))).alias("calm"), F.sum(F.when(~calm, F.col("n"))).alias("large")).first()
        if total["calm"]:
            shards = max(1, -(-total["calm"] // shard_words))
            dealt = with_text(first.filter(calm), level).mapInArrow(lean(_cutter(arrow)), f"doc_id {kind}, th long, at array<int>, anchor long, words binary")
            dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
            gone.append(dealt.groupBy("shard").applyInArrow(_searcher(width, arrow), f"doc_id {kind}, th long, lo long, hi long"))
        if not total["large"]:
            break
        finer, level = min(2 * finer, width), level + 1
        cuts = with_text(first.filter(~calm), level).mapInArrow(lean(_refiner(width, finer, longest, gram)), lists)
    found = functools.reduce(DataFrame.unionByName, gone)
    return given, found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def without(text: bytes, ranges: list[dict]) -> tuple[int, int, bytes]:
    """Number of words, of removed ones, and the kept ones joined by spaces."""
    own = text.split()
    kept, at = [], 0
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
        if lo > at:
            kept += own[at:lo]
        at = max(at, hi)
    kept += own[at:]
    return len(own), len(own) - len(kept), b" ".join(kept)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, kept = [], [], []
        for text, ranges in zip(batch.column("text").cast(pa.binary()), batch.column("ranges")):
            a, b, c = without(text.as_py(), ranges.as_py() or [])
            n.append(a)
            gone.append(b)
            kept.append(c)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, anchor_words: int = ANCHOR_WORDS, shard_words: int = SHARD_WORDS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text."""
    given, found = repeated(docs, id_col, text_col, width, gram, anchor_words, shard_words, longest)
    same = given["doc_id"].eqNullSafe(found["doc_id"]) & (given["th"] == found["th"])
    rows = given.join(found, same, "left").select(given["doc_id"], "text", "ranges")
    return rows.mapInArrow(lean(_remove), f"doc_id {id_type(docs, id_col)}, n_words long, n_removed long, kept_text string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (h) WHERE doc_id > m)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES = {"op8_substring_dedup": ORACLE}
