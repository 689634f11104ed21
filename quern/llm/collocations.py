"""Phrase collocation mining: n-grams as rows, counted by language, scored by their weakest cut.

1. Texts become pieces at punctuation and line ends, pieces words, and the 1 to max_n words from each word on rows, counted within a task first.
   An n-gram that holds a rarer n-gram than ``least`` can neither be a candidate nor part of one, so level by level
   only those rows are made whose parts are frequent: words, then pairs, then all longer ones are counted by 64-bit values, and
   what is frequent goes to the tasks as a bit filter whose size is bounded. A filter may let more through, at the cost of rows alone.
   Each row also names a text that has the n-gram; the last pass reads the n-grams' words from the texts so named, about once for each.
2. Each candidate joins the counts of what stands before and behind each of its cuts; scores are integer quotients in Decimal.
3. Extensions by one word that keep ``percent`` of the occurrences take a candidate out by an anti join. Longer extensions need no look:
   what they hold between occurs at least as often.
4. Ranks come from windows over slices of a language and then over the slices' first rows.

Defined cases: a null text is empty, a null language ``und`` as is the language of that name; repeated rows and equal ids count as often as they come; the id is never looked at,
nor are other columns; words of any length are read whole, texts too, cut where a piece ends; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import PIECE, Filter, buffer, byte_table, lean, mix, ngrams, table, word_hashes, words, written

#: Bytes that end a piece, and those between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KINDS = byte_table(ENDS + BLANKS, lower=True)
_ENDS = np.isin(np.arange(256), list(ENDS))
#: Different n-grams that a task counts before it sends them on.
HELD = 1 << 20
#: Slices of a language that are ranked on their own.
SLICES = 64


def _language(name: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))


def _cuts(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of about limit at most that end with a text, or else with a piece."""
    ends = np.flatnonzero(_ENDS[data]) + 1
    at, total = int(offsets[0]), int(offsets[-1])
    while at < total:
        to = total
        if total - at > limit:
            text = offsets[np.searchsorted(offsets, at + limit, "right") - 1]
            to = int(text)
            if text <= at:  # no text ends within the limit: the last piece that does, or else the first piece's or text's end
                k = np.searchsorted(ends, at + limit, "right")
                last = ends[k - 1] if k and ends[k - 1] > at else ends[k] if k < len(ends) else total
                to = int(min(last, offsets[np.searchsorted(offsets, at, "right")]))
        yield at, to
        at = to


class Grams:
    """The words of some texts, and of each run of n words a value that also depends on the language. names: 32 bits of each text."""

    def __init__(self, data: np.ndarray, lo: int, hi: int, offsets: np.ndarray, languages: np.ndarray, names: np.ndarray):
        self.data = data[lo:hi]
        inner = offsets[(offsets > lo) & (offsets < hi)]
        bounds = np.concatenate([[lo], inner, [hi]]) - lo
        self.starts, self.ends, begins = words(self.data, bounds, KINDS)
        self.h = word_hashes(self.data, self.starts, self.ends, KINDS)
        self.text = np.searchsorted(offsets, self.starts + lo, "right") - 1 if len(self.starts) else np.zeros(0, np.int64)
        ended = np.concatenate([[0], np.cumsum(_ENDS[self.data])])
        new = np.ones(len(self.starts), bool)
        if len(new):
            new[1:] = ended[self.starts[1:]] != ended[self.starts[:-1]]
            new[begins[:-1][begins[:-1] < len(new)]] = True
        self.piece = np.cumsum(new)
        self.language, self.name = languages[self.text], names[self.text]

    def values(self, n: int) -> np.ndarray:
        return mix(ngrams(self.h, n) ^ self.language[: len(self.h) - n + 1] + np.uint64(n)) if len(self.h) >= n else np.zeros(0, np.uint64)

    def inside(self, n: int) -> np.ndarray:
        """Of each word whether n words from it on are of one piece."""
        return self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1] if len(self.piece) >= n else np.zeros(0, bool)

    def frequent(self, n: int, filters: list[Filter]) -> np.ndarray:
        """Of each run of n words whether all its words, pairs and, where a third filter is there, longer parts and itself may be frequent."""
        ok = self.inside(n)
        for size, filter_ in enumerate(filters[:2], start=1):
            if size <= n and len(ok):
                part = filter_.has(self.values(size))
                for k in range(n - size + 1):
                    ok &= part[k : k + len(ok)]
        if len(filters) > 2 and n > 2 and len(ok):
            ok[ok] = filters[2].has(self.values(n)[ok])
        return ok

    def phrase(self, first: int, n: int) -> str:
        return b" ".join(_LOWER[self.data[a:b]].tobytes() for a, b in zip(self.starts[first : first + n], self.ends[first : first + n])).decode()


_LOWER = (KINDS - 1).astype(np.uint8)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Grams, list[str]]]:
    for batch in batches:
        data, offsets = buffer(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        languages = np.array([_language(x) for x in langs], np.uint64)
        names = batch.column("name").to_numpy(zero_copy_only=False)
        for lo, hi in _cuts(data, offsets):
            yield Grams(data, lo, hi, offsets, languages, names), langs


def _named(values: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Values of n-grams of one text each."""
    names = names.view(np.uint32).astype(np.uint64)
    return values ^ names ^ (names << np.uint64(32))


def _counter(sizes: tuple[int, ...], filters) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows k, c, name: values of the n-grams of these sizes, how often they come, and a text that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            k, c, name = (np.concatenate([*(p[i] for p in parts), np.zeros(0, kind)]) for i, kind in enumerate((np.uint64, np.int64, np.int32)))
            order = np.argsort(k)
            k, c, name = k[order], c[order], name[order]
            at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            return (k[at], np.add.reduceat(c, at), np.minimum.reduceat(name, at)) if len(at) else (k, c, name)

        def sent(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(rows[0]), 1 << 16):
                k, c, name = (x[lo : lo + (1 << 16)] for x in rows)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c), pa.array(name)], ["k", "c", "name"])

        known = filters.value
        for grams, _ in _read(batches):
            for n in sizes:
                at = np.flatnonzero(grams.frequent(n, known))
                k, first, c = np.unique(grams.values(n)[at], return_index=True, return_counts=True)
                parts.append((k, c, grams.name[at[first]]))
                held += len(k)
            if held > 2 * HELD:
                parts[:] = [merged()]
                held = len(parts[0][0])
                if held > HELD:
                    yield from sent(parts.pop())
                    held = 0
        yield from sent(merged())

    return run


def _teller(max_n: int, filters, texts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows k, lang, n, phrase of the n-grams in the texts that were named for them; and n 0 with the number of all words, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, named, total, told = filters.value, texts.value, {}, set()
        for grams, langs in _read(batches):
            for text, c in zip(*(x.tolist() for x in np.unique(grams.text, return_counts=True))):
                total[langs[text]] = total.get(langs[text], 0) + c
            out: tuple[list, ...] = ([], [], [], [])
            for n in range(1, max_n + 1):
                at = np.flatnonzero(grams.frequent(n, known))
                values = grams.values(n)[at]
                mine = named.has(_named(values, grams.name[at]))
                values, first = np.unique(values[mine], return_index=True)
                for value, i in zip(values.view(np.int64).tolist(), at[mine][first].tolist()):
                    if value not in told:
                        told.add(value)
                        for x, y in zip(out, (value, langs[grams.text[i]], n, grams.phrase(i, n))):
                            x.append(y)
            if len(told) > HELD:
                told.clear()
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()), pa.nulls(len(out[0]), pa.int64())], ["k", "lang", "n", "phrase", "c"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(total), pa.int64()), pa.array(list(total), pa.string()), pa.array([0] * len(total), pa.int32()), pa.array([""] * len(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["k", "lang", "n", "phrase", "c"])

    return run


def counted(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = 4, least: int = 30) -> DataFrame:
    """lang, n, phrase, f of all phrases of up to max_n words that come least times or more; n is 0 for the number of words of a language."""
    context = docs.sparkSession.sparkContext
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"), F.hash(text).alias("name"))
    filters: list[Filter] = []
    frequent = None
    for sizes in [s for s in ((1,), (2,), tuple(range(3, max_n + 1))) if s and s[0] <= max_n]:
        rows = given.mapInArrow(lean(_counter(sizes, context.broadcast(filters))), "k long, c long, name int")
        level = written(rows.groupBy("k").agg(F.sum("c").alias("f"), F.min("name").alias("name")).filter(F.col("f") >= least), "frequent")
        filters = [*filters, Filter.of(level.select("k"))]
        frequent = level if frequent is None else frequent.unionByName(level)
    name = F.col("name").cast("long").bitwiseAND(F.lit((1 << 32) - 1))
    texts = Filter.of(frequent.select(F.col("k").bitwiseXOR(name).bitwiseXOR(F.shiftleft(name, 32)).alias("k")))
    told = written(given.mapInArrow(lean(_teller(max_n, context.broadcast(filters), context.broadcast(texts))), "k long, lang string, n int, phrase string, c long"), "told")
    phrases = told.filter("n > 0").groupBy("k").agg(F.min(F.struct("lang", "n", "phrase")).alias("x"))
    phrases = phrases.join(frequent.select("k", "f"), "k").select("x.lang", "x.n", "x.phrase", "f")
    return phrases.unionByName(told.filter("n = 0").groupBy("lang", "n", "phrase").agg(F.sum("c").alias("f")))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = 4, least: int = 30, percent: int = 80, top: int = 2000, scale: int = 2_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first phrases of 2 to max_n words."""
    if max_n < 2 or least < 1 or top < 1 or percent < 1:
        raise ValueError("max_n must be at least 2, least, percent and top positive")
    f = written(counted(docs, lang_col, text_col, max_n, least), "phrases")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    found = f.filter("n > 1").withColumn("w", F.split("phrase", " ", -1))
    # What an extension by one word keeps of the occurrences of its two longest parts.
    part = lambda start: F.concat_ws(" ", F.slice("w", F.lit(start), F.col("n") - 1))
    longer = found.filter("n > 2").select("lang", F.explode(F.array(part(1), part(2))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("more"))
    kept = found.join(longer.withColumnRenamed("phrase", "_p").withColumnRenamed("lang", "_l"), (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")) & (F.lit(100).cast("decimal(3,0)") * exact("more") >= F.lit(percent).cast("decimal(10,0)") * exact("f")), "left_anti")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("cut"))).alias("before"), F.concat_ws(" ", F.slice("w", F.col("cut") + 1, F.col("n") - F.col("cut"))).alias("behind"))
    counts = f.filter("n > 0")
    for name, side in (("l", "before"), ("r", "behind")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr(f"cast({scale} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = "ORDER BY score DESC, a DESC, phrase"
    first = best.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))).withColumn("_k", F.expr(f"row_number() OVER (PARTITION BY lang, _slice {order})")).filter(F.col("_k") <= top)
    ranked = first.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).filter(F.col("rank") <= top)
    total = f.filter("n = 0").select("lang", F.col("f").alias("n"))  # a row for each language
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), g AS (
  SELECT lang, k AS n, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)
), f AS MATERIALIZED (SELECT lang, n, phrase, count(*) AS f FROM g GROUP BY ALL
), t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE n = 1 GROUP BY lang
), c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE n > 1 AND f >= 30
), inner_ AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(f) AS more FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM c, (SELECT unnest(range(2, 4)) AS k) WHERE k < n) GROUP BY ALL
), kept AS (SELECT c.* FROM c LEFT JOIN inner_ i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.more IS NULL OR 100 * i.more < 80 * c.f
), s AS (
  SELECT k.lang, k.phrase, k.f AS a, k.cut, x.f AS l, y.f AS r, ((2000000 * k.f::HUGEINT) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, n)) AS cut FROM kept) k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1 : cut], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[cut + 1 : k.n], ' ')
), b AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS m FROM s) WHERE m = 1
), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, t.n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": ORACLE}
