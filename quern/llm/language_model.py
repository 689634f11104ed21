"""Language-model scores by deleted interpolation of word bigrams.

p(w | v) = a(b) * c(v w) / c(v) + d(b) * c(w) / N + e(b) / (V + 1), where b is the bucket of the context's
frequency, the power of two below c(v). Counts come from all rows to learn from; the weights of a bucket
are learned by expectation-maximisation on held-out counts: one part in ten of the rows to learn from
is taken out of the counts, and the tokens of that part are predicted from what is left.

Counts are kept by 64-bit values of words and word pairs and are never in one place:

1. Neighbouring documents are packed into compressed pieces, and pieces are dealt over blocks of a bounded size. A
   block sends its distinct values with its own counts to the ranges of values that it fills, already summed, so a
   frequent word costs a range one entry for each block.
2. Where a range is small enough for one task it adds up and answers each block with the totals of the values that
   it sent. Where it isn't, as on large corpora, bundles of blocks are added up first and sent on to narrower ranges in the
   same way, and the answers come back through the bundles. A block sends ``FAN`` messages at most, and so does a bundle,
   so messages grow with the corpus and not with its square.
3. A block looks its tokens up in its answers and writes, for each token, the counts that its
   probability needs. The weights are then learned from a small histogram of these, and scores follow
   from them without another shuffle.

Defined cases: null text is empty and has the end token alone; a null id counts as held out; repeated rows
are scored each on their own and all count, and fall into blocks by their place in the table; a very long text is a piece of its own; an empty table gives an empty result; without rows
to learn from every token has probability 1 / (V + 1) = 1; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.common import LOWER, buffer, id_and_text, id_type, lean, mix, table, text_pieces, word_hashes, written

#: Bytes of text in a block and, about, behind the values of the narrowest ranges; bytes of text in a piece.
BLOCK, SHARD, PACKED = 12 << 20, 20 << 20, 1 << 20
#: Ranges to which a block or a bundle sends at most.
FAN = 1024
#: Documents whose tokens' counts are stored together.
STORED = 512
END = np.uint64(0xF1357AEA2E62A9C5)
#: Steps of the histogram to a doubling.
FINE = 4
NONE = -(1 << 20)


def squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def squeeze_repeated(values: np.ndarray) -> bytes:
    """Integers of which many are equal: the distinct ones, the most frequent first, and for each its number there."""
    distinct, place, many = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(-many, kind="stable")
    number = np.empty(len(order), np.uint32)
    number[order] = np.arange(len(order), dtype=np.uint32)
    table_ = squeeze(distinct[order])
    numbers = np.ascontiguousarray(number[place.ravel()].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(table_).to_bytes(4, "little") + table_ + zstandard.ZstdCompressor(level=3).compress(numbers)


def expand_repeated(data: bytes) -> np.ndarray:
    at = 4 + int.from_bytes(data[:4], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at:]), np.uint8)
    return expand(data[4:at])[np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()]


def _packer(blocks: int, kind: pa.DataType, limit: int):
    """Pieces of neighbouring documents: block, ids, folds, sizes of the texts and their compressed bytes."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(kind)), ("folds", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int64())), ("blob", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        squeezer = zstandard.ZstdCompressor(level=3)
        ids: list = []
        folds: list[int] = []
        sizes: list[int] = []
        blobs: list[bytes] = []
        held = 0

        def piece() -> pa.RecordBatch:
            nonlocal seq, held
            block = int(mix(np.array([part << 32 | seq], np.uint64))[0] % np.uint64(blocks))
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, ids, folds, sizes, squeezer.compress(b"".join(blobs))), schema.types)], schema=schema)
            for x in (ids, folds, sizes, blobs):
                x.clear()
            seq, held = seq + 1, 0
            return out

        for batch in batches:
            data, offsets = buffer(batch.column("text"))
            keys, own = batch.column("doc_id").to_pylist(), batch.column("fold").to_pylist()
            lo = 0
            while lo < len(keys):  # rows up to the piece's limit, one at least
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit - held, "right")) - 1)
                ids += keys[lo:hi]
                folds += own[lo:hi]
                sizes += np.diff(offsets[lo : hi + 1]).tolist()
                blobs.append(data[offsets[lo] : offsets[hi]].tobytes())
                held += len(blobs[-1])
                lo = hi
                if held >= limit or lo < len(keys):
                    yield piece()
        if ids:
            yield piece()

    return pack


def _block_tokens(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """``tokens`` of all texts of a block's pieces."""
    values, counts = [], []
    for sizes, blob in zip(block.column("sizes").to_pylist(), block.column("blob")):
        offsets = np.cumsum([0, *sizes], dtype=np.int64)
        data = zstandard.ZstdDecompressor().decompress(blob.as_py()) if offsets[-1] else b""
        v, n = tokens(pa.Array.from_buffers(pa.large_utf8(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
        values.append(v)
        counts.append(n)
    return np.concatenate(values), np.concatenate(counts)


def tokens(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all words, each document's followed by the end token, and the number of tokens of each document."""
    values, counts = [], []
    for _, data, starts, ends, begins in text_pieces(pa.RecordBatch.from_arrays([text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text], ["text"]), LOWER):
        n = np.diff(begins)
        own = np.full(len(starts) + len(n), END)
        own[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)] = word_hashes(data, starts, ends, LOWER)
        values.append(own)
        counts.append(n + 1)
    return np.concatenate([*values, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)])


def pairs(values: np.ndarray) -> np.ndarray:
    """The value of each token with the one before it; before a document's first token stands an end token."""
    before = np.concatenate([[END], values[:-1]])
    return mix((before ^ (before >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F) + values)


_PARTS = [f"{a}{b}" for a in "ub" for b in "kch"]
_TOTALS = ("uc", "uh", "bc", "bh")
_SENT = pa.schema([("src", pa.int64()), ("rng", pa.int64()), *[(x, pa.binary()) for x in _PARTS]])
_ANSWER = pa.schema([("src", pa.int64()), ("rng", pa.int64()), *[(x, pa.binary()) for x in _TOTALS], ("n", pa.int64()), ("fit", pa.int64()), ("v", pa.int64())])
_SENT_SQL = ", ".join(["src long, rng long", *[f"{x} binary" for x in _PARTS]])
_ANSWER_SQL = ", ".join(["src long, rng long", *[f"{x} binary" for x in _TOTALS], "n long, fit long, v long"])


def _messages(src: int, first: int, ranges: int, of: int, columns: dict[str, np.ndarray]) -> pa.Table:
    """A row for each range from number first on, of so many, into which some key falls. ``of``: ranges of all values."""
    edges = np.array([(k << 64) // of for k in range(first + 1, first + ranges)], np.uint64)
    cut = {x: [0, *np.searchsorted(columns[x + "k"], edges).tolist(), len(columns[x + "k"])] for x in "ub"}
    filled = [k for k in range(ranges) if any(cut[x][k] < cut[x][k + 1] for x in "ub")]
    out: dict[str, list] = {"src": [src] * len(filled), "rng": [first + k for k in filled]}
    for name in _PARTS:
        at = cut[name[0]]
        out[name] = [squeeze(columns[name][at[k] : at[k + 1]]) for k in filled]
    return pa.table(out, _SENT)


def _sender(ranges: int):
    def send(block: pa.Table) -> pa.Table:
        values, n = _block_tokens(block)
        fold = np.repeat(np.concatenate([np.array(x, np.int32) for x in block.column("folds").to_pylist()]), n)
        learn, fit = fold != 0, fold == 1
        columns: dict[str, np.ndarray] = {}
        for name, keys in (("u", values), ("b", pairs(values))):
            columns[name + "k"], place = np.unique(keys, return_inverse=True)
            for what, which in (("c", learn), ("h", fit)):
                columns[name + what] = np.bincount(place[which], minlength=len(columns[name + "k"]))
        return _messages(block.column("block")[0].as_py(), 0, ranges, ranges, columns)

    return send


def _added(sent: pa.Table, name: str) -> tuple[np.ndarray, dict[str, np.ndarray], list[np.ndarray]]:
    """Of messages of one range the distinct keys, their sums, and the place of each message's keys among them."""
    parts = [[expand(x.as_py()) for x in sent.column(name + what)] for what in "kch"]
    keys, place = np.unique(np.concatenate(parts[0]), return_inverse=True)
    sums = {what: np.bincount(place, np.concatenate(own), len(keys)).astype(np.int64) for what, own in zip("ch", parts[1:])}  # exact up to 2^53
    return keys, sums, np.split(place, np.cumsum([len(x) for x in parts[0]])[:-1])


def _replies(sent: pa.Table, totals: dict[str, np.ndarray], places: dict[str, list[np.ndarray]]) -> pa.Table:
    """For each message the totals of its keys."""
    none = pa.nulls(sent.num_rows, pa.int64())
    own = {x: pa.array([squeeze(totals[x][at]) for at in places[x[0]]], pa.binary()) for x in _TOTALS}
    return pa.table({"src": sent.column("src"), "rng": sent.column("rng")} | own | {"n": none, "fit": none, "v": none}, _ANSWER)


def _answer(sent: pa.Table) -> pa.Table:
    """The totals for each source that asked, and a row of the range's own sums for no source."""
    which = sent.column("rng")[0].as_py()
    totals, places = {}, {}
    for name in "ub":
        _, sums, places[name] = _added(sent, name)
        totals |= {name + what: x for what, x in sums.items()}
    c = totals["uc"]
    sums = pa.table({"src": [-1 - which], "rng": [which]} | {x: pa.nulls(1, pa.binary()) for x in _TOTALS} | {"n": [int(c.sum())], "fit": [int(totals["uh"].sum())], "v": [int((c > 0).sum())]}, _ANSWER)
    return pa.concat_tables([_replies(sent, totals, places), sums])


def _bundler(ranges: int, of: int):
    """Sums of a bundle's messages of one range, sent on to the narrower ranges in it."""

    def bundle(sent: pa.Table) -> pa.Table:
        columns = {}
        for name in "ub":
            columns[name + "k"], sums, _ = _added(sent, name)
            columns |= {name + what: x for what, x in sums.items()}
        return _messages(sent.column("bundle")[0].as_py(), sent.column("rng")[0].as_py() * ranges, ranges, of, columns)

    return bundle


def _relay(sent: pa.Table, answers: pa.Table) -> pa.Table:
    """The answers to a bundle's sums, for each source in it."""
    if not sent.num_rows:  # sums of a range, for no source
        return answers.select(_ANSWER.names)
    answers = answers.sort_by("part")
    totals, places = {}, {}
    for name in "ub":
        _, _, places[name] = _added(sent, name)
    for x in _TOTALS:
        totals[x] = np.concatenate([expand(y.as_py()) for y in answers.column(x)])
    return _replies(sent, totals, places)


def exchange(sent: DataFrame, ranges: int, narrowest: int, fan: int = FAN) -> DataFrame:
    """The totals for all messages, in ranges of which there are so many; ``narrowest``: how many there must be for one to fit a task."""
    if ranges >= narrowest:
        return sent.groupBy("rng").applyInArrow(_answer, _ANSWER_SQL)
    within = min(fan, -(-narrowest // ranges))
    # As many bundles as a range would need tasks.
    sent = sent.withColumn("bundle", F.pmod(F.xxhash64("src"), F.lit(-(-narrowest // ranges))))
    on = sent.groupBy("rng", "bundle").applyInArrow(_bundler(within, ranges * within), _SENT_SQL)
    back = exchange(on, ranges * within, narrowest, fan)
    back = back.select(*[x for x in _ANSWER.names if x != "rng"], F.col("rng").alias("part"), F.expr(f"rng div {within}").alias("rng"), F.col("src").alias("bundle"))
    return sent.groupBy("rng", "bundle").cogroup(back.groupBy("rng", "bundle")).applyInArrow(_relay, _ANSWER_SQL)


def _looker(kind: pa.DataType):
    schema = pa.schema([("doc_id", pa.list_(kind)), ("fold", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int64())), *[(x, pa.binary()) for x in ("cw", "cv", "c2", "hw", "hv", "h2")], ("n", pa.int64()), ("fit", pa.int64()), ("v", pa.int64())])

    def look(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:  # a shard's sums
            none = {f.name: pa.nulls(answers.num_rows, f.type) for f in schema}
            return pa.table(none | {x: answers.column(x) for x in ("n", "fit", "v")}, schema)
        answers = answers.sort_by("rng")
        values, n = _block_tokens(block)
        found = {}
        for name, keys in (("u", values), ("b", pairs(values))):
            place = np.unique(keys, return_inverse=True)[1]
            for what in "ch":
                found[name + what] = np.concatenate([expand(x.as_py()) for x in answers.column(name + what)])[place]
        ends = np.cumsum([0, *n])
        rows: dict[str, list] = {f.name: [] for f in schema}
        ids, folds = ([x for own in block.column(c).to_pylist() for x in own] for c in ("ids", "folds"))
        # The count of the context is that of the token before; an end token stands before the first.
        before = {what: np.concatenate([found["u" + what][n[0] - 1 : n[0]], found["u" + what][:-1]]) for what in "ch"}
        order = sorted(range(len(ids)), key=lambda i: folds[i] == 1)
        split = sum(f != 1 for f in folds)
        chunks = [order[a : a + STORED] for a in range(0, split, STORED)]
        chunks[-1:] = [chunks[-1][: split % STORED or STORED]] if chunks else []
        chunks += [order[a : a + STORED] for a in range(split, len(order), STORED)]
        for chunk in chunks:
            at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in chunk])
            rows["doc_id"].append([ids[i] for i in chunk])
            rows["fold"].append([folds[i] for i in chunk])
            rows["tokens"].append([int(n[i]) for i in chunk])
            rows["cw"].append(squeeze_repeated(found["uc"][at]))
            rows["c2"].append(squeeze_repeated(found["bc"][at]))
            rows["cv"].append(squeeze_repeated(before["c"][at[np.cumsum([0, *[int(n[i]) for i in chunk[:-1]]])]]))
            fit = folds[chunk[0]] == 1
            rows["hw"].append(squeeze_repeated(found["uh"][at]) if fit else None)
            rows["h2"].append(squeeze_repeated(found["bh"][at]) if fit else None)
            rows["hv"].append(squeeze_repeated(before["h"][at[np.cumsum([0, *[int(n[i]) for i in chunk[:-1]]])]]) if fit else None)
            for x in ("n", "fit", "v"):
                rows[x].append(None)
        return pa.table({f.name: pa.array(rows[f.name], f.type) for f in schema})

    return look


def _contexts(first: np.ndarray, words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The count of each token's context: that of the token before it, or the given one for a document's first."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[np.cumsum([0, *n[:-1]])] = first
    return out


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shard: int = SHARD, fan: int = FAN, packed: int = PACKED) -> DataFrame:
    """The counts behind each token of each document, and rows of the ranges' sums (n, fit, v)."""
    kind, arrow = id_type(docs, id_col), to_arrow_type(docs.schema[id_col].dataType)
    given = id_and_text(docs, id_col, text_col)
    size = given.agg(F.sum(F.octet_length("text") + 8).alias("s")).first()["s"] or 0
    blocks, narrowest = max(1, -(-size // block)), max(1, -(-size // shard))
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)), F.lit(0)).cast("int")
    pieces = given.select("doc_id", "text", fold.alias("fold")).mapInArrow(lean(_packer(blocks, arrow, packed)), f"block long, ids array<{kind}>, folds array<int>, sizes array<long>, blob binary")
    # Written, since both what is sent and what the answers meet must be the same blocks, whatever order a recomputed input comes in.
    pieces = written(pieces, "pieces")
    ranges = min(fan, narrowest)
    sent = pieces.groupBy("block").applyInArrow(_sender(ranges), _SENT_SQL)
    answers = exchange(sent, ranges, narrowest, fan).withColumnRenamed("src", "block")
    out = f"doc_id array<{kind}>, fold array<int>, tokens array<long>, cw binary, cv binary, c2 binary, hw binary, hv binary, h2 binary, n long, fit long, v long"
    return pieces.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_looker(arrow), out)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never met, else 1 and the power of two below."""
    return np.where(context > 0, np.frexp(context.astype(np.float64))[1], 0)


def _histogram(n: int, v: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                take = lambda x: expand_repeated(batch.column(x)[k].as_py()).astype(np.int64)  # noqa: B023, E731
                length = np.array(batch.column("tokens")[k].as_py())
                cw, hw = take("cw"), take("hw")
                cv, hv = _contexts(take("cv"), cw, length), _contexts(take("hv"), hw, length)
                left2, leftv, leftw = take("c2") - take("h2"), cv - hv, cw - hw
                with np.errstate(divide="ignore", invalid="ignore"):
                    q2 = np.where(left2 > 0, np.rint(FINE * np.log2(left2 / leftv)), NONE)
                    q1 = np.where(leftw > 0, np.rint(FINE * np.log2(leftw / max(n, 1))), NONE)
                rows, many = np.unique(np.column_stack([bucket(leftv), q2, q1]).astype(np.int64), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in rows.T.copy()], pa.array(many)], ["b", "q2", "q1", "many"])

    return count


def weights(histogram: list[tuple[int, int, int, int]], v: int, rounds: int = 200) -> dict[int, tuple[float, float, float]]:
    """Of each bucket the weights of pair, word and uniform estimate, from (bucket, log of the pair's, of the word's estimate, how many)."""
    out = {}
    data = np.array(histogram, np.float64).reshape(-1, 4)
    for b in range(65):
        own = data[data[:, 0] == b]
        p = np.column_stack([np.where(own[:, 1] > NONE, 2 ** (own[:, 1] / FINE), 0), np.where(own[:, 2] > NONE, 2 ** (own[:, 2] / FINE), 0), np.full(len(own), 1 / (v + 1))])
        # A count of one for each estimate keeps all weights above 0; pairs say nothing about a context never met.
        w = np.array([1.0, 1.0, 1.0]) / 3 if b else np.array([0.0, 0.5, 0.5])
        for _ in range(rounds if len(own) else 0):
            share = p * w
            share /= share.sum(1, keepdims=True)
            w = (own[:, 3] @ share + (1.0 if b else np.array([0.0, 1.0, 1.0])))
            w = w / w.sum()
        out[b] = tuple(w.tolist()) if len(own) else None
    known = [b for b in out if b and out[b]]
    for b in out:
        if not out[b]:  # never met on held-out tokens: as the nearest bucket that was
            out[b] = out[min(known, key=lambda x: abs(x - b))] if b and known else (0.6, 0.3, 0.1) if b else (0.0, 0.5, 0.5)
    return out


def _scorer(n: int, v: int, mixture: dict[int, tuple[float, float, float]], kind: pa.DataType):
    table_ = np.array([mixture[b] for b in range(65)]) if n else np.tile([0.0, 0.0, 1.0], (65, 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                take = lambda x: expand_repeated(batch.column(x)[k].as_py()).astype(np.int64)  # noqa: B023, E731
                length = np.array(batch.column("tokens")[k].as_py())
                cw, c2 = take("cw"), take("c2")
                cv = _contexts(take("cv"), cw, length)
                w = table_[bucket(cv)]
                p = w[:, 0] * (c2 / np.maximum(cv, 1)) + w[:, 1] * (cw / max(n, 1)) + w[:, 2] / (v + 1)
                first = np.cumsum([0, *length[:-1]])
                total = lambda x: pa.array(np.add.reduceat(x, first))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column("doc_id")[k].as_py(), kind), pa.array([f == 0 for f in batch.column("fold")[k].as_py()]), pa.array(length), total((cw > 0).astype(np.int64)), pa.array(np.full(len(length), n, np.int64)), total(np.log10((cw + 0.1) / (n + 0.1 * (v + 1)))), total(np.log10(p))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shard: int = SHARD, fan: int = FAN, packed: int = PACKED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = id_type(docs, id_col)
    counts = written(counted(docs, id_col, text_col, block, shard, fan, packed), "counts")
    total = counts.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "fit", "v")]).first()
    n, v = total["n"], total["v"]
    rows = counts.filter("doc_id IS NOT NULL")
    seen = rows.filter("hw IS NOT NULL").mapInArrow(lean(_histogram(n - total["fit"], v)), "b long, q2 long, q1 long, many long")
    # Buckets times steps of the two estimates: a bound that does not grow with the corpus.
    histogram = seen.groupBy("b", "q2", "q1").agg(F.sum("many").alias("many")).collect()
    id_arrow = to_arrow_type(docs.schema[id_col].dataType)
    return rows.mapInArrow(lean(_scorer(n, v, weights([tuple(r) for r in histogram], v), id_arrow)), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


QUERIES = {"op6_language_model": op6_language_model}
ORACLES: dict[str, str] = {}
