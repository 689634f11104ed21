"""Quality by compression: dictionaries of good and of bad text, and how much better each one compresses a text.

Two zstandard dictionaries are trained, on labelled good and labelled bad text. A text is cut into
chunks and each chunk is compressed with either; the difference of the compressed sizes over the
text's length says which text it is like. A text that repeats itself compresses to little with either,
so its size with the good dictionary over its length counts too. On labelled rows that the dictionaries
have not seen a logistic curve, with each class weighted as it is frequent among all labels, turns the
two into a probability, so that 0.5 is a fair threshold.

What is learned comes from a bounded sample of labelled rows: of each class the ``rows`` rows that
come first in the order of a hash of their id, and of those no text over ``longest`` bytes. Scoring
covers all rows and whole texts, in one pass without a shuffle.

Defined cases: null text is empty; the empty text gets the curve's value at (0, 0); without rows of either
class the score is the other class's constant, without any label 0.5; several labels for an id count each;
null labels teach nothing, null ids count as held out; an empty table gives an empty result; other columns are never inputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import id_and_text, id_type, lean, table

ROWS, LONGEST = 2_000, 65_536
CHUNK, DICTIONARY, LEVEL = 4_096, 65_536, 3
#: One row in three of the sample fits the curve, the others the dictionaries.
CURVE_SHARE = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float]
    offset: float

    def scorer(self):
        """A function from a text's bytes to its score."""
        if not self.good or not self.bad:
            constant = _sigmoid(self.offset)
            return lambda text: constant
        measure, (a, b), c = _measure(self.good, self.bad), self.weights, self.offset

        def score(text: bytes) -> float:
            x, y = measure(text)
            return _sigmoid(a * x + b * y + c)

        return score


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def _measure(good: bytes, bad: bytes):
    """For each byte of a text: bytes saved by the good dictionary over the bad one, and bytes left with the good one."""
    squeeze = []
    for raw in (good, bad):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
        d.precompute_compress(level=LEVEL)
        squeeze.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    by_good, by_bad = squeeze

    def measure(text: bytes) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        saved = left = 0
        for at in range(0, len(text), CHUNK):
            chunk = text[at : at + CHUNK]
            size = len(by_good(chunk))
            left += size
            saved += len(by_bad(chunk)) - size
        return saved / len(text), left / len(text)

    return measure


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or where there is too little text to train one, the text itself."""
    chunks = [t[at : at + CHUNK] for t in texts for at in range(0, len(t), CHUNK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, chunks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[-DICTIONARY:] or b" "


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, float], float]:
    """Weights and offset of a logistic fit by Newton steps, with a weak pull of the weights to 0."""
    middle, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    pull, w = np.array([0.01, 0.01, 1e-6]), np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (weight * p * (1 - p))[:, None]) + np.diag(pull)
        step = np.clip(np.linalg.solve(h, z.T @ (weight * (y - p)) - pull * w), -5, 5)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:2] / scale
    return (float(slopes[0]), float(slopes[1])), float(w[2] - slopes @ middle)


def train(rows: list[tuple[bytes, int]], totals: dict[int, int] | None = None) -> Model:
    """rows: texts with labels; totals: how many labels of each class there are."""
    texts = {y: [t for t, label in rows if label == y] for y in (0, 1)}
    if not texts[0] or not texts[1]:
        return Model(b"", b"", (0.0, 0.0), 0.0 if not rows else 30.0 if texts[1] else -30.0)
    # With a single row of a class it serves both ends.
    fit = {y: [t for k, t in enumerate(own) if k % CURVE_SHARE] or own for y, own in texts.items()}
    seen = {y: own[::CURVE_SHARE] for y, own in texts.items()}
    good, bad = _dictionary(fit[1]), _dictionary(fit[0])
    measure = _measure(good, bad)
    x = np.array([measure(t) for y in (0, 1) for t in seen[y]])
    y = np.array([float(y) for y in (0, 1) for _ in seen[y]])
    weight = np.array([(totals or {}).get(k, len(texts[k])) / len(seen[k]) for k in (0, 1) for _ in seen[k]])
    return Model(good, bad, *_curve(x, y, weight / weight.mean()))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", rows: int = ROWS, longest: int = LONGEST) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """At most rows texts of each class, none of a row that is held out; and how many labels each class has."""
    known = labels.select(F.col(label_id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(~held_out(F.col("doc_id")))
    totals = {r["y"]: r["count"] for r in known.filter(F.col("y").isin(0, 1)).groupBy("y").count().collect()}
    # Ids first, then their texts: at most 2 * rows ids are sent to the scan of the texts. Hashes are even, so those that
    # come first lie below a bound that leaves few more than are asked for, however many labels there are.
    first = lambda d, *ties: d.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", *ties))).filter(F.col("n") <= rows)
    below = F.lit(False)
    for y, n in totals.items():
        share = min(1.0, (rows + 8 * math.sqrt(rows) + 8) / n)
        below = below | ((F.col("y") == y) & (F.xxhash64("doc_id") <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))))
    ids = [(r["doc_id"], r["y"]) for r in first(known.filter(below)).collect()]
    if any(sum(y == k for _, y in ids) < min(rows, n) for k, n in totals.items()):  # many labels of one id can be uneven
        ids = [(r["doc_id"], r["y"]) for r in first(known.filter(F.col("y").isin(0, 1))).collect()]
    if not ids:
        return [], totals
    chosen = docs.sparkSession.createDataFrame(ids, known.schema)
    given = id_and_text(docs, id_col, text_col).filter(F.octet_length("text") <= longest)
    found = given.join(F.broadcast(chosen), "doc_id").select("y", "doc_id", "text")
    # Ids may repeat, so the bound is set again.
    return [(r["text"].encode(), r["y"]) for r in sorted(first(found, "text").collect(), key=lambda r: (r["y"], r["n"]))], totals


def _score_batches(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([of(t.as_py()) for t in batch.column("text").cast(pa.binary())], pa.float64())], ["doc_id", "score"])

    return score


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: the probability that label 1 is right."""
    return id_and_text(docs, id_col, text_col).mapInArrow(lean(_score_batches(model)), f"doc_id {id_type(docs, id_col)}, score double")


def drop_low_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score threshold or more. No row is moved."""
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(t.as_py() or b"") >= threshold for t in batch.column(place).cast(pa.binary())], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality_scores(docs, train(*sample(docs, table(spark, sf_dir, "labels"))))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
