"""Vector code compression: product quantisation whose codebooks are learned by integer k-means over an RDD of columnar blocks.

Vectors become integers, floor(scale * x), and blocks of them NumPy arrays with a row for each dimension, written once to the
shared folder. Each round sends the codebooks, a bound that does not grow with the table, to all tasks; a task adds up squared
distances dimension by dimension, takes the nearest entry, and adds its vectors into int64 tensors of sums and counts, which
``treeAggregate`` merges level by level. All arithmetic is in integers, so results are the same however rows are dealt.

Defined cases: rows whose vector is null or holds a null or a number that is not finite are left out; so are rows whose vector has another length
than that of the kept row with the least id; an empty table, or one without kept rows, gives an empty result; rows with
equal ids are rows of their own, in the order of their vectors among the first entries; a null id is the largest; labels that are null
count as one label; other columns are never looked at. Components over 2^27 in size are refused with a ValueError, as squares of
their differences would pass 64 bits, and so is a length that the parts don't divide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.common import id_type, table, written

#: Rows of a block at most, and rows whose distances are held at a time.
BLOCK, STRIP = 8192, 512
#: Levels of the reduction tree.
DEPTH = 3


def columns_of(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x), a row for each dimension."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return np.ascontiguousarray(np.floor(x * scale).astype(np.int64).T)


def _blocks(scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = columns_of(part.column("vec"), scale)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([part.num_rows]), pa.array([x.astype(np.int32).tobytes()], pa.binary())], ["ids", "labels", "rows", "data"])

    return run


def _array(data: bytes, rows: int) -> np.ndarray:
    """A block's numbers, dimension by row."""
    return np.frombuffer(data, np.int32).reshape(-1, rows)


def nearest(x: np.ndarray, book: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each column of x the nearest entry, the first of equal ones, and the squared distance. book: dimension by entry."""
    kind = np.int64 if wide else np.int32
    x, book = x.astype(kind, copy=False), book.astype(kind)
    code, error = np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)
    for lo in range(0, x.shape[1], STRIP):
        own = x[:, lo : lo + STRIP]
        distance = np.zeros((own.shape[1], book.shape[1]), kind)
        step = np.empty_like(distance)
        for dimension in range(len(book)):
            np.subtract(own[dimension][:, None], book[dimension], out=step)
            np.multiply(step, step, out=step)
            distance += step
        best = distance.argmin(1)
        code[lo : lo + STRIP], error[lo : lo + STRIP] = best, distance[np.arange(len(best)), best]
    return code, error


Books = list[np.ndarray]


def _step(books: Books, wide: bool) -> Callable[[tuple[np.ndarray, np.ndarray], tuple[int, bytes]], tuple[np.ndarray, np.ndarray]]:
    def add(held: tuple[np.ndarray, np.ndarray], block: tuple[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = held
        x = _array(block[1], block[0])
        width = len(x) // len(books)
        for part, book in enumerate(books):
            own = x[part * width : (part + 1) * width]
            code, _ = nearest(own, book, wide)
            np.add.at(sums[part], code, own.T.astype(np.int64))
            np.add.at(counts[part], code, 1)
        return sums, counts

    return add


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def _coder(books: Books, wide: bool, kinds: tuple[pa.DataType, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    digits = np.array([f"{k:02x}" for k in range(256)], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = _array(batch.column("data")[k].as_py(), batch.column("rows")[k].as_py())
                width, text, error = len(x) // len(books), "", 0
                for part, book in enumerate(books):
                    code, own = nearest(x[part * width : (part + 1) * width], book, wide)
                    text, error = text + digits[code], error + own
                ids, labels = (pa.array(batch.column(c)[k].values, kind) for c, kind in zip(("ids", "labels"), kinds))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def codebooks(blocks: DataFrame, books: Books, rounds: int, wide: bool) -> Books:
    """The codebooks after so many rounds over blocks (rows, data)."""
    context = blocks.sparkSession.sparkContext
    rdd = blocks.select("rows", "data").rdd.map(lambda r: (r[0], bytes(r[1])))
    for _ in range(rounds):
        sent = context.broadcast(books)
        zero = (np.zeros((len(books), books[0].shape[1], books[0].shape[0]), np.int64), np.zeros((len(books), books[0].shape[1]), np.int64))
        sums, counts = rdd.treeAggregate(zero, lambda held, block, sent=sent: _step(sent.value, wide)(held, block), _merged, DEPTH)
        books = [np.where(n > 0, (s // np.maximum(n, 1)[:, None]).T, book) for book, s, n in zip(books, sums, counts)]
        sent.unpersist()
    return books


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Books]:
    """vec_id, label, code, error of all kept rows, and the final codebooks (dimension by entry, for each part)."""
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("entries must lie between 1 and 256, parts be positive, rounds not be negative")
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    good = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = given.filter(F.coalesce(good, F.lit(False)))
    order = [F.col("vec_id").asc_nulls_last(), "vec"]
    head = kept.orderBy(*order).limit(1).collect()
    names = f"vec_id {id_type(vectors, id_col)}, label {id_type(vectors, label_col)}, code string, error long"
    if not head:
        return vectors.sparkSession.createDataFrame([], names), []
    length = len(head[0]["vec"])
    if length % parts:
        raise ValueError(f"{length} components can't be cut into {parts} equal parts")
    kept = kept.filter(F.size("vec") == length)
    largest = kept.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 0.0
    if largest * scale >= 1 << 27:
        raise ValueError("components are too large for exact distances in 64 bits")
    # Twice the largest value is the largest difference; its squares must fit.
    wide = length // parts * (2 * math.ceil(largest * scale) + 2) ** 2 >= 1 << 31
    first = np.floor(np.array([r["vec"] for r in kept.orderBy(*order).limit(entries).select("vec").collect()]).reshape(-1, length) * scale).astype(np.int64).T
    width = length // parts
    books = [first[p * width : (p + 1) * width] for p in range(parts)]
    kinds = tuple(to_arrow_type(vectors.schema[c].dataType) for c in (id_col, label_col))
    blocks = kept.mapInArrow(_blocks(scale), f"ids array<{id_type(vectors, id_col)}>, labels array<{id_type(vectors, label_col)}>, rows long, data binary")
    blocks = written(blocks, "blocks")
    books = codebooks(blocks, books, rounds, wide) if width else books
    return blocks.mapInArrow(_coder(books, wide, kinds), names), books


def digest(books: Books) -> str:
    """Of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.T.ravel().tolist()).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = coded(table(spark, sf_dir, "embeddings"))
    rows = written(rows, "codes")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("same")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds written out one after another."""
    ctes = [
        "g AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM g, (SELECT unnest(range(0, {parts})) AS p))",
        f"c0 AS MATERIALIZED (SELECT p, e, v AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM g) USING (vec_id) WHERE e < {entries})",
    ]
    for k in range(rounds + 1):
        ctes.append(f"a{k} AS MATERIALIZED (SELECT vec_id, x.p, any_value(v) AS v, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (SELECT vec_id, x.p, v, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN c{k} USING (p)) x GROUP BY vec_id, x.p)")
        if k < rounds:
            ctes.append(f"m{k} AS MATERIALIZED (SELECT p, e, list(floor_ ORDER BY i) AS c FROM (SELECT p, e, i, CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS floor_ FROM (SELECT p, e, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, generate_subscripts(v, 1) AS i, unnest(v) AS y FROM a{k}) GROUP BY p, e, i)) GROUP BY p, e)")
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e))")
    ctes.append(f"o AS MATERIALIZED (SELECT vec_id, label, string_agg(lpad(printf('%x', e), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} JOIN g USING (vec_id) GROUP BY vec_id, label)")
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o, h"


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": _oracle()}
