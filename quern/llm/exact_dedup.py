"""Exact dedup by content sort, with DataFrame functions only.

White space is normalised, sampled splitters range-partition the normalised texts by content, an external sort
places equal texts next to each other, and a window that compares neighbouring texts in full keeps the smallest
identifier of each run. Splitters are the first ``PREFIX`` characters of texts, so that they are small; where many
texts begin alike, a hash of the whole text parts them, so that no opening, however common, makes a range too large.
Within a range the order is that of the texts. A text with so many copies that one range would be too large is
dealt over several slices of it; slices of such texts are few, and their heads meet in a last small step.

Texts are moved once and sorted once.

Defined cases: null text is the empty text, a null id ranks after all others, of rows that agree in
text and id one stays, an empty table gives an empty result, texts of any length are compared in full; other columns
are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import table, written

#: A text with more copies than this, and than one in LEAST_SHARE of all rows, is dealt over slices.
LEAST_COPIES, LEAST_SHARE = 1_000, 100_000
#: Characters of a text that take part in the splitters.
PREFIX = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _runs(docs: DataFrame, id_col: str, text_col: str, limit: int | None, whole_rows: bool = False) -> DataFrame:
    """A row per document, sorted by text: doc_id, norm, h, slices (null but for very frequent texts), place in its run, keep_id and size of the run.

    whole_rows: with the row itself, which then is all that is moved; its text is normalised anew behind the exchange.
    """
    limit = limit or max(LEAST_COPIES, docs.count() // LEAST_SHARE)
    norm = normalised(F.col(text_col))
    # At most one row for each limit rows of the table: small enough to send to all executors.
    frequent = docs.select(F.xxhash64(norm).alias("h")).groupBy("h").count().filter(F.col("count") > limit)
    frequent = frequent.select("h", F.ceil(F.col("count") / limit).alias("slices"))
    given = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"), *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if whole_rows else []))
    rows = given.withColumn("h", F.xxhash64("norm")).withColumn("prefix", F.substring("norm", 1, PREFIX)).join(F.broadcast(frequent), "h", "left")
    # The number of the input partition parts rows that agree in id and text as well, and is the same if a task runs again.
    rows = rows.withColumn("slice", F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("slices"))))
    # Ranges are decided by columns that follow from those that the window groups by, so it needs no further exchange.
    ranged = (rows.drop("norm") if whole_rows else rows).repartitionByRange("prefix", "h", "slice")
    if whole_rows:
        ranged = ranged.withColumn("norm", normalised(F.col("row")[text_col]))
    run = Window.partitionBy("prefix", "norm", "h", "slice")
    return (
        ranged.withColumn("place", F.row_number().over(run.orderBy(F.col("doc_id").asc_nulls_last())))
        .withColumn("keep_id", F.min("doc_id").over(run))
        .withColumn("size", F.count(F.lit(1)).over(run))
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), for every row."""
    runs = _runs(docs, id_col, text_col, limit).select("doc_id", "slices", "place", "keep_id", "size", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    runs = written(runs, "runs")
    heads = runs.filter(F.col("slices").isNotNull() & (F.col("place") == 1))
    whole = heads.groupBy("text_sha256").agg(F.min("keep_id").alias("all_keep"), F.sum("size").alias("all_size"))
    # A row for each very frequent text: bounded as above.
    out = runs.join(F.broadcast(whole), "text_sha256", "left")
    out = out.withColumn("keep_id", F.coalesce("all_keep", "keep_id")).withColumn("size", F.coalesce("all_size", "size"))
    return out.select("doc_id", "keep_id", F.col("size").cast("long").alias("group_size"), ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that stay.

    Heads of runs are written with their rows; of a sliced text all heads but one are then left out, by their places
    among the few heads of such texts. So texts are sorted and moved once.
    """
    heads = _runs(docs, id_col, text_col, limit, whole_rows=True).filter("place = 1")
    sliced = F.col("slices").isNotNull()
    sha = F.when(sliced, F.sha2(F.col("norm").cast("binary"), 256)).alias("text_sha256")
    heads = written(heads.select("row", sha, F.when(sliced, F.col("keep_id")).alias("keep_id"), F.when(sliced, F.col("slice")).alias("slice")), "heads")
    order = F.struct(F.col("keep_id").isNull().alias("none"), "keep_id", "slice")
    first = heads.filter("text_sha256 IS NOT NULL").groupBy("text_sha256").agg(F.min(order).alias("first"))
    out = heads.join(F.broadcast(first), "text_sha256", "left").filter(F.col("text_sha256").isNull() | (F.col("first") == order))
    return out.select("row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm)::BIGINT AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""

QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {"op4_exact_dedup": ORACLE}
