"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept and works on all of it. Defined cases, for every stage: columns besides
doc_id and text are passed on as they are, whatever their names; a null text is the empty text; rows may repeat, and
ids may be null or shared; an empty table gives an empty result with the same columns. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import collected, made, released, table, written
from quern.llm.decontaminate import drop_contaminated
from quern.llm.exact_dedup import drop_exact_duplicates
from quern.llm.near_dedup import drop_near_duplicates
from quern.llm.packing import best_fit
from quern.llm.quality import drop_low_quality, sample, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression classifier scores 0.5 or more; it learns from labels of rows that are not held out.

    Without labels, and without text, the score is that of the classifier's docstring; labels of unknown ids teach nothing.
    """
    model = train(*sample(docs, table(spark, sf_dir, "labels")))
    collected(spark)  # the sample and what training took
    return drop_low_quality(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for white space the one with the least id; null texts equal empty ones, a null id is the largest."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the least id, of each group that links of 0.8 or more on five-word shingles hold together; texts without words stay."""
    return drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs; texts without words stay, items without words match nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each part of each document lies in the training sequences; an empty text takes its end token alone."""
    return best_fit(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminated), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is written as Parquet and read again by the next, and the stage's own working tables go."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = made()
        docs = written(stage(spark, docs, sf_dir), name)
        released(before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
