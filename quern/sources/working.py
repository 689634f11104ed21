"""Working tables in the folder that all executors share. They are deleted at exit, or before that where asked."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset the context's checkpoint folder, on a cluster the warehouse, else a folder of this session's own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            return given.get()
        if spark.sparkContext.master.split("[")[0] == "local":
            base = f"file://{tempfile.mkdtemp(prefix='quern-')}"
            spark.sparkContext.setCheckpointDir(base)
        else:  # a folder of one machine would not do
            base = spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    where = f"{shared_dir(spark)}/quern/{uuid.uuid4().hex}/{name}"
    if not _MADE:
        atexit.register(release)
    _MADE.append((spark, where))
    return where


def made() -> int:
    """How many working tables there are."""
    return len(_MADE)


def released(since: int, keep: int = 0) -> None:
    """Deletes the working tables made after the first ``since`` ones, but for the last ``keep``; results that still read them must be written before."""
    gone = _MADE[since : len(_MADE) - keep]
    del _MADE[since : len(_MADE) - keep]
    for spark, where in gone:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where).getParent()
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def release() -> None:
    """Deletes all working tables written so far, as happens at exit; a long session may call it between results."""
    try:
        released(0)
    except Exception:  # the session has ended; its folder goes with the cluster's own clean-up
        _MADE.clear()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back, so all who read it see the same rows and a lost executor costs no recomputation."""
    where = path(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
