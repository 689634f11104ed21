"""Sketch states as tables: saved as Parquet with their kind and parameters, and checked when loaded."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


class StateError(ValueError):
    """A saved state is not what was asked for."""


def save(state: DataFrame, path: str, kind: str, params: dict, mode: str = "errorifexists") -> None:
    state.withColumn("_sketch", F.lit(json.dumps({"kind": kind, "version": VERSION, "params": params}, sort_keys=True))).write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str, kind: str, params: dict | None = None) -> DataFrame:
    """The state; raises StateError if it is of another kind, version or, where given, other parameters."""
    df = spark.read.parquet(path)
    if "_sketch" not in df.columns:
        raise StateError(f"{path} holds no sketch state")
    for row in df.select("_sketch").distinct().limit(2).collect():
        head = json.loads(row["_sketch"])
        if head["kind"] != kind or head["version"] != VERSION or (params is not None and head["params"] != json.loads(json.dumps(params))):
            raise StateError(f"{path} holds {head}, not {kind} {params or ''}")
    return df.drop("_sketch")
