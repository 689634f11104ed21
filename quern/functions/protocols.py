"""What sketches have in common, for type checkers and for code that takes any of them."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Sketch(Protocol):
    """A specification that turns rows into a state; states of one specification merge."""

    def state(self, df: DataFrame, *args: Any, **kwargs: Any) -> DataFrame: ...


@runtime_checkable
class MergeableSketch(Sketch, Protocol):
    def merge(self, *states: Any) -> DataFrame: ...
