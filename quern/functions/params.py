"""A sketch's parameters travel with its state, in the metadata of one of its columns, so that merges can compare them.

Metadata stays with a column through selections, filters, grouping, unions and Parquet. A state whose column has none,
such as one made by hand, merges with any.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame


class MismatchError(ValueError):
    """States of different parameters, whose merge would mean nothing."""


def tagged(column: Column, name: str, sketch: Any) -> Column:
    """The column under this name, with the sketch's kind and parameters."""
    return column.alias(name, metadata={"quern": of(sketch)})


def untagged(column: Column, name: str) -> Column:
    """The column without parameters."""
    return column.alias(name, metadata={"quern_none": True})


def of(sketch: Any) -> str:
    """Kind and parameters of a sketch, which is a frozen dataclass."""
    return repr(sketch)


def held(state: DataFrame, column: str) -> str | None:
    return state.schema[column].metadata.get("quern") if column in state.columns else None


def same(states: list[DataFrame] | tuple[DataFrame, ...], column: str, sketch: Any = None) -> None:
    """Raises MismatchError where states, or a state and the sketch, differ in kind or parameters."""
    known = {p for s in states if (p := held(s, column))} | ({of(sketch)} if sketch is not None else set())
    if len(known) > 1:
        raise MismatchError(f"states differ: {', '.join(sorted(known))}")
