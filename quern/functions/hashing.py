"""Hash policies as Column functions.

Every sketch takes its hash from a policy: a function from a Column to a non-negative BIGINT below 2^60.
``md5_60`` gives the same values in other SQL engines, ``xxhash64`` is the fast one. Arithmetic on the
hashes stays inside BIGINT, so it is safe in ANSI mode.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 60
HALF = 1 << 30
Policy = str | Callable[[Column], Column]


def md5_60(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")


def md5_60_of(values: list[bytes]) -> np.ndarray:
    """The same of keys' bytes, for tasks that work on arrays."""
    return np.array([int.from_bytes(hashlib.md5(x, usedforsecurity=False).digest()[:8]) >> 4 for x in values], np.int64)


def xxhash64(key: Column) -> Column:
    """60 bits of XXH64. Integers of any width hash alike."""
    return F.xxhash64(key.cast("string")).bitwiseAND(F.lit((1 << BITS) - 1))


def xxh3(key: Column) -> Column:
    """60 bits of XXH3, by Arrow batches, once for each different value of a batch: for values shared with programs that use it. Integers hash as their text."""
    import pandas as pd
    import xxhash

    @F.pandas_udf("bigint")
    def hashed(text: pd.Series) -> pd.Series:
        codes, values = pd.factorize(text)  # -1 for nulls
        hashes = np.array([*(xxhash.xxh3_64_intdigest(x) & (1 << BITS) - 1 for x in values), 0], np.int64)
        return pd.Series(pd.arrays.IntegerArray(hashes[codes], codes < 0))

    return hashed(key.cast("string"))


POLICIES: dict[str, Callable[[Column], Column]] = {"md5_60": md5_60, "xxhash64": xxhash64, "xxh3": xxh3}


def resolve(policy: Policy) -> Callable[[Column], Column]:
    if callable(policy):
        return policy
    if policy not in POLICIES:
        raise ValueError(f"unknown hash policy {policy!r}; known: {', '.join(POLICIES)}")
    return POLICIES[policy]


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def key_hash(key: Column | str, policy: Policy = "xxhash64") -> Column:
    return resolve(policy)(column(key))


def row_hash(key: Column | str, row: Column | int, policy: Policy = "xxhash64") -> Column:
    """Independent hashes of one key, one for each row number."""
    row = F.lit(row) if isinstance(row, int) else row
    if policy == "xxhash64":  # takes several columns without making one text of them
        return F.xxhash64(column(key).cast("string"), row.cast("bigint")).bitwiseAND(F.lit((1 << BITS) - 1))
    return resolve(policy)(F.concat(column(key).cast("string"), F.lit("#"), row.cast("string")))


def lanes(h: Column) -> tuple[Column, Column]:
    """Two 30-bit values of a hash, the second odd, for double hashing: (a + i * b) stays far below 2^63."""
    return h % HALF, F.shiftright(h, 30).bitwiseOR(F.lit(1).cast("bigint"))


def positions(h: Column, k: int, m: int) -> Column:
    """k positions below m, as an array."""
    a, b = lanes(h)
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), lambda i: (a + i * b) % m)
