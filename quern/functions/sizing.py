"""Sizes of sketches from what they must hold, and a recommendation under a memory budget.

``python -m quern.functions.sizing --structure bloom --n 1000000`` prints one structure's parameters as JSON.
"""

from __future__ import annotations

import argparse
import json
import math
import sys
from dataclasses import asdict, dataclass


def power_of_two(n: float) -> int:
    """The least power of two that is not below n."""
    return 1 << max(0, math.ceil(n) - 1).bit_length()


def _round(x: float) -> int:
    return math.floor(x + 0.5)


def _positive(**values: float) -> None:
    for name, x in values.items():
        if not x > 0:
            raise ValueError(f"{name} must be positive")


def _rate(**values: float) -> None:
    for name, x in values.items():
        if not 0 < x < 1:
            raise ValueError(f"{name} must lie between 0 and 1")


@dataclass(frozen=True)
class BloomParams:
    m: int
    k: int
    memory_bytes: int


@dataclass(frozen=True)
class CuckooParams:
    capacity: int
    bucket_size: int
    fingerprint_bits: int
    memory_bytes: int


@dataclass(frozen=True)
class HllParams:
    precision: int
    memory_bytes: int


@dataclass(frozen=True)
class CmsParams:
    epsilon: float
    delta: float
    width: int
    depth: int
    memory_bytes: int


@dataclass(frozen=True)
class BlockedParams:
    blocks: int
    k: int
    memory_bytes: int


@dataclass(frozen=True)
class Recommendation:
    structure: str
    memory_bytes: int
    fpr: float


def bloom_params(n: int, fpr: float = 0.01) -> BloomParams:
    _positive(n=n)
    _rate(fpr=fpr)
    m = power_of_two(max(64, -n * math.log(fpr) / math.log(2) ** 2))
    return BloomParams(m, max(1, _round(m / n * math.log(2))), m // 8)


def blocked_bloom_params(n: int, fpr: float = 0.01) -> BlockedParams:
    """Blocks of 512 bits; the number of hashes fits the keys of a block."""
    _positive(n=n)
    _rate(fpr=fpr)
    blocks = power_of_two(max(1, -n * math.log(fpr) / math.log(2) ** 2 / 512))
    return BlockedParams(blocks, min(30, max(1, _round(512 / (n / blocks) * math.log(2)))), blocks * 64)


def cuckoo_params(n: int, fpr: float = 0.01) -> CuckooParams:
    _positive(n=n)
    _rate(fpr=fpr)
    bits = min(8, max(1, math.ceil(math.log2(8 / fpr))))
    buckets = power_of_two(max(2, -(-n // 4)))
    return CuckooParams(4 * buckets, 4, bits, 4 * buckets)


def hll_params(error: float) -> HllParams:
    _rate(error=error)
    p = min(16, max(4, math.ceil(2 * math.log2(1.04 / error))))
    return HllParams(p, 1 << p)


def cms_params(epsilon: float, delta: float) -> CmsParams:
    _rate(epsilon=epsilon, delta=delta)
    width, depth = power_of_two(max(2, math.ceil(math.e / epsilon))), max(1, math.ceil(math.log(1 / delta)))
    return CmsParams(epsilon, delta, width, depth, 8 * width * depth)


def quotient_params(n: int, fpr: float = 0.01) -> dict:
    _positive(n=n)
    _rate(fpr=fpr)
    slots, r = power_of_two(math.ceil(n / 0.75)), math.ceil(-math.log2(fpr))
    return {"quotient_bits": slots.bit_length() - 1, "slots": slots, "remainder_bits": r, "slot_bits": r + 3, "memory_bytes": slots * (r + 3) // 8}


def fuse_params(n: int) -> dict:
    """Segment length and slots of a binary fuse filter with three hashes and 8-bit fingerprints."""
    _positive(n=n)
    length = min(1 << 18, 1 << max(0, math.floor(math.log(n) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)) if n > 1 else 0
    count = max(1, -(-_round(n * factor) // length) - 2)
    return {"segment_length": length, "segments": count, "slots": (count + 2) * length, "memory_bytes": (count + 2) * length}


def heavy_keeper_params(d: int = 4, w: int = 1024, k: int = 100) -> dict:
    _positive(d=d, w=w, k=k)
    return {"depth": d, "width": w, "top_k": k, "table_bytes": 8 * d * w, "summary_bytes": 128 * k, "memory_bytes": 8 * d * w + 128 * k}


def dd_params(alpha: float = 0.01) -> dict:
    """Buckets for values that span five decades."""
    _rate(alpha=alpha)
    gamma = (1 + alpha) / (1 - alpha)
    buckets = math.ceil(math.log(1e5) / math.log(gamma))
    return {"gamma": gamma, "buckets": buckets, "memory_bytes": 8 * buckets + 64}


def candidates(n: int, fpr: float) -> list[Recommendation]:
    bloom, cuckoo = bloom_params(n, fpr), cuckoo_params(n, fpr)
    return [
        Recommendation("BloomFilter", bloom.memory_bytes, fpr),
        Recommendation("CuckooFilter", cuckoo.memory_bytes, 8 / (1 << cuckoo.fingerprint_bits)),
        Recommendation("XorFilter", 3 * max(32, power_of_two(math.ceil(0.41 * n))), 1 / 256),
        Recommendation("RibbonFilter", power_of_two(math.ceil(1.08 * n)), 1 / 256),
    ]


def recommend(n: int, fpr: float, budget_bytes: int) -> Recommendation:
    """Of the filters that fit the budget the one with the fewest false positives, then the smallest; else the smallest."""
    every = candidates(n, fpr)
    fitting = [c for c in every if c.memory_bytes <= budget_bytes]
    if not fitting:
        return min(every, key=lambda c: c.memory_bytes)
    return min(fitting, key=lambda c: (round(c.fpr, 9), c.memory_bytes))


def _within(structure: str, budget: int, a: argparse.Namespace) -> dict:
    """What fits into a budget."""
    if structure in ("bloom", "blocked_bloom", "counting_bloom"):
        cells = 1 << max(0, (budget * (1 if structure == "counting_bloom" else 8)).bit_length() - 1)
        return {"cells": cells, "n": int(cells * math.log(2) ** 2 / -math.log(a.fpr))}
    if structure == "hll":
        p = min(16, max(4, budget.bit_length() - 1))
        return {"precision": p, "error": 1.04 / math.sqrt(1 << p)}
    if structure == "binary_fuse8":
        return {"n": int(budget / 1.125)}
    if structure == "heavy_keeper":
        left = budget - 128 * a.k
        return {"width": left // (8 * a.d)} if left > 0 else {"needed_bytes": 128 * a.k}
    if structure == "dd_sketch":
        buckets = max(0, budget - 64) // 8
        gamma = (1 + a.error) / (1 - a.error)
        return {"buckets": buckets, "range": math.exp(min(700.0, buckets * math.log(gamma)))}
    if structure == "cuckoo":
        return {"n": int((1 << max(1, budget.bit_length() - 1)) * 0.955)}
    return {}


STRUCTURES = ("bloom", "cuckoo", "hll", "cms", "counting_bloom", "blocked_bloom", "quotient", "binary_fuse8", "heavy_keeper", "dd_sketch")


def describe(structure: str, a: argparse.Namespace) -> dict:
    """Parameters and memory of one structure."""
    if structure in ("bloom", "cuckoo", "counting_bloom", "blocked_bloom", "quotient", "binary_fuse8") and not (a.n and a.n > 0):
        raise ValueError("--n, the expected number of keys, must be positive")
    if structure == "bloom":
        p = bloom_params(a.n, a.fpr)
        return asdict(p) | {"expected_fpr": (1 - math.exp(-p.k * a.n / p.m)) ** p.k}
    if structure == "counting_bloom":
        return asdict(p := bloom_params(a.n, a.fpr)) | {"memory_bytes": p.m}
    if structure == "blocked_bloom":
        return asdict(blocked_bloom_params(a.n, a.fpr))
    if structure == "cuckoo":
        return asdict(cuckoo_params(a.n, a.fpr))
    if structure == "hll":
        return asdict(p := hll_params(a.error)) | {"error": 1.04 / math.sqrt(1 << p.precision)}
    if structure == "cms":
        return asdict(cms_params(a.error, 1 - a.confidence))
    if structure == "quotient":
        return quotient_params(a.n, a.fpr)
    if structure == "binary_fuse8":
        return fuse_params(a.n)
    if structure == "heavy_keeper":
        return heavy_keeper_params(a.d, a.w, a.k)
    return dd_params(a.error)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sizing", description=__doc__)
    p.add_argument("--structure", required=True, choices=STRUCTURES)
    for name, kind, default in (("n", int, None), ("fpr", float, 0.01), ("error", float, 0.01), ("confidence", float, 0.99), ("memory", int, None), ("d", int, 4), ("w", int, 1024), ("k", int, 100)):
        p.add_argument(f"--{name}", type=kind, default=default)
    a = p.parse_args(args)
    try:
        out = {"structure": a.structure} | describe(a.structure, a)
        if a.memory:
            out["within_budget"] = _within(a.structure, a.memory, a)
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    print(json.dumps(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
