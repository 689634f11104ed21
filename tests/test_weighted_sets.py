"""Weighted similarity by blocks against plain sums, and what it may shuffle."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quern.operators import similarity, weighted_sets
from quern.operators.similarity import WeightedMinHash


def _random_rows(text: bool = False):
    random.seed(5)
    rows = [(s, random.randrange(30), float(random.randint(1, 9))) for s in range(24) for _ in range(random.randint(1, 25))]
    rows += [(4, 1, None), (5, None, 3.0), (8, 2, 0.0), (None, 3, 4.0), (7, 900, None), (20, 900, 2.0)] + [(40, 1000 + i, 2.0) for i in range(300)] + [(41, 1000 + i, 1.0) for i in range(300)]
    return [(s, None if i is None else f"i{i}" if text else i, w) for s, i, w in rows]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_weighted_search_equals_plain_sums(spark, kind):
    rows = _random_rows(kind == "string")
    df, sketch = spark.createDataFrame(rows, f"s long, i {kind}, w double"), WeightedMinHash(64)
    got = {(r.a, r.b): (r.jaccard, r.exact) for r in weighted_sets.weighted_search(df, "s % 4 = 0", "s", "i", "w", sketch).collect()}
    sums, whole = {}, {}
    for s, i, w in rows:
        whole[s] = whole.get(s, 0) + (w or 0)
        if i is not None:
            x = sums.setdefault(s, {})
            x[i] = w if x.get(i) is None else x[i] + (w or 0)
    sets = [s for s in whole if s is not None]
    least = lambda x, y: (x if y is None else y if x is None else min(x, y)) or 0
    exact = {(a, b): sum(least(w, sums[b][i]) for i, w in sums[a].items() if i in sums[b]) for a in sets if a % 4 == 0 for b in sets if a != b}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({(a, b): m / (whole[a] + whole[b] - m) for (a, b), m in exact.items()})
    pairs = spark.createDataFrame(list(got), "a long, b long")
    assert {k: v[0] for k, v in got.items()} == {(r.a, r.b): r.jaccard for r in sketch.jaccard(sketch.state(df, "s", "i", "w"), pairs, "s").collect()}


def test_neither_samples_nor_pairs_are_shuffled(spark):
    from quern.plans import catalog

    df = catalog.QUERIES["weighted_minhash_jaccard"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not any(x in plan for x in ("Generate", "Join", "CoGroup"))


def test_sets_and_meetings_in_small_pieces(monkeypatch):
    random.seed(6)
    rows = [(s, i, i * 77, float(random.randint(1, 5))) for s in range(9) for i in sorted(random.sample(range(40), 12))]

    def batches(n):
        return [pa.RecordBatch.from_pylist([dict(zip(("set", "i", "h", "w"), r)) for r in rows[lo : lo + n]]) for lo in range(0, len(rows), n)]

    def all_sets(n):
        parts = list(weighted_sets._signed(iter(batches(n)), 16))
        return len(parts), [x for p in parts for x in p[0].to_pylist()], *(np.concatenate([p[c] for p in parts]).tolist() for c in (1, 2, 3, 4)), [int(x) for p in parts for x in np.diff(p[5])]

    whole = all_sets(len(rows))
    monkeypatch.setattr(weighted_sets, "CHUNK_ITEMS", 20)
    monkeypatch.setattr(weighted_sets, "DRAWN", 5)
    pieces = all_sets(7)
    assert whole[0] == 1 and pieces[0] == 5 and whole[1:] == pieces[1:]
    monkeypatch.setattr(similarity, "BLOCK", 1)
    assert all_sets(5)[0] == 9

    q, v, w = np.repeat([0, 1], 3), np.array([1, 2, 3, 2, 3, 4]), np.array([1.0, 2, 3, 4, 5, 6])
    o, i, t = np.array([0, 0, 1, 2]), np.array([2, 3, 4, 9]), np.array([1.0, 9, 2, 1])
    want = [[4.0, 0, 0], [6.0, 2, 0]]
    assert weighted_sets.shared(q, v, w, o, i, t, (2, 3)).tolist() == want
    monkeypatch.setattr(weighted_sets, "MEETINGS", 1)
    assert weighted_sets.shared(q, v, w, o, i, t, (2, 3)).tolist() == want
