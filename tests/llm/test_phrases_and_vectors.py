"""Phrase collocations, vector codes and near vectors against plain versions, on odd inputs and on generated ones."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import collocations, common, cover_tree, embedding_dedup, vector_codes

# Phrase collocations.


def plain_collocations(rows, least=30, percent=80, top=2000, max_n=4):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, max_n + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in found.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                if 100 * a >= percent * f[lang, w[i : i + n]]:
                    gone.add((lang, w[i : i + n]))
    out = {}
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, total[lang], -s) for lang, own in out.items() for k, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1))


def phrase_rows(seed, n=300):
    random.seed(seed)
    words = ["Über", "NEW", "york", "City", "a", "b", "日本", "\x00x", "x" * 70, "'s", *(f"w{k}" for k in range(30))]
    rows = []
    for _ in range(n):
        text = "".join(random.choice(words) + random.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".", "\r\n"]) for _ in range(random.randint(0, 60)))
        if random.random() < 0.5:
            text += random.choice(["new york city hall ", "New York  City, ", "a a a a a a ", "W1 w2 w3 w4 w5 "]) * random.randint(1, 4)
        rows.append((random.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return [*rows, ("en", None), (None, None), ("fr", ""), ("en", "w1 w2 w3 " * 4000), ("de", "q" * 300_000 + " end")]


@pytest.mark.parametrize("seed,max_n,top", [(1, 4, 2000), (2, 3, 5), (3, 2, 2000), (4, 5, 11)])
def test_collocations_equal_plain_counting(spark, monkeypatch, seed, max_n, top):
    rows = phrase_rows(seed)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), max_n=max_n, top=top)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, max_n=max_n, top=top)


def test_collocations_odd_tables(spark):
    rows = [("en", "same old story " * 40), ("en", "same old story " * 40), (None, "same old " * 31)]
    plain = spark.createDataFrame(rows, "lang string, text string")
    clash = spark.createDataFrame([(*r, 1, "p", 2, 3, "w", 4) for r in rows], "lang string, text string, n int, phrase string, f int, cut int, w string, rank int")
    got = sorted(map(tuple, collocations.collocations(plain).collect()))
    assert got == plain_collocations(rows) == sorted(map(tuple, collocations.collocations(clash).collect()))
    assert collocations.collocations(plain.limit(0)).collect() == [] == collocations.collocations(spark.createDataFrame([("en", ". , \n")], "lang string, text string")).collect()
    with pytest.raises(ValueError):
        collocations.collocations(plain, max_n=1)


def test_scores_are_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(2**62, 2**62 + 1, 2**61), (5, 7, 3)], "a long, l long, r long")
    got = row.selectExpr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) AS s").collect()
    assert [r.s for r in got] == [2_000_000 * 2**62 // (2**62 + 1 + 2**61), 1_000_000]


def test_long_texts_are_cut_only_where_a_piece_ends():
    random.seed(4)
    text = "".join(random.choice("ab ,.") for _ in range(5000)) + "z" * 900 + "!" + "tail " * 30
    texts = [text, "", "short", text[:777], "y" * 2000]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    ranges = list(collocations._cuts(data, offsets, 300))
    assert ranges[0][0] == 0 and ranges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    for _, end in ranges:
        assert end in offsets or data[end - 1] in collocations.ENDS
    assert max(b - a for a, b in ranges if data[b - 1] not in b"zy") <= 2000


def test_a_filter_lets_all_its_values_through(spark, monkeypatch):
    keys = [random.Random(5).randrange(-(2**63), 2**63) for _ in range(3000)]
    for bits in (1 << 29, 256):  # also where it is full, as beyond its largest size
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        filter_ = common.Filter.of(spark.createDataFrame([(k,) for k in keys], "k long"))
        assert filter_.has(np.array(keys).view(np.uint64)).all()
        others = np.random.default_rng(6).integers(0, 1 << 63, 3000, dtype=np.uint64)
        assert bits == 256 or filter_.has(others).mean() < 0.02


# Vector codes.


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.floor(np.array([np.float32(v).astype(float) for _, v, _ in kept]) * 1024).astype(np.int64)
    width = x.shape[1] // parts
    books = [x[:entries, p * width : (p + 1) * width].copy() for p in range(parts)]
    for k in range(rounds + 1):
        d = [((x[:, None, p * width : (p + 1) * width] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        codes = [y.argmin(1) for y in d]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = x[codes[p] == e, p * width : (p + 1) * width]
                    if len(own):
                        books[p][e] = [int(s) // len(own) for s in own.sum(0)]
    error = sum(y.min(1) for y in d)
    by = Counter()
    for (_, _, label), e in zip(kept, error.tolist()):
        by[label] += e
    digest = hashlib.sha256(",".join(str(y) for b in books for y in b.ravel().tolist()).encode()).hexdigest()
    return sorted(((i, "".join(f"{c[k]:02x}" for c in codes), int(error[k]), by[label], digest) for k, (i, _, label) in enumerate(kept)), key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


def told(spark, rows, monkeypatch, schema=VECTORS, **how):
    df = spark.createDataFrame(rows, schema).repartition(3)
    monkeypatch.setattr(vector_codes, "table", lambda *_: df)
    if how:
        coded = vector_codes.coded
        monkeypatch.setattr(vector_codes, "coded", lambda d: coded(d, **how))
    return sorted(map(tuple, vector_codes.op12_vector_codes(spark, "").collect()), key=str)


@pytest.mark.parametrize("entries,rounds,size", [(256, 4, 600), (5, 4, 300), (16, 0, 40), (256, 2, 100)])
def test_vector_codes_equal_plain_rounds(spark, monkeypatch, entries, rounds, size):
    random.seed(size)
    rows = [(k, [random.gauss(0, 1) * random.choice([0, 0.001, 1, 60]) for _ in range(8)], random.choice([None, 1, 2])) for k in range(size)]
    rows += [(k, rows[k % 7][1], 3) for k in range(-5, 0)]  # equal vectors, ties between entries
    assert told(spark, rows, monkeypatch, entries=entries, rounds=rounds) == plain_codes(rows, entries=entries, rounds=rounds)


def test_vector_codes_odd_rows(spark, monkeypatch):
    rows = [(1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [math.nan, 0.0, 0.0, 0.0], 1), (4, [math.inf, 0.0, 0.0, 0.0], 2), (5, [-0.0001, 0.5, -0.5, 1.0], None), (5, [0.25, 0.5, -0.5, 1.0], None), (6, [1.0, 2.0], 1), (None, [1.0, 2.0, 3.0, 4.0], 2), (7, [1.0, 2.0, 3.0, 4.0], 2), (7, [1.0, 2.0, 3.0, 4.0], 2)]
    got = told(spark, rows, monkeypatch)
    assert got == plain_codes(rows) and len(got) == 5
    clash = [(*r, 1, "c", 2.0, "d") for r in rows]
    assert told(spark, clash, monkeypatch, VECTORS + ", error long, code string, same double, data string") == got
    assert told(spark, [], monkeypatch) == [] == told(spark, rows[:4], monkeypatch)
    with pytest.raises(ValueError):
        vector_codes.coded(spark.createDataFrame([(1, [1e30] * 4, 1)], VECTORS))
    with pytest.raises(ValueError):
        vector_codes.coded(spark.createDataFrame([(1, [1.0] * 5, 1)], VECTORS))


# Near vectors.


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(seed, n, d):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 20, d))
    return unit(np.repeat(base, 20, 0) + rng.normal(size=(n // 20 * 20, d)) * rng.choice([0.001, 0.05, 0.3, 1.0], size=(n // 20 * 20, 1)))


def plain_links(rows, cosine=0.93):
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = list(range(len(rows))), Counter()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    unit_ = {k: (lambda x: x / np.sqrt(x @ x))(np.array(rows[k][1], np.float32).astype(float)) for k in good}
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and unit_[a] @ unit_[b] >= cosine:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min([x for x in (least.get(find(k)), rows[k][0]) if x is not None], default=None)
    return sorted(((rows[k][0], links[k], least[find(k)], rows[k][0] == least[find(k)]) for k in range(len(rows))), key=str)


@pytest.mark.parametrize("d", [2, 3, 8, 64])
def test_dual_traversal_equals_all_pairs(d):
    x, rng = clustered(d, 1000, d), np.random.default_rng(1)
    weights, limit = rng.integers(1, 5, 1000), float(cover_tree.distances(np.array(0.93)))
    cut = rng.random(1000) < 0.6
    own, guests = np.flatnonzero(cut), np.flatnonzero(~cut)
    links, tree = cover_tree.Links(weights), cover_tree.CoverTree(x[own], limit / 8)
    cover_tree.dual(links, tree, None, 0.93, own)
    cover_tree.dual(links, tree, cover_tree.CoverTree(x[guests], limit / 8), 0.93, own, guests)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    near[np.ix_(guests, guests)] = False
    assert (links.count == near @ weights).all()
    assert (cover_tree.joined(np.arange(1000), *np.nonzero(near)) == links.root).all()


def test_cover_tree_levels_nest_and_cover():
    x = clustered(7, 600, 5)
    tree = cover_tree.CoverTree(x, 0.02)
    for k in range(len(tree.center)):
        members = tree.members(k)
        assert tree.center[k] in members
        assert (cover_tree.distances(x[members] @ x[tree.center[k]]) <= tree.radius[k] + 1e-7).all()
        if tree.children[k]:
            assert sorted(np.concatenate([tree.members(c) for c in tree.children[k]]).tolist()) == sorted(members.tolist())
            assert max(tree.radius[c] for c in tree.children[k]) < tree.radius[k] and tree.center[k] in tree.center[tree.children[k]]


@pytest.mark.parametrize("node", [4096, 60, 7])
def test_near_vectors_equal_all_pairs(spark, node):
    random.seed(node)
    x = [*clustered(1, 300, 6).astype(np.float32).tolist(), *clustered(2, 60, 3).astype(np.float32).tolist()]
    x += [x[0]] * 30 + [[2 * y for y in x[0]]] * 10 + [np.float32(v).tolist() for v in unit(np.array(x[1]) + np.random.default_rng(3).normal(size=(150, 6)) * 0.01)]
    rows = [(k, v, random.choice([1, 1, 1, 2, None])) for k, v in enumerate(x)]
    random.shuffle(rows)
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), node=node)
    assert sorted(map(tuple, got.collect()), key=str) == plain_links(rows)


def test_near_vectors_odd_rows(spark):
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [math.nan, 1.0], 1), (5, [math.inf, 1.0], 1), (6, [], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (8, [1.0, 0.01], 1), (9, [1.0, 0.0], 1), (None, [5.0, 0.1], 1), (None, [0.0, 3.0], 1), (None, [0.0, 3.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [-0.0, 1.0], 2), (12, [0.0, 1.0], 2), (13, [-1.0, 0.0], 1), (14, [1e-40, 0.0], 1)]
    df = spark.createDataFrame(rows, VECTORS)
    want = [(*r[:3], True if r[0] is None and r[2] is None else r[3]) for r in plain_links(rows)]
    got = sorted(map(tuple, embedding_dedup.near_vectors(df).collect()), key=str)
    assert got == want
    clash = spark.createDataFrame([(*r, "g", 1, 2, True, "v") for r in rows], VECTORS + ", grp string, k int, n int, member boolean, vec string")
    assert sorted(map(tuple, embedding_dedup.near_vectors(clash).collect()), key=str) == got
    assert embedding_dedup.near_vectors(df.limit(0)).collect() == []


def test_unit_vectors_of_any_scale():
    x = embedding_dedup.unit_vectors(pa.array([[1e-200, 0.0], [1e200, 1e200], [3.0, 4.0]]))
    assert np.allclose(x, [[1, 0], [math.sqrt(0.5)] * 2, [0.6, 0.8]])
