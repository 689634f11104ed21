"""The whole pipeline against a plain version of all its stages; odd tables; queries against their SQL."""

import math
import re
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
import duckdb
import pytest
from quern.llm import catalog, quality
from quern.llm.encoder import encoder
from quern.llm.packing import LENGTHS
from tests.llm.test_operators import ODD, lower, plain_packing, split

SF = "/root/testdata/sf0.001"


def plain_pipeline(docs, items, model):
    """Ids that each stage keeps, and the counts of tokens of the last ones. docs: doc_id and text by id."""
    score = model.scorer()
    kept = {i: t for i, t in docs.items() if score((t or "").encode()) >= 0.5}
    stages = [set(kept)]
    first = {}
    for i, t in sorted(kept.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    kept = {i: kept[i] for i in first.values()}
    stages.append(set(kept))
    sets = {}
    for i, t in kept.items():
        w = split(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in kept:
        for j in kept:
            if j < i and sets[i] and 100 * (both := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    kept = {i: t for i, t in kept.items() if find(i) == i}
    stages.append(set(kept))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {tuple(v[k : k + 10]) for v in map(words, items) for k in range(max(1, len(v) - 9) if v else 0)}
    lengths = {len(x) for x in windows}

    def clean(t):
        w = words(t)
        return not any(tuple(w[k : k + n]) in windows for n in lengths for k in range(len(w) - n + 1))

    kept = {i: t for i, t in kept.items() if clean(t)}
    stages.append(set(kept))
    return stages, {i: len(encoder().tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept.items()}


def test_pipeline_equals_a_plain_version(spark):
    docs, items, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "benchmark", "labels"))
    model = quality.train(*quality.sample(docs, labels))
    stages, tokens = plain_pipeline({r.doc_id: r.text for r in docs.collect()}, [r.text for r in items.collect()], model)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    own = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], stages):
        own = stage(spark, own, SF).cache()
        assert own.columns == docs.columns and {r.doc_id for r in own.select("doc_id").collect()} == want
    got, bins = defaultdict(int), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.n_tokens
        bins[r.bin_id, r.bin_length].append((r.bin_offset, r.n_tokens))
    assert got == tokens
    sizes = sorted((n for own in bins.values() for _, n in own), reverse=True)
    assert sorted((length, tuple(sorted(own))) for (_, length), own in bins.items()) == plain_packing(sizes, LENGTHS)


@pytest.mark.parametrize("kind", ["odd", "empty", "all null"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    schema = "doc_id long, text string, row string, h long, place int, key binary, b int, th long, n long, label int"
    rows = [] if kind == "empty" else [(i, t if kind == "odd" else None, "r", i, 1, b"k", 2, 3, 4, None) for i, t in ODD]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if kind == "empty" else [(i, i % 2, 0) for i in range(10)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([] if kind == "empty" else [(1, "two words"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), corpus_pipeline.run(spark, str(tmp_path)).collect()
    own = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, own, str(tmp_path))
        assert own.schema == docs.schema, name
    assert sorted(map(str, {r.doc_id for r in out})) == sorted(map(str, {r.doc_id for r in own.collect()}))
    assert all(math.isfinite(r.n_tokens) and r.n_tokens >= 1 for r in out) and (out == [] if kind == "empty" else True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall())


def test_every_operator_has_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in catalog.QUERIES)
    assert numbers == list(range(1, 11)) and set(catalog.ORACLES) <= set(catalog.QUERIES)
