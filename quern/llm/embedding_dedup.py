"""Embedding near-dedup: cover trees whose nodes are traversed in pairs find all pairs of vectors above a cosine.

1. Equal vectors of one label are one class, known by its number; a class weighs as many rows as it has.
2. The upper levels of the tree are Spark's: where a node holds more classes than one task should, a bounded sample of them gives
   centers, a greedy net whose radius halves from level to level, and each class goes to its nearest one. It is also
   sent, as a guest, to each center before its own below which a class within the threshold may lie: the distance
   to that center is at most the one to its own and twice the threshold, and at most the center's covering radius and the threshold.
   A node that no net can part, as it is too dense, is dealt over blocks, and each block's classes are guests of all blocks before.
3. Below, each task has the cover tree of a node's classes and one of a slice of its guests, and traverses them in pairs (``cover_tree``).
   Tasks send sums of links and the links of a spanning forest, never all pairs; components follow from the forests.

The bounds prune where vectors gather in clusters. Where vectors of a label are spread evenly over many dimensions, all distances are
much alike and no bound on distances prunes, so the time grows with the square of a label's classes; memory of a task does not.

Defined cases: rows whose label or vector is null, whose vector is empty or all zeros or holds a null or a number that is not finite, link with
nothing; vectors of other lengths neither with each other; rows with equal ids are rows of their own; a null id is the largest, and a component
of null ids alone has the id null and keeps them all; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table, written
from quern.llm.cover_tree import SLACK, CoverTree, Links, distances, dual, net
from quern.llm.near_dedup import components

#: Classes of a node in a task; guests for each of them in a slice; centers of a node at most, samples for each center; halvings of the radius.
NODE, GUESTS, CENTERS, SAMPLES, LEVELS = 4096, 2, 64, 4, 5


def unit_vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True, initial=0.0) if len(x) else x
    return x / np.sqrt((x * x).sum(1, keepdims=True))


_MOVED = "grp string, k long, least {0}, n long, vec {1}, member boolean, own string, dist double"


def _mover(radius: float, limit: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Of a node's rows and its sample: each member below its nearest center, and rows as guests below others."""

    def move(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, sample = left, right.sort_by([("place", "ascending")])
        most = sample.column("most")[0].as_py() if len(sample) else 1
        at, x = unit_vectors(sample.column("vec")), unit_vectors(rows.column("vec"))
        centers = at[net(at, radius, most)[0]] if len(at) else at
        if not len(rows) or not len(centers):
            return rows.slice(0, 0).select(["grp", "k", "least", "n", "vec", "member"]).append_column("own", pa.array([], pa.string())).append_column("dist", pa.array([], pa.float64()))
        d = distances(x @ centers.T)
        own = d.argmin(1)
        near = d[np.arange(len(d)), own]
        member = np.asarray(rows.column("member").combine_chunks())
        guest = d <= near[:, None] + 2 * limit + SLACK
        # Of two members the one below the later center is the guest; guests stay guests, also below their nearest center.
        guest &= ~member[:, None] | (np.arange(len(centers)) < own[:, None])
        i, j = np.nonzero(guest)
        take = np.concatenate([np.flatnonzero(member), i])
        cell = np.concatenate([own[member], j])
        out = rows.take(pa.array(take))
        names = np.array([f"{rows.column('grp')[0].as_py()}/{c}" for c in range(len(centers))], object)
        return pa.table(
            [pa.array(names[cell], pa.string()), out.column("k"), out.column("least"), out.column("n"), out.column("vec"), pa.array(np.arange(len(take)) < member.sum()), pa.array([rows.column("grp")[0].as_py()] * len(take), pa.string()), pa.array(np.concatenate([near[member], d[i, j]]))],
            ["grp", "k", "least", "n", "vec", "member", "own", "dist"],
        )

    return move


def _finder(cosine: float, limit: float) -> Callable[[pa.Table], pa.Table]:
    """The links of a node's members with each other, in the first slice, and with a slice of guests: sums by class, and a forest."""

    def find(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("k", "ascending")])
        member = np.asarray(rows.column("member").combine_chunks())
        x, k = unit_vectors(rows.column("vec")), np.asarray(rows.column("k").combine_chunks())
        links = Links(np.asarray(rows.column("n").combine_chunks()))
        own, guests = np.flatnonzero(member), np.flatnonzero(~member)
        tree = CoverTree(x[own], limit / 8)
        if rows.column("slice")[0].as_py() == 0:
            dual(links, tree, None, cosine, own)
        dual(links, tree, CoverTree(x[guests], limit / 8), cosine, own, guests)
        some, forest = np.flatnonzero(links.count), np.flatnonzero(links.root != np.arange(len(k)))
        none = pa.nulls(len(some), pa.int64())
        return pa.table([pa.array(np.concatenate([k[some], k[forest]])), pa.concat_arrays([none, pa.array(k[links.root[forest]])]), pa.array(np.concatenate([links.count[some], np.zeros(len(forest), np.int64)]))], ["a", "b", "n"])

    return find


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp").agg(F.sum(F.col("member").cast("long")).alias("members"), F.sum((~F.col("member")).cast("long")).alias("guests"))


def _parted(rows: DataFrame, node: int, limit: float, types: tuple[str, str]) -> list[DataFrame]:
    """Rows (grp, k, least, n, vec, member) of nodes that one task can take, from upper levels that halve their radius."""
    done, radius = [], 1.0
    for _ in range(LEVELS):
        sizes = written(_sizes(rows), "sizes")  # a row for each node
        if sizes.filter(F.col("members") > node).isEmpty():
            return [*done, rows]
        large = sizes.filter(F.col("members") > node)
        done.append(rows.join(large.select("grp"), "grp", "left_anti"))
        most = F.least(F.lit(CENTERS), F.ceil(2 * F.col("members") / node)).cast("int")
        large = large.select("grp", most.alias("most"), F.ceil((F.col("members") + F.col("guests")) / (4 * node)).cast("int").alias("salts"))
        open_ = rows.join(large, "grp")
        # Each task of a node sees the same sample, of a bounded size; the least hashes are kept by a rank that reaches below the exchange.
        ranked = open_.filter("member").withColumn("place", F.expr("row_number() over (partition by grp order by xxhash64(k), k)")).filter(F.col("place") <= SAMPLES * CENTERS)
        sample = ranked.filter(F.col("place") <= SAMPLES * F.col("most")).select("grp", "place", "vec", "most", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        sample = written(sample, "sample")
        salted = open_.select("grp", "k", "least", "n", "vec", "member", F.pmod(F.xxhash64("k"), F.col("salts")).cast("int").alias("salt"))
        moved = written(salted.groupBy("grp", "salt").cogroup(sample.groupBy("grp", "salt")).applyInArrow(_mover(radius, limit), _MOVED.format(*types)), "moved")
        reach = moved.filter("member").groupBy("grp").agg(F.max("dist").alias("reach"))
        rows = moved.join(reach, "grp").filter(F.col("member") | (F.col("dist") <= F.col("reach") + limit + SLACK)).select("grp", "k", "least", "n", "vec", "member")
        rows, radius = written(rows, "level"), radius / 2
    sizes = written(_sizes(rows), "sizes")
    large = sizes.filter(F.col("members") > node).select("grp", F.ceil(F.col("members") / node).cast("int").alias("blocks"))
    done.append(rows.join(large.select("grp"), "grp", "left_anti"))
    dense = rows.join(large, "grp").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    last = F.when(F.col("member"), F.col("block")).otherwise(F.col("blocks") - 1)
    every = dense.withColumn("to", F.explode(F.sequence(F.lit(0), last)))
    done.append(every.select(F.concat_ws("#", "grp", "to").alias("grp"), "k", "least", "n", "vec", (F.col("member") & (F.col("to") == F.col("block"))).alias("member")))
    return done


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, node: int = NODE) -> DataFrame:
    """vec_id, n_links, component_id, kept. node: classes of one task at most, about."""
    if not 0 < cosine < 1 or node < 2:
        raise ValueError("cosine must lie between 0 and 1, node be at least 2")
    limit = float(distances(np.array(cosine)))
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"))
    fit = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))
    good = F.col("label").isNotNull() & F.coalesce(F.forall("vec", fit) & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = given.withColumn("good", good)
    classes = rows.filter("good").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    # Numbers hold from now on, as they are read from what was written.
    classes = written(classes.withColumn("k", F.monotonically_increasing_id()), "classes")
    types = (dict(classes.dtypes)["least"], dict(classes.dtypes)["vec"])
    placed = classes.select(F.concat_ws("|", F.hex(F.col("label").cast("string")), F.size("vec").cast("string")).alias("grp"), "k", "least", "n", "vec", F.lit(True).alias("member"))
    parts = _parted(placed, node, limit, types)
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    slices = _sizes(nodes).select("grp", F.greatest(F.lit(1), F.ceil(F.col("guests") / (GUESTS * node))).cast("int").alias("slices"))
    every = nodes.join(slices, "grp")
    first = F.when(F.col("member"), F.lit(0)).otherwise(F.pmod(F.xxhash64("k"), F.col("slices")).cast("int"))
    every = every.withColumn("slice", F.explode(F.sequence(first, F.when(F.col("member"), F.col("slices") - 1).otherwise(first)))).select("grp", "slice", "k", "n", "vec", "member")
    found = written(every.groupBy("grp", "slice").applyInArrow(_finder(cosine, limit), "a long, b long, n long"), "found")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("others"))
    roots = written(components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("key", "k"), "roots")
    named = classes.select("k", "least").join(roots, "k").groupBy("root").agg(F.min("least").alias("component"))
    told = classes.join(counts, "k", "left").join(roots.join(named, "root").select("k", "component"), "k", "left")
    told = told.select("label", "vec", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "least").alias("component"), F.lit(True).alias("good"))
    out = rows.join(told, ["label", "vec", "good"], "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.93),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, b FROM r JOIN l ON a = r.c),
m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, e.vec_id = c AS kept FROM embeddings e JOIN m USING (vec_id) LEFT JOIN n ON a = e.vec_id
"""

QUERIES = {"op13_embedding_dedup": op13_embedding_dedup}
ORACLES = {"op13_embedding_dedup": ORACLE}
