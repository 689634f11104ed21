"""Near duplicates from bottom-k sketches of one hash function.

A document's set is its distinct word shingles as 64-bit values; its sketch is the k least of them. Equal
sets are one class and stand for all their documents. Classes meet in inverted lists of retained values:

* Two sets as similar as asked share at least m of their k retained values, but for a chance of RISK at the very
  threshold and ever less above it: m is that quantile of the binomial distribution. Where a sketch holds its whole
  set, and that of any set similar to it, m is exact. So it is enough to list, of each sketch, its k - m + 1 values
  that are rarest in the table: the rarest shared value is among them for both. Values that no other sketch has come
  first and need no list, which leaves out every document that is unlike all others and every value that is frequent in the corpus.
* In each list one class, the one whose values are most frequent and so most likely the text that the
  others are copies of, is the hub, and all others are compared with it: one pair for each place in a list.
  Classes that are in its component then are done with each other.
* For each x that is not, and each other y of the same hub, what they share is at most the lesser share with
  the hub, min(|x & hub|, |y & hub|), and the values outside the hub that both have. So y matters only if x and y
  share values outside the hub: inverted lists of these, again only the rarest of each class, find such pairs; or
  if that lesser share may be enough by itself: the few classes for which it may be meet in inverted lists of their
  retained values, ranked among themselves. Copies of one text with changes of their own share no values outside it, and pairs
  within a component are never formed, so a large group of copies never expands into its pairs.
* Such a list may still hold many classes apart from each other, as when copies that are too different have one changed line in
  common. x and y differ by exactly the values in which their differences from the hub differ, so each class keeps its difference
  as BITS parities: bits that two classes have different are at most as many as the values they differ by. A pair with more of them than
  the threshold allows is no link and never leaves the join of its list. This is a bound, not an estimate: no link is lost.
* The sketch of the union of two sets estimates their similarity; pairs that may reach the threshold are compared on
  their full sets. A pair of class and hub is estimated first where the hub has no other class; where it has others, the
  full comparison also gives the shares by which those are ruled out. Links become components by alternating large and small stars.

All classes of one hub are dealt over slices of at most about SLICE rows, and so are the rows of a list, so that neither is one task's work.
Classes are known by 128 bits of their sets, so that different sets do not meet by chance on any corpus.

Nothing but ids of a counted, bounded number goes to the driver or to all executors.

Defined cases: null text, empty text or text without words has an empty set and is linked with nothing;
with fewer words than a shingle the whole sequence is the one shingle; rows with equal ids are judged by
their own texts; a null id counts as larger than any other; an empty table gives an empty result; other
columns are never looked at; texts of any length are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import LOWER, buffer, collected, id_and_text, id_type, lean, ngrams, pieces, table, text_pieces, word_hashes, words, written

#: Retained values; the chance that a pair at the threshold shares fewer of them than is asked for.
K, RISK = 48, 2e-6
#: Rows of a hub, or of a hub's list, in one task, about; the larger ones' names are sent to all executors, GROUPS rows at most.
SLICE, GROUPS = 200, 100_000
#: Parities of a class's difference from its hub; two classes that differ by many more values than these are left to the estimate.
BITS = 1024
#: So many ids at most are sent to all executors; beyond that their texts are found by a shuffle.
SENT = 200_000


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of the runs of n words, ascending."""
    return np.unique(ngrams(hashes, min(n, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def _key(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def needs(k: int, percent: int) -> list[int]:
    """For each size of a sketch how many of its values a set as similar as asked shares at least."""
    t, out = percent / 100, []
    for n in range(k + 1):
        if 100 * n <= k * percent:  # it holds its set, and so does that of a similar one
            out.append(-(-percent * n // 100))
            continue
        below, m = 0.0, 0
        while (below := below + math.comb(n, m) * t**m * (1 - t) ** (n - m)) <= RISK:
            m += 1
        out.append(m)
    return out


def _sketcher(n: int, k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sketches = [], [], []
            for _, data, starts, ends, begins in text_pieces(batch, LOWER):
                h = word_hashes(data, starts, ends, LOWER)
                for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
                    values = shingle_set(h[a:b], n)
                    sizes.append(len(values))
                    keys.append(_key(values) if len(values) else None)
                    sketches.append(values[:k])
            offsets = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
            flat = np.concatenate([*sketches, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "th", "n", "key", "sketch"],
            )

    return sketch


def _need(size, k: int, percent: int):
    """Values that two sketches of about this size share at least."""
    return F.get(F.array(*map(F.lit, needs(k, percent))), size)


def _rarest(rows: DataFrame, owner: list[str], take) -> DataFrame:
    """Of rows (owner, size, v) those of each owner's rarest values; rows of values that only one owner of the same list has count, but go.

    take: from size to how many of the values, the rarest first, are listed.
    """
    scope = owner[:-1]
    shared = rows.groupBy(*scope, "v").count().filter("count > 1")
    held = rows.join(shared, [*scope, "v"]).groupBy(*owner).agg(F.first("size").alias("size"), F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("count", "v"))).alias("vs"))
    left = (take - (F.col("size") - F.size("vs"))).cast("int")
    heavy = F.aggregate("vs", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    return held.filter(left > 0).select(*owner, heavy.alias("heavy"), F.size("vs").alias("common"), F.explode(F.slice("vs", F.lit(1), left)).alias("x")).select("x.v", *owner, "heavy", "common")


def _lists(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """v, key, heavy, common: the rarest values of each sketch that other sketches have too."""
    places = classes.select("key", F.size("sketch").alias("size"), _need(F.size("sketch"), k, percent).alias("need"), F.explode("sketch").alias("v"))
    return _rarest(places, ["key"], F.col("size") - F.col("need") + 1)


def _apart(pairs: DataFrame) -> DataFrame:
    """a < b, each pair once."""
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _estimator(k: int, percent: int):
    least = needs(k, percent)[k]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = []
            for x, y in zip(batch.column("sketch_a"), batch.column("sketch_b")):
                x, y = (np.asarray(s.values).view(np.uint64) for s in (x, y))
                union = np.union1d(x, y)[:k]
                both = np.intersect1d(x, y, assume_unique=True)
                need = least if len(union) == k else -(-percent * len(union) // 100)  # a shorter one is the union itself
                take.append(np.isin(both, union, assume_unique=True).sum() >= need)
            batch = batch.filter(pa.array(take, pa.bool_()))
            yield batch.select(["a", "b"])

    return keep


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that may be as similar as asked, by the sketches of their unions."""
    sketch = lambda x: classes.select(F.col("key").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "sketch_a", "sketch_b")
    return both.mapInArrow(lean(_estimator(k, percent)), "a binary, b binary")


class _Dealt:
    """Deals the rows of large groups, by the columns ``on``, over slices."""

    def __init__(self, rows: DataFrame, *on: str):
        self.rows, self.on = rows.count(), list(on)
        limit = max(SLICE, self.rows // GROUPS)
        # Written, so that the plans of its many uses only read it.
        self.large = written(rows.groupBy(*on).count().filter(F.col("count") > limit).select(*on, F.ceil(F.col("count") / limit).alias("_n")), "large_groups")

    def dealt(self, rows: DataFrame, by: str) -> DataFrame:
        out = rows.join(F.broadcast(self.large), self.on, "left")
        return out.withColumn("_s", F.coalesce(F.pmod(F.xxhash64(by), F.col("_n")), F.lit(0))).drop("_n")

    def in_each_slice(self, rows: DataFrame) -> DataFrame:
        """rows, few for each group, once for each slice."""
        out = rows.join(F.broadcast(self.large), self.on, "left")
        return out.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_n"), F.lit(1)) - 1))).drop("_n")

    def join(self, rows: DataFrame, groups: DataFrame, by: str = "key") -> DataFrame:
        return self.dealt(rows, by).join(self.in_each_slice(groups), [*self.on, "_s"]).drop("_s")


def parities(values: np.ndarray) -> np.ndarray:
    """BITS / 64 words whose bits say which remainders an odd number of the values has."""
    odd = np.bincount((values % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _differ(percent: int) -> str:
    """Whether the parities of two rows, the other's columns named _y, leave room for a link: of two sets, and of their differences from a third, the symmetric difference is the same."""
    bits = " + ".join(f"bit_count(get(odd, {i}) ^ get(odd_y, {i}))" for i in range(BITS // 64))
    return f"{100 + percent} * ({bits}) <= {100 - percent} * (size + size_y)"


def _compared(n: int):
    """Full comparison: sizes, shared values, the values of a that b has not, and parities of those that only one has."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))

        def sets(column: pa.Array):
            data, offsets = buffer(column)
            for lo, hi in pieces(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, begins = words(part, at, LOWER)
                h = word_hashes(part, starts, ends, LOWER)
                for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
                    yield shingle_set(h[a:b], n)

        for batch in batches:
            a, b, text_b = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_b")
            right, rows, outside, odd = [], [], [], []
            for i, x in enumerate(sets(batch.column("text_a"))):
                if b[i] != last[0]:
                    last = (b[i], next(sets(text_b.slice(i, 1))))
                y = last[1]
                only = np.setdiff1d(x, y, assume_unique=True)
                # A text that only shares its id with the class is not the class.
                right.append(_key(x) == a[i] and _key(y) == b[i])
                rows.append((len(x), len(y), len(x) - len(only)))
                outside.append(only)
                odd.append(parities(np.concatenate([only, np.setdiff1d(y, x, assume_unique=True)])))
            offsets = np.cumsum([0, *map(len, outside)]).astype(np.int32)
            flat = np.concatenate([*outside, np.zeros(0, np.uint64)]).view(np.int64)
            na, nb, both = (pa.array([r[k] for r in rows], pa.int64()) for k in range(3))
            every = pa.array(np.arange(len(odd) + 1, dtype=np.int32) * (BITS // 64))
            odd = pa.ListArray.from_arrays(every, pa.array(np.concatenate([*odd, np.zeros(0, np.int64)])))
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), na, nb, both, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), odd], ["a", "b", "na", "nb", "both", "outside", "odd"])
            yield out.filter(pa.array(right, pa.bool_()))

    return compare


def _comparison(pairs: DataFrame, classes: DataFrame, given: DataFrame, n: int) -> DataFrame:
    """a, b, na, nb, both, outside, odd for pairs a, b of keys. A text goes with each pair only on the side of a."""
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(classes.select("key", "rep"), "key").select("key", F.col("rep").alias("doc_id"))
    hubs = _Dealt(pairs, "b")
    few = 2 * hubs.rows <= SENT
    ends = F.broadcast(ends) if few else ends
    texts = given.join(ends, given["doc_id"].eqNullSafe(ends["doc_id"])).select("key", "text")
    if few:
        texts = written(texts, "texts")
    text = lambda x: texts.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}"))
    # Rows of one hub come one after another, so its set is made once for each slice.
    both = hubs.join(pairs.join(text("a"), "a"), text("b"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(lean(_compared(n)), "a binary, b binary, na long, nb long, both long, outside array<long>, odd array<long>").dropDuplicates(["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """key, root: of each node of a link the least node that it reaches."""
    links = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    before = None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "large")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("x"))
        links = written(small.select("x.*").distinct(), "stars")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("key"), F.col("v").alias("root")).union(links.select("v", "v")).distinct()


def _merged(roots: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components after some more links (a, b), and of each former root that changes, or node that was alone, the new one."""
    root = lambda x: roots.select(F.col("key").alias(x), F.col("root").alias(f"root_{x}"))
    ends = more.join(root("a"), "a", "left").join(root("b"), "b", "left")
    changed = written(components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a != b").distinct()), "changed")
    return written(_renamed(roots, changed).union(changed).distinct(), "roots"), changed


def _renamed(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """rows with their column root as it is now."""
    names = rows.columns
    now = rows.join(changed.select(F.col("key").alias("root"), F.col("root").alias("_now")), "root", "left")
    return now.withColumn("root", F.coalesce("_now", "root")).select(*names)


def _across(rows: DataFrame, lists: _Dealt, condition: str) -> DataFrame:
    """x, y: rows (b, v, key, root, ...) of one list and of different components that meet the condition.

    Of each list the component with most rows is left out on one side, so a component never meets itself.
    """
    roots = rows.groupBy("b", "v", "root").agg(F.count(F.lit(1)).alias("many"))
    major = roots.groupBy("b", "v").agg(F.max_by("root", F.struct("many", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").drop("roots")
    # Written in parts: a plan's share of the driver grows with the square of its size, as it is planned again after each of its stages.
    held = written(lists.join(rows, written(major, "major")), "held")
    names = ("key", "size", "both", "common", "root", "odd")
    other = held.select("b", "v", *[F.col(c).alias(f"{c}_y") for c in names])
    met = lists.dealt(other, "key_y").join(lists.in_each_slice(held.filter("root != major")), ["b", "v", "_s"])
    return written(met.filter(f"root != root_y AND {condition}").select(F.col("key").alias("x"), F.col("key_y").alias("y")), "met")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, kept."""
    given = id_and_text(docs, id_col, text_col)
    kind = id_type(docs, id_col)
    rows = written(given.withColumn("th", F.xxhash64("text")).mapInArrow(lean(_sketcher(n, k)), f"doc_id {kind}, th long, n long, key binary, sketch array<long>"), "sketches")
    filled = rows.filter("key IS NOT NULL")
    grouped = filled.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    lists = written(_lists(grouped, k, percent), "lists")
    classes = written(grouped.join(lists.select("key").distinct(), "key", "left_semi"), "classes")
    linked = f"100 * both >= {percent} * (na + nb - both)"
    collected(docs.sparkSession)

    first = lists.groupBy("v").agg(F.max_by("key", F.struct("heavy", "key")).alias("b"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("v", "b")
    stars = written(lists.join(first, "v").filter("key != b").select(F.col("key").alias("a"), "b").distinct(), "stars")
    # What a hub's only class has in common with it rules out no other, so there the estimate decides whether to compare.
    alone = stars.groupBy("b").agg(F.first("a").alias("a"), F.count(F.lit(1)).alias("many"))
    alone = written(alone, "alone")
    others = stars.join(alone.filter("many > 1").select("b"), "b", "left_semi")
    tested = written(_comparison(written(_estimated(alone.filter("many = 1").select("a", "b"), classes, k, percent).union(others.select("a", "b")), "likely"), classes, given, n), "tested")
    collected(docs.sparkSession)
    roots = written(components(tested.filter(linked).select("a", "b")), "roots")
    collected(docs.sparkSession)

    # Of hubs that some class is apart from: all classes, with what they share with the hub.
    hubs = _Dealt(tested, "b")
    root = lambda x, name: roots.select(F.col("key").alias(x), F.col("root").alias(name))
    each = tested.select("b", F.col("a").alias("key"), F.col("na").alias("size"), "both", "outside", "odd").join(root("key", "root"), "key", "left")
    of_hubs = tested.select("b").distinct().join(root("b", "root_b"), "b", "left").withColumn("root_b", F.coalesce("root_b", "b"))
    placed = hubs.join(each.withColumn("root", F.coalesce("root", "key")), of_hubs).withColumn("apart", F.col("root") != F.col("root_b")).drop("root_b")
    placed = written(placed, "rooted")
    wanted = placed.groupBy("b").agg(F.max("apart").alias("any"), F.min("size").alias("smallest")).filter("any").drop("any")
    placed = written(hubs.join(placed, wanted), "placed")
    facts = placed.drop("outside")
    # A link takes a share of both sizes; the other one's is at least that of the smallest class of the hub, and percent of this one's.
    other_size = F.greatest(F.col("smallest"), F.ceil(F.col("size") * percent / 100))
    total = F.ceil((F.col("size") + other_size) * percent / (100 + percent))
    outside = placed.select("b", "key", F.size("outside").alias("size"), F.greatest(F.lit(1), total - F.col("both")).alias("need"), F.explode("outside").alias("v"))
    outside = written(_rarest(outside, ["b", "key"], F.col("size") - F.col("need") + 1).drop("heavy").join(facts, ["b", "key"]), "outside")

    collected(docs.sparkSession)
    # Again one class of each list against the others: the one whose values most others share may be a better hub.
    better = written(outside.groupBy("b", "v").agg(F.max_by(F.struct("key", "root"), F.struct(F.col("both") + F.col("common"), F.col("key"))).alias("h")), "better")
    lists = _Dealt(outside, "b", "v")
    second = lists.join(outside.filter("apart"), better).filter("root != h.root").select(F.col("key").alias("a"), F.col("h.key").alias("b")).distinct()
    second = written(_estimated(written(second, "met"), classes, k, percent), "second")
    if not second.isEmpty():
        more = written(_comparison(second, classes, given, n).filter(linked).select("a", "b"), "links")
        roots, changed = _merged(roots, more)
        facts, outside = _renamed(facts, changed), _renamed(outside, changed)

    collected(docs.sparkSession)
    # The few whose share with the hub may be enough by itself meet by their retained values.
    enough = facts.filter(F.col("both") >= total).join(classes.select("key", "sketch"), "key")
    enough = enough.select("b", "key", F.size("sketch").alias("size"), _need(F.size("sketch"), k, percent).alias("need"), F.explode("sketch").alias("v"))
    enough = written(_rarest(enough, ["b", "key"], F.col("size") - F.col("need") + 1).drop("heavy", "common").join(facts, ["b", "key"]).withColumn("common", F.lit(0)), "enough")
    near = f"100 * least(size, size_y) >= {percent} * greatest(size, size_y) AND {_differ(percent)}"
    by_itself = f"{100 + percent} * least(both, both_y) >= {percent} * (size + size_y)"
    # Values that a class alone has are in no intersection, so the rest bounds it.
    most = f"{100 + percent} * (least(both, both_y) + least(common, common_y)) >= {percent} * (size + size_y)"
    pairs = _apart(_across(outside, lists, f"{near} AND {most}").union(_across(enough, _Dealt(enough, "b", "v"), f"{near} AND {by_itself}")))
    met = stars.select(F.col("a").alias("x"), F.col("b").alias("y")).union(second.select("a", "b"))
    pairs = written(pairs.join(_apart(met), ["a", "b"], "left_anti"), "met")
    collected(docs.sparkSession)
    pairs = written(_estimated(pairs, classes, k, percent), "pairs")
    collected(docs.sparkSession)
    if not pairs.isEmpty():
        more = written(_comparison(pairs, classes, given, n).filter(linked).select("a", "b"), "links")
        roots, _ = _merged(roots, more)

    collected(docs.sparkSession)
    # The least id of each component, by class.
    reps = filled.groupBy("key").agg(F.min("doc_id").alias("rep")).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = reps.filter(F.col("root") != F.col("key")).select("root", "rep").union(reps.join(roots.select("root").distinct(), "root", "left_semi").select("root", "rep")).groupBy("root").agg(F.min("rep").alias("least"))
    by_key = reps.join(least, "root", "left").select("key", F.coalesce("least", "rep").alias("component_id"))
    out = filled.join(by_key, "key").select("doc_id", "th", "n", "component_id").union(rows.filter("key IS NULL").select("doc_id", "th", "n", "doc_id"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of one document of each component."""
    gone = written(near_duplicates(docs, id_col, text_col, n, percent).filter("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_text")), "gone")
    gone = F.broadcast(gone) if gone.count() <= SENT else gone
    same = docs[id_col].eqNullSafe(gone["gone_id"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == gone["gone_text"])
    return docs.join(gone, same, "left_anti")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85).drop("th")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * c >= 85 * (zx.n + zy.n - c)
), both_ AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, y FROM r JOIN both_ ON x = r.c
), m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d JOIN m USING (doc_id) LEFT JOIN z USING (doc_id)
"""

QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLES = {"op10_near_dedup": ORACLE}
