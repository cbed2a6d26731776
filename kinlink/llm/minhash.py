"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct shingles (runs of ``width`` words; with fewer words,
the whole sequence).  Two small collections, A and B, hold m keys each, a key made of r
MinHash values.  Table (i, j) is keyed by the pair (A_i, B_j): m * m tables from only
2 * m * r MinHash values, where plain banding would need 2 * r for each table.  Two documents
of similarity s meet in some table unless all of A or all of B fails, so with probability
(1 - (1 - s**r)**m)**2; m is the least that loses no more than ``miss`` at the threshold.

Most keys are nobody else's, so the two collections are pruned before they are paired: a
document's pairs are made of keys that another document shares.

Documents of equal sets are one class from the start.  In each table's bucket the classes
are compared with two of its classes, the least id and the least hash of an id (stars, not
all pairs); links are confirmed on full sets and joined to components.  Classes that meet in
a bucket but lie in different components then are compared in full, without listing the pairs
of a bucket: two sets of sizes a <= b that are similar enough share at least
o = t / (1 + t) * (a + b) elements, so in any common order of elements (rarest first) one of
them is among the first a - ceil(2 t / (1 + t) * a) + 1 of the smaller and the first
b - ceil(t * b) + 1 of the larger.  Classes meet on those elements only, and a meeting counts
only where enough elements are left after it (the first common element of a similar pair
always does), so no link is lost and a large group of copies that lie just under the
threshold makes few pairs: what it has in common comes late in the order.

Cases.  Null or empty text, or no words: empty set, linked with nothing, its own component.
Null doc_id: passed through, component null, kept.  Ties: ids are compared as numbers.
Repeated rows are copies and share a component; rows that carry one doc_id with different
texts are classes of their own.  Long texts are worked through in slices.  Empty table: empty
result.  Extra columns of any name do not matter: only doc_id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph
from .bytesops import combine, mix, slices, words_of

_U = np.uint64


def collections(percent: int, r: int, miss: float) -> int:
    """Keys in each collection."""
    s = percent / 100
    return math.ceil(math.log(miss / 2) / math.log(1 - s**r))


def shingles(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each row, in order of rows, and how many each row has."""
    w, row, n = words_of(column)
    full = len(w) - width + 1
    hashes, rows = np.zeros(0, _U), np.zeros(0, np.int64)
    if full > 0:
        same = np.flatnonzero(row[:full] == row[width - 1 :])
        hashes, rows = combine([w[same + k] for k in range(width)]), row[same]
    for c in range(1, width):  # short rows: the whole sequence
        few = np.flatnonzero(n == c)
        if len(few):
            at = np.searchsorted(row, few)
            hashes = np.concatenate([hashes, mix(combine([w[at + k] for k in range(c)]) + _U(c))])
            rows = np.concatenate([rows, few])
    order = np.argsort(rows, kind="stable")
    return hashes[order], np.bincount(rows, minlength=len(n))


def sets(column, width: int) -> list[np.ndarray]:
    h, n = shingles(column, width)
    end = np.cumsum(n)
    return [np.unique(h[e - k : e]) for e, k in zip(end, n)]


def digests(found: list[np.ndarray]) -> np.ndarray:
    """Two digests of each non-empty set."""
    u, at = np.concatenate(found), np.r_[0, np.cumsum([len(x) for x in found])[:-1]]
    with np.errstate(over="ignore"):
        return np.stack([np.add.reduceat(mix(u ^ _U(c)), at) for c in (0x1F3D5B79, 0x2468ACE1)])


def signatures(found: list[np.ndarray], m: int, r: int) -> np.ndarray:
    """Of non-empty sets, the 2 * m keys of both collections (sets x 2m)."""
    u = np.concatenate(found)
    at = np.r_[0, np.cumsum([len(x) for x in found])[:-1]]
    rng = np.random.default_rng(20)
    odd, salt = rng.integers(1, 1 << 63, 2 * m * r, dtype=np.uint64) | _U(1), rng.integers(0, 1 << 63, 2 * m * r, dtype=np.uint64)
    keys = np.empty((len(found), 2 * m), _U)
    with np.errstate(over="ignore"):
        for k in range(2 * m):
            least = [np.minimum.reduceat((u ^ salt[k * r + j]) * odd[k * r + j], at) for j in range(r)]
            keys[:, k] = combine([*least, np.full(len(found), k, _U)])
    return keys


def _describe(width: int, m: int, r: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = sets(part.column("text"), width)
                has = [i for i, x in enumerate(found) if len(x)]
                d = np.zeros((2, len(found)), _U)
                keys: list = [None] * len(found)
                if has:
                    some = [found[i] for i in has]
                    d[:, has] = digests(some)
                    for i, x in zip(has, signatures(some, m, r).view(np.int64)):
                        keys[i] = x
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "d1", "d2", "keys"]
                )

    return run


def _sets(width: int):
    """Sets of the classes (id, d1, d2) whose text this is: another text of the same doc_id has other digests."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [(i, x) for i, x in enumerate(sets(part.column("text"), width)) if len(x)]
                if found:
                    d = digests([x for _, x in found]).view(np.int64)
                    at = np.array([i for i, _ in found])
                    own = np.flatnonzero((np.asarray(part.column("d1"))[at] == d[0]) & (np.asarray(part.column("d2"))[at] == d[1]))
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at[own])), pa.array([found[k][1].view(np.int64) for k in own], pa.list_(pa.int64()))], names=["id", "s"])

    return run


def confirm(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    a, b = full.select(F.col("id").alias("u"), F.col("s").alias("su")), full.select(F.col("id").alias("v"), F.col("s").alias("sv"))
    both = F.size(F.array_intersect("su", "sv")).cast("long")
    linked = pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").withColumn("both", both)
    return linked.filter(100 * F.col("both") >= percent * (F.size("su") + F.size("sv") - F.col("both"))).select("u", "v")


def meetings(full: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components that may be similar enough: none that is goes missing.

    ``full`` has the sets (id, s), ``part`` the component of each id (id, c).
    """
    keep = lambda num, den: f"n - ({num} * n + {den - 1}) div {den} + 1"  # noqa: E731  n - ceil(num * n / den) + 1
    each = full.select("id", F.explode("s").alias("e"))
    shared = each.groupBy("e").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # of a set's elements, those that no other set has come first in the order
    own = each.join(shared.hint("merge"), "e").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("o"))
    sized = full.select("id", F.size("s").alias("n")).join(part.hint("merge"), "id")
    own = own.join(sized.hint("merge"), "id").withColumn("alone", F.expr("n - size(o)"))
    first = own.withColumn("o", F.expr(f"slice(o, 1, cast(greatest(0, {keep(percent, 100)} - alone) as int))"))
    placed = first.select("id", "n", "c", "alone", F.posexplode("o").alias("i", "x")).select("id", "n", "c", F.expr("alone + i").alias("at"), F.col("x.e").alias("e"))
    small = placed.filter(f"at < {keep(2 * percent, 100 + percent)}")
    large = placed.select("e", F.col("id").alias("v"), F.col("n").alias("vn"), F.col("c").alias("vc"), F.col("at").alias("vat"))
    order = "(n < vn or n = vn and id < v) and c <> vc"
    near = f"100 * n >= {percent} * vn and {100 + percent} * least(n - at, vn - vat) >= {percent} * (n + vn)"
    met = small.hint("merge").join(large.hint("merge"), "e").filter(f"{order} and {near}")
    return met.select(F.least("id", "v").alias("u"), F.greatest("id", "v").alias("v")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 80, width: int = 5, r: int = 3, miss: float = 1e-4) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    m = collections(percent, r, miss)
    text = docs.select("doc_id", "text")
    rows = common.stage(spark, text.mapInArrow(_describe(width, m, r), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, d1 long, d2 long, keys array<long>"), "minhash-rows")
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = common.stage(spark, classes.withColumn("id", F.monotonically_increasing_id()), "minhash-classes")
    # keys that at least two classes share
    each = classes.select("id", "n", F.posexplode("keys").alias("i", "k"))
    shared = each.groupBy("k").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("k")
    own = each.join(shared.hint("merge"), "k").groupBy("id", "n").agg(F.collect_list(F.when(F.col("i") < m, F.col("k"))).alias("a"), F.collect_list(F.when(F.col("i") >= m, F.col("k"))).alias("b"))
    tables = own.select("id", "n", F.explode("a").alias("a"), "b").select("id", "n", "a", F.explode("b").alias("b")).select(F.xxhash64("a", "b").alias("key"), "id", "n")
    tables = common.stage(spark, tables, "minhash-tables")
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  similarity is at most the ratio of sizes
    # stars
    least = lambda by: F.min(F.struct(*by, "id", "n"))
    first = tables.groupBy("key").agg(least([]).alias("f"), least([F.xxhash64("id").alias("h")]).alias("g"), F.max("id").alias("last")).filter("f.id < last").select("key", F.array(*(F.struct(F.col(f"{c}.id").alias("u"), F.col(f"{c}.n").alias("un")) for c in "fg")).alias("centres"))
    busy = common.stage(spark, tables.join(first.hint("merge"), "key"), "minhash-buckets")
    spokes = busy.select("id", "n", F.explode("centres").alias("x")).select("id", "n", "x.*")
    spokes = spokes.filter((F.col("id") != F.col("u")) & alike(F.col("n"), F.col("un"))).select(F.least("u", "id").alias("u"), F.greatest("u", "id").alias("v"))
    stars = common.stage(spark, spokes.distinct(), "minhash-stars")
    wanted = classes.select("id", "doc_id", "d1", "d2").join(busy.select("id").distinct().hint("merge"), "id", "left_semi")
    full = text.join(wanted.hint("merge"), "doc_id").select("id", "d1", "d2", "text").mapInArrow(_sets(width), "id long, s array<long>")
    full = common.stage(spark, full.dropDuplicates(["id"]), "minhash-sets")
    links = common.stage(spark, confirm(stars, full, percent), "minhash-links")
    # what is left: classes that share a bucket with another component
    part = graph.components(spark, links)
    at = busy.select("key", "id").join(part.hint("merge"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    at = common.stage(spark, at, "minhash-at")
    mixed = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    open_ = common.stage(spark, at.join(mixed.hint("merge"), "key").select("id", "c").distinct(), "minhash-open")
    left = common.stage(spark, full.join(open_.select("id").hint("merge"), "id", "left_semi"), "minhash-left")
    rest = common.stage(spark, meetings(left, open_, percent), "minhash-rest")
    more = common.stage(spark, confirm(rest, full, percent), "minhash-more")
    if not more.isEmpty():
        part = graph.components(spark, links.unionByName(more))
    common.release(tables, busy, stars, full, links, at, open_, left, rest, more)
    names = classes.select("id", "doc_id").join(part.hint("merge"), "id").groupBy("component").agg(F.min("doc_id").alias("least"))
    linked = common.spread_join(part, names, "component", "id").select("id", "least")
    named = classes.select("id", "doc_id", "d1", "d2").join(linked.hint("merge"), "id", "left")
    named = named.select("d1", "d2", F.coalesce("least", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "n", "d1", "d2").join(named.hint("merge"), ["d1", "d2"], "left")
    out = out.withColumn("component_id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, common.table(spark, sf_dir, "documents"), percent=85)
