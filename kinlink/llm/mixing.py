"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Every document gets the key ``-ln(u) / quality``; u is a hash of its id, its text and
the seed, so a rerun agrees.  Within a source, the documents with the smallest keys
are a weighted sample without replacement.  A source whose target holds k whole
times its size gets k complete epochs; the rest of its budget goes to documents
in key order, by prefix sums, and the document at the edge gives the words that
are still missing (``boundary="split"``) or all or nothing (``"whole"``).

A source may hold any share of the rows: the prefix sums are made in two levels.
Keys are dealt into about sqrt(n) buckets of a source, bucket sums are
pre-aggregated and prefix-summed, and only then are the rows of one bucket
ordered.  Buckets are cut by the distribution that keys have, 1 - mean of
exp(-key * quality) over eight quantiles of the source's quality, so that they hold
about sqrt(n) rows each; qualities that differ by orders of magnitude within an
eighth of a source make some of them larger.  Equal rows are counted first and
take part as one row, so a third of all rows being the same makes no large bucket.
Targets need one row a source in one task.

Cases.  Null or empty text: size 0, taken 0.  Null source: its own source, last in
order.  Repeated rows: each counts and is taken by itself; equal rows are
interchangeable.  Null id: hashes like an empty one.  Empty table: empty result.  A
source of size 0 has target 0.  Null or non-positive quality counts as 1.
Columns beyond doc_id, text, source are carried only if named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def targets(sizes: DataFrame, weight_cycle: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """Per source: source_size, n_docs, target, and quantiles of its quality.

    Targets share ``share`` times all words by weight; none passes ``max_epochs`` times its
    source, and what is cut goes to the others by weight until none is above.  That
    fixed point is min(cap, level * weight), with the level found from the sources
    sorted by cap / weight: prefix sums over one row a source.
    """
    qualities = F.percentile_approx("_q", [(2 * k + 1) / 16 for k in range(8)], F.lit(1000))
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), qualities.alias("_qualities"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    n = len(weight_cycle)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weight_cycle)), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_cap = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("_level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    # the level rises while sources are cut and falls afterwards, so the fixed point is its maximum
    level = F.max("_level").over(everything)
    return per.withColumn("target", F.least(F.col("_cap"), level * F.col("_w"))).select("_source", "source_size", "n_docs", "_qualities", "target")


def mix(
    spark: SparkSession, docs: DataFrame, quality: Column | None = None, weight_cycle: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_epochs: float = 3.0, seed: int = 7, boundary: str = "split", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, epochs, taken, and ``keep``."""
    if boundary not in ("split", "whole"):
        raise ValueError(boundary)
    q = F.lit(1.0) if quality is None else F.coalesce(F.when(quality > 0, quality.cast("double")), F.lit(1.0))
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("_source"), common.n_words(F.col("text")).alias("_size"), q.alias("_q"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_text"), *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)))
    rows = common.stage(spark, rows.withColumn("_key", -F.log(common.unit_hash(F.lit(seed), F.col("doc_id"), F.col("_text"))) / F.col("_q")).drop("_text"), "mix")
    goal = targets(rows, weight_cycle, share, max_epochs)
    same = ["doc_id", "_source", "_size", "_q", "_key", *(f"_keep_{i}" for i in range(len(keep)))]
    rows = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("_copies"))
    rows = rows.join(goal, rows["_source"].eqNullSafe(goal["_source"]), "inner").drop(goal["_source"])
    above = F.aggregate(F.transform("_qualities", lambda x: F.exp(-F.col("_key") * x)), F.lit(0.0), lambda a, x: a + x) / F.size("_qualities")
    rows = rows.withColumn("_bucket", F.floor((1 - above) * F.ceil(F.sqrt(F.col("n_docs")))).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", whole).withColumn("_budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    sums = rows.groupBy("_source", "_bucket").agg(F.sum(F.col("_size") * F.col("_copies")).alias("_sum"))
    by_bucket = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_source").alias("_s2"), F.col("_bucket").alias("_b2"), F.coalesce(F.sum("_sum").over(by_bucket), F.lit(0)).alias("_before"))
    rows = rows.join(sums, rows["_source"].eqNullSafe(F.col("_s2")) & (rows["_bucket"] == F.col("_b2")), "inner")
    in_bucket = Window.partitionBy("_source", "_bucket").orderBy("_key", *(c for c in same if c not in ("_source", "_key"))).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_ahead", F.col("_before") + F.coalesce(F.sum(F.col("_size") * F.col("_copies")).over(in_bucket), F.lit(0)))
    # equal rows one by one again, a few thousand at a time
    rows = rows.withColumn("_many", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / 4096).cast("long"))))
    rows = rows.withColumn("_one", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(4095).cast("long"), F.col("_copies") - 1 - F.col("_many") * 4096))))
    ahead = F.col("_ahead") + (F.col("_many") * 4096 + F.col("_one")) * F.col("_size")
    left = F.col("_budget") - ahead
    part = F.greatest(F.lit(0), F.least(F.col("_size"), left)) if boundary == "split" else F.when(2 * left >= F.col("_size"), F.col("_size")).otherwise(0)
    return rows.withColumn("_part", part).select(
        "doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", "epochs", (F.col("epochs") * F.col("_size") + F.col("_part")).cast("long").alias("taken"), *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep))
    )


def doc_quality(text: Column) -> Column:
    """A weight in [0.5, 1.5] from the text alone: words of usual length count more."""
    mean = F.length(text) / F.greatest(common.n_words(text), F.lit(1))
    return F.lit(0.5) + F.exp(-F.abs(mean - 6) / 6)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op8, with documents weighed by doc_quality."""
    docs = common.table(spark, sf_dir, "documents")
    return mix(spark, docs, quality=doc_quality(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
d AS (
  SELECT doc_id, source, size,
         -ln((CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
           / coalesce(0.5 + exp(-abs(CAST(length(text) AS DOUBLE) / greatest(size, 1) - 6) / 6), 1.0) AS k
  FROM n),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c),
t AS (SELECT source, source_size, least(cap, max(lv) OVER () * w) AS target FROM l),
e AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS ep,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(ep * size + greatest(0, least(size, CAST(floor(target - ep * source_size) AS BIGINT) - ahead)) AS BIGINT) AS taken
FROM e
"""
