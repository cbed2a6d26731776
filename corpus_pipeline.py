"""Corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns a DataFrame with the columns of documents; the last returns the mix.  Stages are
written and read again between each other.

Cases.  Null doc_id: kept by the near-duplicate stage, and mixed like any other row.  Null
text: not toxic, no duplicate, nothing removed, no leak, size 0.  Rows that share a
doc_id: taken each by its text; only near-duplicates go.  Empty table: empty results.  Columns beyond
those of documents are carried by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import common, decontam, minhash, mixing, suffix_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from all labels, doesn't reject."""
    weights = toxicity.fit(spark, docs, common.table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(spark, docs, weights).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8): the one of the smallest id.

    Rows are told apart by a key of their own, so texts that share a doc_id are taken each.
    """
    rows = common.stage(spark, docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    named = rows.filter("doc_id is not null")
    found = minhash.near_duplicates(spark, named.select(F.col("_row").alias("doc_id"), "text"), percent=80)
    order = F.struct("doc_id", F.xxhash64("text").alias("h"), "_row")
    grouped = found.select(F.col("doc_id").alias("_row"), "component_id").join(named.select("_row", order.alias("o")).hint("merge"), "_row")
    first = grouped.groupBy("component_id").agg(F.min("o")["_row"].alias("_row")).select("_row", F.lit(True).alias("_first"))
    return rows.join(first.hint("merge"), "_row", "left").filter("_first or doc_id is null").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeated strings of 200 bytes cover."""
    found = suffix_dedup.mark(spark, docs, with_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("_kept"))
    new = {"text": text.alias("text"), "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars")}
    return found.select(*(new.get(c, F.col(c)) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, exact or edited."""
    found = decontam.mark(spark, docs, common.table(spark, sf_dir, "benchmark"))
    return found.filter(F.coalesce(F.size("_leaks"), F.lit(0)) <= 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that it takes at all, and how many whole epochs of it."""
    mixed = mixing.mix(spark, docs, quality=mixing.doc_quality(F.col("text")), keep=("lang", "n_chars"))
    return mixed.filter("taken > 0").select("doc_id", "source", "lang", "n_chars", "size", "source_size", "target", "epochs", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Trained models and byte spans are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage(spark, docs, f"pipeline-{name}")
    return docs
