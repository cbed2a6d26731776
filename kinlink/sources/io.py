"""Readers and writers: tab-separated tables, truth, lists, stages, reports."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("entity_id", "business_name", "business_address", "country")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """All columns as strings; no quoting; missing values and missing columns are empty strings; header names are stripped."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("inferSchema", False).csv(path)
    named = raw.toDF(*(c.strip() for c in raw.columns))
    return named.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in named.columns else F.lit("").alias(c) for c in columns))


def load_sources(spark: SparkSession, folder: str, split: str, names: tuple[str, ...] = ("source1", "source2", "source3")) -> DataFrame:
    """All sources of a split, with src from 1; ids are stripped, empty and repeated ones dropped (the first stays)."""
    parts = [read_tsv(spark, f"{folder}/{split}_{n}.tsv").withColumn("entity_id", F.trim("entity_id")).withColumn("src", F.lit(i + 1).cast("byte")) for i, n in enumerate(names)]
    return reduce(DataFrame.unionByName, (first_by(p, "entity_id", [F.col("_row")]) for p in (x.withColumn("_row", F.monotonically_increasing_id()) for x in parts))).drop("_row")


def first_by(df: DataFrame, id_: str, order: list[Column]) -> DataFrame:
    """The first row of each non-empty id."""
    from pyspark.sql import Window

    return df.filter(F.coalesce(F.col(id_).cast("string"), F.lit("")) != "").withColumn("_rn", F.row_number().over(Window.partitionBy(id_).orderBy(*order))).filter("_rn = 1").drop("_rn")


def id_list(c: Column) -> Column:
    """Ids of a comma-separated list, stripped, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(l_id, r_id): one row a link."""
    raw = read_tsv(spark, path, ("source1_entity_id", "matched_entity_ids"))
    return raw.select(F.trim("source1_entity_id").alias("l_id"), F.explode(id_list(F.col("matched_entity_ids"))).alias("r_id"))


def owners(truth: DataFrame) -> DataFrame:
    """(r_id, owner): truth by right record; the smallest left record, should there be several."""
    return truth.groupBy("r_id").agg(F.min("l_id").alias("owner"))


def semi(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose id is listed."""
    return df.join(ids.select(on).distinct(), on, "left_semi")


def source_of(id_: Column) -> Column:
    """2 for ids that begin with S2, else 3."""
    return F.when(F.startswith(id_, F.lit("S2")), 2).otherwise(3).cast("byte")


def id_lists(records: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """One row for every left record: its linked ids, unique, sorted, joined by commas (or empty)."""
    lists = links.groupBy("l_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("r_id").cast("string"))), ",").alias(name))
    return records.select("l_id").join(lists, "l_id", "left").fillna("", [name])


def write_lists(lists: DataFrame, path: str, header: str = "source1_entity_id") -> None:
    lists.withColumnRenamed("l_id", header).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def violations(records: DataFrame, right: DataFrame, matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rule, n): rows that break a rule of the output; all 0 if it is valid.  matches and candidates have l_id and ids (array)."""
    m = matches.select("l_id", F.explode("ids").alias("r_id"))
    c = candidates.select("l_id", F.explode("ids").alias("r_id"))
    rules = {
        "missing records": records.select("l_id").join(matches, "l_id", "left_anti"),
        "unknown records": matches.select("l_id").join(records, "l_id", "left_anti"),
        "repeated records": matches.groupBy("l_id").count().filter("count > 1"),
        "repeated ids": matches.filter(F.size("ids") != F.size(F.array_distinct("ids"))),
        "unknown ids": m.join(right.select("r_id"), "r_id", "left_anti"),
        "matches that are no candidates": m.join(c, ["l_id", "r_id"], "left_anti"),
    }
    return reduce(DataFrame.unionByName, (d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("rule"), "n") for k, d in rules.items()))


def stage_table(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; made and written first unless a finished one is there.

    Spark's own readers find it, on any file system; a table without its _SUCCESS mark is made again.
    """
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small dictionary (learned tables, metrics) as one JSON line."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def to_dict(table: DataFrame, key: str, value: str, most: int = 100_000) -> dict[str, str]:
    """A learned table as a dictionary; an error beyond ``most`` rows, which belong in a join."""
    rows = table.select(key, value).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: join the table instead")
    return {r[0]: r[1] for r in rows}


def report(lines: DataFrame, path: str, most: int = 1000) -> None:
    """A text report of at most ``most`` lines, in order of its columns."""
    lines.orderBy(*lines.columns).limit(most).select(F.concat_ws(" | ", *lines.columns).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def normalize_files(spark: SparkSession, data_dir: str, out_dir: str, splits: tuple[str, ...] = ("train", "test")) -> None:
    """Normalises all sources of the splits into Parquet, by country."""
    from ..functions.text import normalize

    for split in splits:
        normalize(load_sources(spark, data_dir, split)).write.mode("overwrite").partitionBy("country_n").parquet(f"{out_dir}/{split}")


SCHEMA = T.StructType([T.StructField(c, T.StringType(), False) for c in COLUMNS])
