"""The test tables as records to link, in Spark and in SQL.

A part is a record: its name, an address made of its size and type, its brand as country.
src 1 is the master source, 2 and 3 the others.  A right record's owner is the least left
record of its brand and name.  ``scored`` are candidates with many tied and some unknown
scores, from order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lower("p_type")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        (1 + F.col("p_partkey") % 3).cast("int").alias("src"),
        F.lower("p_brand").alias("country"),
        F.col("p_name").alias("name"),
        F.concat_ws(" ", F.col("p_size").cast("string"), kind, F.lit("st")).alias("addr"),
        F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.substring(kind, 1, 1)).alias("part"),
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    all_ = rec(spark, sf_dir)
    left = all_.filter("src = 1").select(F.col("id").alias("l_id"), "country", F.col("name").alias("l_name"), F.col("addr").alias("l_addr"), F.col("part").alias("lpart"))
    right = all_.filter("src > 1").select(F.col("id").alias("r_id"), "src", "country", F.col("name").alias("r_name"), F.col("addr").alias("r_addr"), F.col("part").alias("rpart"))
    return left, right


def owners(left: DataFrame) -> DataFrame:
    """l_id of the left records that right ones can be linked with, of each brand and name the least."""
    return left.groupBy("country", "l_name").agg(F.min("l_id").alias("l_id")).select("l_id").distinct()


def truth(left: DataFrame, right: DataFrame) -> DataFrame:
    first = left.groupBy("country", F.col("l_name").alias("r_name")).agg(F.min("l_id").alias("l_id"))
    return right.join(first, ["country", "r_name"]).select("l_id", "r_id")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one brand and the same address key (size and type)."""
    left, right = sides(spark, sf_dir)
    return left.withColumn("key", F.concat_ws("|", "country", "l_addr")).join(right.withColumn("key", F.concat_ws("|", "country", "r_addr")).drop("country"), "key").drop("key")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    x = F.when(F.col("l_tax") == 0, None).otherwise(F.round(F.col("l_discount") * 10, 6))
    return line.select((F.col("l_orderkey") % 500).alias("l_id"), F.col("l_partkey").alias("r_id"), (2 + F.col("l_linenumber") % 2).cast("int").alias("src"), x.alias("x")).groupBy("l_id", "r_id", "src").agg(F.max("x").alias("x"))


def words(c):
    return tokens(F.lower(c))


REC = """rec AS (
  SELECT p_partkey AS id, CAST(1 + p_partkey % 3 AS INTEGER) AS src, lower(p_brand) AS country, p_name AS name,
         CAST(p_size AS VARCHAR) || ' ' || lower(p_type) || ' st' AS addr, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE substr(lower(p_type), 1, 1) END AS part FROM part),
l AS (SELECT id AS l_id, country, name AS l_name, addr AS l_addr, part AS lpart FROM rec WHERE src = 1),
r AS (SELECT id AS r_id, src, country, name AS r_name, addr AS r_addr, part AS rpart FROM rec WHERE src > 1),
truth AS (SELECT min(l.l_id) AS l_id, r.r_id FROM l JOIN r ON l.country = r.country AND l.l_name = r.r_name GROUP BY r.r_id),
pairs AS (SELECT l.l_id, l.country, l.l_name, l.l_addr, l.lpart, r.r_id, r.src, r.r_name, r.r_addr, r.rpart FROM l JOIN r ON l.country = r.country AND l.l_addr = r.r_addr)"""
SCORED = """scored AS (
  SELECT l_orderkey % 500 AS l_id, l_partkey AS r_id, CAST(2 + l_linenumber % 2 AS INTEGER) AS src, max(CASE WHEN l_tax = 0 THEN NULL ELSE round(l_discount * 10, 6) END) AS x
  FROM lineitem GROUP BY 1, 2, 3)"""


def toks_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')"
