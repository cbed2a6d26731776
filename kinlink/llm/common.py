"""Session plumbing shared by the operators: shared folder, staged tables, columns."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words are runs without space, tab, newline, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own if that is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/kinlink-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return found.rstrip("/")


_staged: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _forget() -> None:
    for path, spark in _staged.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit
            return


atexit.register(_forget)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    It cuts the lineage in a way that survives lost executors, and Spark may
    drop the shuffle files that produced it at once.
    """
    path = f"{shared_dir(spark)}/kinlink-{name}-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    _staged[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes staged tables (or unions of them) that nothing still to be computed reads."""
    for df in frames:
        for path in [df.staged_at] if isinstance(df.staged_at, str) else df.staged_at:
            _delete(_staged.pop(path), path)


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, salts: int = 16) -> DataFrame:
    """Inner join on ``key``, of which right has one row each: copied, so that rows of a key that a third of left shares go to several tasks."""
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(copies.hint("merge"), [key, "_salt"]).drop("_salt")


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A uniform number in (0, 1) from the md5 of the parts, the same in any SQL engine."""
    digest = F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 13)
    return (F.conv(digest, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
