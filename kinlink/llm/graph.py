"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) for every id of edges(u long, v long); component is the smallest id reachable.

    In each round a vertex moves to that of itself and its neighbours whose hash is least, and
    edges are rewritten between the places moved to.  The hash is another one in each round, so a
    constant share of the vertices is expected to go whatever the order of ids is (a chain of ids
    in order too), and rounds are logarithmic.  In the end each component is named by its least id.
    Minima are pre-aggregated, so a hub isn't gathered anywhere.  Self-loops and repeated edges
    are harmless; null ends are ignored.  No edges: empty result.
    """
    left = common.stage(spark, edges.select("u", "v").filter("u <> v").distinct(), "edges")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        move = both.groupBy(F.col("u").alias("id")).agg(F.min(rank("v")).alias("m")).select("id", F.least(F.col("m"), rank("id"))["to"].alias("to"))
        move = common.stage(spark, move, "moves")
        moves.append(move)
        a, b = move.select(F.col("id").alias("u"), F.col("to").alias("a")), move.select(F.col("id").alias("v"), F.col("to").alias("b"))
        rest = common.stage(spark, left.join(a, "u").join(b, "v").filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
        common.release(left)
        left = rest
    common.release(left)
    if not moves:
        return spark.createDataFrame([], "id long, component long")
    found = moves[-1].select("id", F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        later = found.select(F.col("id").alias("to"), "root")
        found = move.join(later, "to", "left").select("id", F.coalesce("root", "to").alias("root"))
    found = common.stage(spark, found, "roots")
    least = found.groupBy("root").agg(F.min("id").alias("component"))
    return common.spread_join(found, least, "root", "id").select("id", "component")
