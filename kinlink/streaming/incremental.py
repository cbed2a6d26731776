"""Linking of records that arrive, against a stored master table.

The master's keys are a static table; each micro-batch of right records is normalised and
joined with it, and every attempt of a batch writes the same folder, so a restart adds no row twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocking import key_join


def link_stream(spark: SparkSession, arriving: DataFrame, master: DataFrame, key: str, path: str, checkpoint: str, most: int = 50) -> StreamingQuery:
    """Writes (l_id, r_id) of equal keys for each batch of arriving (r_id, key) to ``path``; master has l_id and key."""

    def write(batch: DataFrame, number: int) -> None:
        key_join(master, batch, key, most).select("l_id", "r_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
