"""Incremental consolidation of newly landed readings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from packetflow.operators import consensus


def landed(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def loads_by_hour(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Rows and packets per field and hour of ingestion; rows later than lateness are left out, as the watermark says."""
    return stream.withWatermark("ingested_at", lateness).groupBy(F.window("ingested_at", "1 hour"), "field_name").agg(F.count("*").alias("n_rows"), F.approx_count_distinct("packet_id").alias("packets"))


def consolidate_touched(stream: DataFrame, history: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For each micro batch, the consensus of the packets it touches, computed over their whole history.

    history() reads all readings landed so far; the batch only says which packets to redo, so a batch run again after a
    failure gives the same rows.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        touched = rows.select("packet_id").distinct()
        votes = consensus.variants(history().join(touched, "packet_id", "left_semi"))
        counts = consensus.values(votes)
        write(consensus.scored(counts, consensus.plurality(counts)), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
