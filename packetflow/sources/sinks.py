"""Sinks: results as folders by packet bucket, and records nested back into JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BUCKETS = 64


def write_by_packet(df: DataFrame, folder: str, form: str = "parquet", buckets: int = BUCKETS) -> None:
    """Write under bucket=n folders by packet_id: readers of some packets open a few folders, and there is no folder per packet.

    buckets is the number of writing tasks as well; set it so that a bucket holds some hundred megabytes.
    """
    out = df.withColumn("bucket", F.pmod(F.xxhash64("packet_id"), F.lit(buckets)))
    out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").format(form).save(folder)


def consolidated_json(values: DataFrame) -> DataFrame:
    """packet_id, record_json from (packet_id, field_name, value, confidence, review_required): one object per packet, keys
    only for fields with a value. A packet has at most one row per field, so the object is bounded by the fields."""
    entry = F.struct("field_name", F.struct("value", "confidence", "review_required").alias("v"))
    grouped = values.filter("value is not null").groupBy("packet_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    return grouped.select("packet_id", F.to_json("m").alias("record_json"))
