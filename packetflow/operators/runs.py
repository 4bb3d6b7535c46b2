"""Run control: what is still to do, how runs ended, usage totals, packets that share a stem."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stem(path):
    """The file's name without folders and ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def pending(packets: DataFrame, finished: DataFrame) -> DataFrame:
    """Packets with a PDF path and no finished record: an anti join before any work is done."""
    pdf = packets.filter(F.lower("pdf_path").endswith(".pdf"))
    return pdf.join(finished.select("packet_id").distinct(), "packet_id", "left_anti")


def run_summary(packets: DataFrame) -> DataFrame:
    """run_status, packets, pages, with_error."""
    status = F.coalesce("run_status", F.lit("unknown"))
    return packets.groupBy(status.alias("run_status")).agg(F.count("*").alias("packets"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("pages"), F.count("run_error").alias("with_error"))


def shared_stems(packets: DataFrame) -> DataFrame:
    """Stems that more than one path leads to; results under the stem alone would overwrite each other."""
    return packets.filter("pdf_path is not null").groupBy(stem(F.col("pdf_path")).alias("path_stem")).agg(F.count_distinct("pdf_path").alias("paths")).filter("paths > 1")


def usage_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """Sums of input, cached and output tokens and the first model named, per group; missing numbers count as 0, cached never above input."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    rows = calls.withColumn("cached_tokens", F.least("cached_tokens", "input_tokens"))
    named = F.col("model").isNotNull() & (F.col("model") != "")
    return rows.groupBy(*by).agg(n("input_tokens"), n("cached_tokens"), n("output_tokens"), F.min_by(F.when(named, F.col("model")), F.when(named, F.col("ord"))).alias("model"))
