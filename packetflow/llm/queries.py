"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetflow.llm import canonical, leaks, mixing, parties, places, residue, survivors
from packetflow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.map_values(table(spark, folder, "extractions"), table(spark, folder, "canonical_values")).select("field_name", "raw_value", "canonical_id")


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values that mean no entry, with their rows and the best score any entry reached."""
    mapped = canonical.map_values(table(spark, folder, "extractions"), table(spark, folder, "canonical_values"))
    return mapped.filter("canonical_id = 0").select("field_name", "raw_value", F.col("n").alias("n_rows"), F.round("score", 4).alias("best_score"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.found_survivors(table(spark, folder, "field_variants"), table(spark, folder, "document_types"))


def p4_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving value of every packet and field, contradicted or not."""
    found = survivors.survivors(table(spark, folder, "field_variants"), table(spark, folder, "document_types"))
    return found.select("packet_id", "field_name", "value_norm", F.round("votes", 4).alias("votes"), "n_values")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return parties.found_parties(table(spark, folder, "extractions"))


def p5_parties(spark: SparkSession, folder: str) -> DataFrame:
    """Every name entry with its party and how many entries that party has."""
    found = parties.parties(table(spark, folder, "extractions"))
    return found.join(found.groupBy("party").agg(F.count("*").alias("n_entries")), "party").select("extraction_id", "field", "party", "n_entries")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return places.found_places(table(spark, folder, "extractions"))


def p6_locations(spark: SparkSession, folder: str) -> DataFrame:
    """Every address entry with its location and how many entries that location has."""
    found = places.locations(table(spark, folder, "extractions"))
    return found.join(found.groupBy("location").agg(F.count("*").alias("n_entries")), "location").select("extraction_id", "role", "location", "n_entries")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.found_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per item that leaked, the documents that carry it and the largest coverage."""
    found = leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.round(F.max("coverage"), 4).alias("coverage"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is taken."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "source_weights"))[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Shares wanted and reached by source."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "source_weights"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.found_residue(table(spark, folder, "documents"))


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that stay in the corpus."""
    return residue.clean(table(spark, folder, "documents")).select("doc_id", "source", "n_chars")


def queries() -> dict[str, Query]:
    found = (p3_found, p3_unmatched, p4_found, p4_survivors, p5_found, p5_parties, p6_found, p6_locations, p7_found, p7_items, p8_mixture, p8_report, p9_found, p9_clean)
    return {f.__name__: f for f in found}


#: The task's rule for the surviving value as SQL: what a field follows, then confidence. It holds where no two values tie
#: in what they follow; the reliability that decides ties is estimated in rounds and has no SQL.
_SURVIVOR = rf"""
WITH once AS (SELECT DISTINCT ON (variant_id) * FROM field_variants
), spelled AS (SELECT *, upper(trim(regexp_replace(value, '\s+', ' ', 'g'))) AS plain FROM once
), normal AS (
  SELECT *, CASE WHEN field_name = 'vehicle_vin' THEN regexp_replace(plain, '[^A-Z0-9]', '', 'g') ELSE plain END AS v FROM spelled
), told AS (SELECT packet_id, field_name FROM normal WHERE v <> '' GROUP BY ALL HAVING count(DISTINCT v) > 1
), clean AS (
  SELECT packet_id, field_name, coalesce(confidence, 0.3) AS c, coalesce(trust, 0) AS trust, document_date,
    CASE WHEN field_name IN ({", ".join(f"'{f}'" for f in survivors.NAME_FIELDS)}) THEN trim(regexp_replace(regexp_replace(v, '{survivors.BEFORE_NAME}', ''), '{survivors.AFTER_NAME}', '')) ELSE v END AS v
  FROM normal LEFT JOIN document_types ON type_id = source_document_type
), fit AS (SELECT * FROM clean WHERE c >= 0.3 AND v NOT IN ({", ".join(f"'{p}'" for p in survivors.PLACEHOLDERS)})
), ranked AS (
  SELECT packet_id, field_name, v, c,
    CASE WHEN field_name IN ({", ".join(f"'{f}'" for f in survivors.TRUST_FIELDS)}) THEN trust WHEN field_name IN ({", ".join(f"'{f}'" for f in survivors.DATE_FIELDS)}) THEN coalesce(date_diff('day', DATE '1900-01-01', document_date), -1)
      WHEN field_name IN ({", ".join(f"'{f}'" for f in survivors.NAME_FIELDS)}) THEN CAST(c >= {survivors.WELL_READ} AS INTEGER) ELSE 0 END AS first,
    CASE WHEN field_name IN ({", ".join(f"'{f}'" for f in survivors.NAME_FIELDS)}) THEN len(list_filter(string_split(v, ' '), lambda w: length(regexp_replace(w, '[^A-Z0-9]', '', 'g')) >= 2)) ELSE 0 END AS second,
    CASE WHEN field_name IN ({", ".join(f"'{f}'" for f in survivors.NAME_FIELDS)}) THEN length(v) ELSE 0 END AS third
  FROM fit
)
SELECT packet_id, field_name, v AS value_norm FROM ranked SEMI JOIN told USING (packet_id, field_name)
QUALIFY row_number() OVER (PARTITION BY packet_id, field_name ORDER BY first DESC, second DESC, third DESC, c DESC, v DESC) = 1"""


def oracle_sql() -> dict[str, str]:
    """The others cannot be put into one SQL statement; tests compare them with brute force and planted cases."""
    return {"p4_found": _SURVIVOR}
