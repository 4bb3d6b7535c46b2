"""Coherent entities: which source document speaks for an owner, lienholder, dealership or lessee, and what it says.

Every address part comes from one source. Sources are ranked by address parts present, by naming a firm (owners only), by
type, by fields present, mean and total confidence; the earliest extraction wins a tie. Owner data of excluded types do
not count. Packets without any source for a nest have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packetflow.functions.refdata import ENTITY_NAME_TOKENS, OWNER_EXCLUDED_TYPES, TYPE_BOOST, entity_fields

_SOURCE = ["packet_id", "nest", "source_document_name", "document_type"]


def entity_readings(hypotheses: DataFrame) -> DataFrame:
    """Hypotheses of entity fields with their nest; the surest per source and field, the earliest on a tie."""
    nests = F.create_map(*[x for n, f, a in entity_fields() for x in (F.lit(f), F.struct(F.lit(n).alias("nest"), F.lit(a).alias("part")))])
    rows = hypotheses.withColumn("e", nests[F.col("field")]).filter("e is not null").select("*", "e.nest", "e.part").drop("e")
    rows = rows.filter(~((F.col("nest") == "owner") & F.coalesce(F.col("document_type").isin(*OWNER_EXCLUDED_TYPES), F.lit(False))))
    units = F.round(F.col("confidence") * 10_000).cast("bigint")
    best = F.max(F.struct(units.alias("units"), (-F.col("extraction_id")).alias("first"), "value", "part")).alias("b")
    return rows.groupBy(*_SOURCE, "field").agg(best).select(*_SOURCE, "field", "b.units", (-F.col("b.first")).alias("extraction_id"), "b.value", "b.part")


def entity_source(readings: DataFrame) -> DataFrame:
    """packet_id, nest, source_document_name, document_type, parts, fields, said: the winning source of every nest, and its
    readings, at most one a field, carried along so that nobody has to look them up again."""
    boost = F.coalesce(F.create_map(*[F.lit(x) for pair in TYPE_BOOST.items() for x in pair])[F.col("document_type")], F.lit(0))
    firm = F.max((F.col("field") == "owner_full_name") & F.upper("value").rlike("|".join(ENTITY_NAME_TOKENS)))
    each = readings.groupBy(*_SOURCE).agg(F.count_if("part").alias("parts"), F.coalesce(firm, F.lit(False)).alias("firm"), F.count("*").alias("fields"), F.sum("units").alias("units"), F.min("extraction_id").alias("first"), F.array_sort(F.collect_list(F.struct("field", "value", F.col("units").alias("said_units")))).alias("said"))
    rank = F.struct("parts", "firm", boost.alias("boost"), "fields", (F.col("units") / F.col("fields")).alias("mean"), "units", (-F.col("first")).alias("first"))
    won = each.groupBy("packet_id", "nest").agg(F.max_by(F.struct("source_document_name", "document_type", "parts", "fields", "said"), rank).alias("w"))
    return won.select("packet_id", "nest", "w.*")


def entity_values(source: DataFrame) -> DataFrame:
    """packet_id, nest, field, value, confidence as the winning source has them."""
    return source.select("packet_id", "nest", F.explode("said").alias("s")).select("packet_id", "nest", "s.field", "s.value", (F.col("s.said_units") / 10_000).alias("confidence"))
