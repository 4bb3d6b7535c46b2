"""Extraction payloads to hypotheses: one long table of readings.

Rows delivered again under one extraction_id count once. A reading needs a value that is not blank and a confidence, which
is clamped to 0..1; fields a document type does not carry are dropped, unknown and null types are treated as other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packetflow.functions.refdata import DOCUMENT_TYPES, FIELDS, profile_fields
from packetflow.functions.scalars import confidence
from packetflow.functions.text import blank_to_null


def _profile():
    """field -> types that carry it, as one map literal of fixed size."""
    by: dict[str, list[str]] = {f: [] for f in FIELDS}
    for t, f in profile_fields():
        by[f].append(t)
    return F.create_map(*[x for f, ts in by.items() for x in (F.lit(f), F.array(*[F.lit(t) for t in ts]))])


def profile_type(c="document_type"):
    return F.when(F.col(c).isin(*DOCUMENT_TYPES), F.col(c)).otherwise("other")


def hypotheses(extractions: DataFrame, allowed_only: bool = True) -> DataFrame:
    """extraction_id, packet_id, document_type, source_document_name, field, value, confidence."""
    readings = F.array(*[F.struct(F.lit(f).alias("field"), blank_to_null(F.col(f"{f}.value")).alias("value"), confidence(F.col(f"{f}.confidence")).alias("confidence")) for f in FIELDS])
    kept = F.filter(readings, lambda r: r["value"].isNotNull() & r["confidence"].isNotNull())
    if allowed_only:
        kept = F.filter(kept, lambda r: F.array_contains(_profile()[r["field"]], profile_type()))
    once = extractions.dropDuplicates(["extraction_id"])
    rows = once.select("extraction_id", "packet_id", "document_type", "source_document_name", F.explode(kept).alias("r"))
    return rows.select("extraction_id", "packet_id", "document_type", "source_document_name", "r.*")


def extra_items(extractions: DataFrame) -> DataFrame:
    """extraction_id, item_no, field_name, value, confidence of the extra items that have all three."""
    rows = extractions.dropDuplicates(["extraction_id"]).select("extraction_id", F.posexplode("extra").alias("item_no", "x"))
    rows = rows.select("extraction_id", "item_no", blank_to_null(F.col("x.field_name")).alias("field_name"), blank_to_null(F.col("x.value")).alias("value"), confidence(F.col("x.confidence")).alias("confidence"))
    return rows.filter("field_name is not null and value is not null and confidence is not null")
