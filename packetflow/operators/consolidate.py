"""Consolidation end to end: hypotheses of a packet's documents to one scored record.

A flat field takes the reading of its primary document type where there is one, else the vote of VINs or the aligned vote.
Entity fields take what the nest's winning source says; a scalar that source lacks falls back to the aligned vote, an
address part does not. Every choice is scored against all readings of its field. A chosen primary reading is reviewed when
another type speaks and none confirms it, any other choice by its score.

Empty input gives no rows; a packet without readings has no record; extra columns are not read. Values are one row per
packet, field and value before anything is compared; only a record's own variants and items are ever collected, into the
record they belong to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packetflow.functions.refdata import ENTITY_ADDRESS, ENTITY_SCALARS, entity_fields
from packetflow.functions.scalars import normalize_vin
from packetflow.functions.text import squeeze_upper
from packetflow.operators import consensus as V, entities as E, payload

_ENTITY_FIELDS = [f for _, f, _ in entity_fields()]
_OUT = [*V.KEYS, "value", "confidence", "review_required", "chosen_by"]


def votes(hypotheses: DataFrame) -> DataFrame:
    """Hypotheses in the shape of readings: one row per extraction and field."""
    rows = hypotheses.select(F.col("extraction_id").alias("variant_id"), "packet_id", F.col("field").alias("field_name"), "value", squeeze_upper("value").alias("key"), "confidence", F.col("source_document_name").alias("doc_name"), F.col("document_type").alias("doc_type"))
    return rows.withColumn("units", F.round(F.col("confidence") * 100_000_000).cast("bigint"))


def _scored(counts: DataFrame, chosen: DataFrame, by: str) -> DataFrame:
    chosen = chosen.withColumn("consensus", squeeze_upper("value"))
    keep = ["value", "confirmed"] if "confirmed" in chosen.columns else ["value"]
    found = V.scored(counts, chosen, keep)
    review = ~F.col("confirmed") if "confirmed" in keep else F.col("review_required")
    return found.withColumn("review_required", review).withColumn("chosen_by", F.lit(by)).select(*_OUT)


def primary_scored(votes_: DataFrame, counts: DataFrame) -> DataFrame:
    """packet_id, field_name, value, confidence, review_required of the fields their primary document type speaks for."""
    found = V.primary_readings(votes_)
    value = F.when(F.col("field_name") == "vehicle_vin", F.coalesce(F.nullif(normalize_vin(F.col("spelling")), F.lit("")), F.col("spelling"))).otherwise(F.col("spelling"))
    return _scored(counts, found.select(*V.KEYS, value.alias("value"), "confirmed"), "primary")


def vin_scored(votes_: DataFrame, counts: DataFrame) -> DataFrame:
    """The vote of VINs, scored."""
    return _scored(counts, V.vin_consensus(votes_).select("packet_id", F.lit("vehicle_vin").alias("field_name"), F.col("vin").alias("value")), "vin")


def entity_scored(hypotheses: DataFrame, counts: DataFrame) -> DataFrame:
    """What the winning source of each nest says, scored against all readings of the field."""
    won = E.entity_values(E.entity_source(E.entity_readings(hypotheses)))
    return _scored(counts, won.select("packet_id", F.col("field").alias("field_name"), "value"), "entity")


def consolidated(extractions: DataFrame) -> DataFrame:
    """packet_id, field_name, value, confidence, review_required, chosen_by (primary, vin, entity, aligned)."""
    hypotheses = payload.hypotheses(extractions)
    all_votes = votes(hypotheses)
    counts = V.values(all_votes)
    flat = ~F.col("field_name").isin(*_ENTITY_FIELDS)
    first = primary_scored(all_votes.filter(flat), counts)
    rest = all_votes.filter(flat).join(first.select(*V.KEYS), V.KEYS, "left_anti")
    vins = vin_scored(rest, counts)
    entity = entity_scored(hypotheses, counts)
    scalars = [f for fields in ENTITY_SCALARS.values() for f in fields]
    left = all_votes.filter(F.col("field_name").isin(*scalars)).join(entity.select(*V.KEYS), V.KEYS, "left_anti")
    aligned = _scored(counts, V.rover(rest.filter("field_name <> 'vehicle_vin'").unionByName(left)), "aligned")
    return first.unionByName(vins).unionByName(entity).unionByName(aligned)


def records(extractions: DataFrame) -> DataFrame:
    """packet_id, record_json: flat fields, nests with their address, and extra items by document, each field with its variants."""
    hypotheses = payload.hypotheses(extractions)
    variant = F.struct((-F.col("confidence")).alias("rank"), F.col("doc_name"), "value", "confidence", "doc_type", "variant_id")
    variants = votes(hypotheses).groupBy(*V.KEYS).agg(F.array_sort(F.collect_list(variant)).alias("v"))
    listed = F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["confidence"].alias("confidence"), x["doc_name"].alias("source_document_name"), x["doc_type"].alias("source_document_type")))
    entry = F.struct("value", "confidence", "review_required", listed.alias("variants"))
    rows = consolidated(extractions).join(variants, V.KEYS).select(*V.KEYS, entry.alias("entry"))
    names = payload.FIELDS
    wide = rows.groupBy("packet_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("entry"))).alias(f) for f in names])

    def nest(name: str):
        short = lambda f: f.removeprefix(f"{name}_")
        any_of = lambda fields: F.greatest(*[F.col(f).isNotNull() for f in fields])
        parts = F.struct(*[F.col(f).alias(f.rsplit("_", 1)[1]) for f in ENTITY_ADDRESS[name]])
        address = F.when(any_of(ENTITY_ADDRESS[name]), parts).alias("address")
        return F.when(any_of((*ENTITY_SCALARS[name], *ENTITY_ADDRESS[name])), F.struct(*[F.col(f).alias(short(f)) for f in ENTITY_SCALARS[name]], address)).alias(name)

    sources = extractions.dropDuplicates(["extraction_id"]).select("extraction_id", "packet_id", F.coalesce("source_document_name", F.lit("")).alias("document"))
    items = payload.extra_items(extractions).join(sources, "extraction_id").groupBy("packet_id", "document").agg(F.array_sort(F.collect_list(F.struct("extraction_id", "item_no", "field_name", "value", "confidence"))).alias("i"))
    items = items.select("packet_id", "document", F.transform("i", lambda x: F.struct(x["field_name"].alias("field_name"), x["value"].alias("value"), x["confidence"].alias("confidence"))).alias("i"))
    extra = items.groupBy("packet_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("document", "i")))).alias("extra"))
    flat = [F.col(f) for f in names if f not in _ENTITY_FIELDS]
    return wide.join(extra, "packet_id", "full").select("packet_id", F.to_json(F.struct(*flat, *[nest(n) for n in ENTITY_SCALARS], "extra")).alias("record_json"))
