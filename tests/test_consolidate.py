import json

from packetflow.functions.refdata import FIELDS
from packetflow.operators import assembly, consolidate as K, flatten

FV = "struct<value string, confidence double>"
SCHEMA = "extraction_id bigint, packet_id bigint, document_type string, source_document_name string, extra array<struct<field_name string, value string, confidence double>>, " + ", ".join(f"{f} {FV}" for f in FIELDS) + ", key string"


def extractions(spark, *rows):
    """rows: (extraction_id, packet_id, type, name, extra, {field: (value, confidence)})"""
    return spark.createDataFrame([(i, p, t, n, x, *[d.get(f) for f in FIELDS], "clash") for i, p, t, n, x, d in rows], SCHEMA)


def test_consolidated(spark):
    owner = {"owner_full_name": ("Acme Lease LLC", 0.9), "owner_address_street": ("1 Elm St", 0.8), "owner_address_city": ("Dover", 0.8)}
    x = extractions(
        spark,
        (1, 1, "manufacturer_certificate", "MCO", None, {"vehicle_vin": ("1m8gdm9a-xkp042788", 0.5), "vehicle_make": ("Corvanta", 0.9)}),
        (2, 1, "dealer_invoice", "Inv", [("stamp", "77", 0.9), (None, "x", 0.5)], owner | {"vehicle_vin": ("1M8GDM9AXKP042788", 0.9), "vehicle_make": ("Meridane", 0.9), "vehicle_color": ("Blue", 0.9)}),
        (3, 1, "universal_title_application", "UTA", None, {"owner_full_name": ("Someone", 1.0), "owner_phone": ("201-555-1234", 0.7), "owner_address_zip": ("07801", 1.0), "vehicle_color": ("blue", 0.6)}),
        (4, 2, "dealer_invoice", "Inv", None, {"vehicle_vin": ("AAA", 0.9)}),
        (4, 2, "dealer_invoice", "Inv", None, {"vehicle_vin": ("AAA", 0.9)}),
        (5, 3, None, None, None, {}),
    )
    got = {(r.packet_id, r.field_name): (r.value, r.review_required, r.chosen_by) for r in K.consolidated(x).collect()}
    assert got[1, "vehicle_vin"] == ("1M8GDM9AXKP042788", False, "primary") and got[1, "vehicle_make"] == ("Corvanta", True, "primary")
    assert got[1, "vehicle_color"] == ("Blue", False, "aligned") and got[2, "vehicle_vin"] == ("AAA", False, "vin")
    assert got[1, "owner_full_name"][::2] == ("Acme Lease LLC", "entity") and got[1, "owner_phone"][::2] == ("201-555-1234", "aligned")
    assert (1, "owner_address_zip") not in got  # address parts come from the winning source only
    assert not any(p == 3 for p, _ in got) and len(got) == 8

    records = {r.packet_id: json.loads(r.record_json) for r in K.records(x).collect()}
    first = records[1]
    assert first["owner"]["address"]["city"]["value"] == "Dover" and first["owner"]["phone"]["confidence"] == 0.7 and "zip" not in first["owner"]["address"]
    assert [v["source_document_name"] for v in first["vehicle_make"]["variants"]] == ["Inv", "MCO"] and first["extra"] == {"Inv": [{"field_name": "stamp", "value": "77", "confidence": 0.9}]}
    counts = {r.record_id: (r.fields, r.variants, r.extra_items) for r in assembly.record_counts(flatten.flatten_records(K.records(x), "packet_id")).collect()}
    assert counts[1] == (7, 11, 1) and counts[2] == (1, 1, 0)
    assert K.consolidated(x.limit(0)).count() == 0 and K.records(x.limit(0)).count() == 0


def test_nothing_agrees_and_nothing_is_sure(spark):
    """A chosen value no reading spells, or readings without any confidence, are scored and not divided by zero."""
    x = extractions(
        spark,
        (1, 1, "manufacturer_certificate", "A", None, {"vehicle_vin": ("1M8-GDM9-AXKP-0427-88", 0.8)}),
        (2, 1, "dealer_invoice", "B", None, {"vehicle_vin": ("zz", 0.9)}),
        (3, 2, "dealer_invoice", "A", None, {"vehicle_color": ("TURQUOISE", 0.0)}),
        (4, 2, "dealer_invoice", "B", None, {"vehicle_color": ("TURQUOISA", 0.0)}),
        (5, 2, "dealer_invoice", "C", None, {"vehicle_color": ("TURQUOISE", 0.0)}),
    )
    got = {(r.packet_id, r.field_name): (r.confidence, r.review_required) for r in K.consolidated(x).collect()}
    assert got == {(1, "vehicle_vin"): (0.0, True), (2, "vehicle_color"): (0.0, True)}
