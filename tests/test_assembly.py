import json

from packetflow.config import Settings
from packetflow.operators import assembly, flatten
from packetflow.sources import schemas
from tests.test_operators import doc, packets


def test_split_plan(spark):
    p = packets(spark, ([doc(1, 2, 2), doc(3), doc(9), None], [3], 4), ([doc(1)], None, None))
    found = [(r.packet_id, r.doc_ord, r.status, r.pages) for r in assembly.split_plan(p).orderBy("packet_id", "doc_ord").collect()]
    assert found == [(0, 0, "ok", [1, 2]), (0, 1, "skipped", []), (0, 2, "failed", []), (1, 0, "failed", [])]


def test_parts_and_unextracted(spark):
    p = packets(spark, ([doc(1, name="A", type="dealer_invoice"), doc(2, name="A", type="cover_letter"), doc(3, name="A", type=None)], [], 3))
    assert [(r.ord, r.part) for r in assembly.packet_parts(p, ("f", "g"), ("cover_letter",)).orderBy("ord").collect()] == [(0, "f"), (1, "g"), (2, "A"), (4, "A_3")]
    done = spark.createDataFrame([(0, "dealer_invoice"), (0, None)], "packet_id bigint, document_type string")
    assert [r.doc_ord for r in assembly.unextracted(p, done, ("cover_letter",)).collect()] == [2]


def test_records(spark):
    text = json.dumps({"a": {"value": " ", "review_required": True, "variants": [{"value": "x"}]}, "n": {"b": "B"}, "extra": {"D": [{"field_name": "f"}]}})
    nodes = flatten.flatten_records(spark.createDataFrame([(1, text)], "record_id bigint, record_json string"))
    assert tuple(assembly.record_counts(nodes).first()) == (1, 2, 1, 1, 1)
    assert tuple(assembly.record_values(nodes, {"v": ("a", "n.b"), "w": ("a",)}).first()) == (1, "B", None)


def test_schemas(spark):
    s = schemas.json_schema("driver_license")
    assert list(s["properties"]) == ["document_type", "source_document_name", "driver_dob", "driver_eyes_color", "extra"] and schemas.fields_of("odd") == schemas.fields_of("other")
    plain = schemas.translated(s | {"type": "OBJECT"})
    assert plain["type"] == "object" and "additionalProperties" not in json.dumps(plain) and plain["propertyOrdering"][0] == "document_type"
    assert schemas.instructions(spark).count() == 15
    answers = spark.createDataFrame([('{"driver_dob": {"value": "x", "confidence": 1}}',), (" ",), ("nope",), (None,), ("[1]",)], "answer string")
    rows = schemas.parsed_answers(answers, "answer", "driver_license").collect()
    assert [r.parse_status for r in rows] == ["ok", "empty", "invalid", "empty", "invalid"] and rows[0].payload.driver_dob.value == "x"


def test_dialect_keeps_names_and_definitions():
    schema = {
        "$schema": "x", "type": "OBJECT", "title": "T", "properties": {"title": {"type": ["STRING", "null"], "default": "d", "minimum": 1}, "kind": {"enum": ["default", {"title": 1}], "$ref": "#/$defs/K"}},
        "$defs": {"K": {"type": "Object", "properties": {"minimum": {"type": "number", "exclusiveMaximum": 4, "maxLength": 3}}, "additionalProperties": False}, "default": {"type": "String"}}, "items": [{"title": "gone"}],
    }
    assert schemas.translated(schema) == {
        "type": "object", "properties": {"title": {"type": ["string", "null"]}, "kind": {"enum": ["default", {"title": 1}], "$ref": "#/$defs/K"}}, "propertyOrdering": ["title", "kind"],
        "$defs": {"K": {"type": "object", "properties": {"minimum": {"type": "number", "maxLength": 3}}, "propertyOrdering": ["minimum"]}, "default": {"type": "string"}}, "items": [{}],
    }
    assert schema["title"] == "T" and schemas.translated({}) == {}


def test_prompts(spark):
    df = spark.createDataFrame([(1, 0, "A 'b'", "lease_agreement", "p.pdf"), (1, 1, None, None, None)], "packet_id bigint, doc_ord int, doc_name string, doc_type string, pdf_path string")
    a, b = [r.prompt for r in schemas.prompts(df).orderBy("doc_ord").collect()]
    assert "'A 'b''" in a and "from p.pdf" in a and "- lessee_name: lessee name" in a and "Mind: The lessor" in a and "- driver_dob" not in a and "not known" in b and "unknown" in b
    assert "- check_payment: Check (also cheque, stub)" in schemas.classification_prompt([("check_payment", "Check", ["stub", "cheque"])], 4)


def test_settings():
    s = Settings.load({"PACKETFLOW_DPI": "900", "PACKETFLOW_CONCURRENCY": "0", "PACKETFLOW_TIMEOUT_MS": "1", "PACKETFLOW_RETRIES": "x", "PACKETFLOW_DEBUG": "On", "PACKETFLOW_BASE_DELAY_SECONDS": " "})
    assert (s.dpi, s.concurrency, s.timeout_ms, s.retries, s.debug, s.base_delay_seconds) == (200, 1, 30_000, 3, True, 1.0)
