"""What is asked of a model: JSON schemas and instructions per document type, and the schema in another dialect."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from packetflow.functions.refdata import DOCUMENT_TYPES, FIELDS, profile_fields

_READING = {"type": "object", "properties": {"value": {"type": "string"}, "confidence": {"type": "number"}}, "required": ["value", "confidence"], "additionalProperties": False}


def fields_of(document_type: str | None) -> list[str]:
    """Fields of a type in order; an unknown type has those of other."""
    known = document_type if document_type in DOCUMENT_TYPES else "other"
    return [f for t, f in profile_fields() if t == known]


def json_schema(document_type: str | None) -> dict:
    extra = _READING | {"properties": {"field_name": {"type": "string"}, **_READING["properties"]}, "required": ["field_name", "value", "confidence"]}
    texts = ("document_type", "source_document_name")
    properties = {t: {"type": "string"} for t in texts} | {f: _READING for f in fields_of(document_type)} | {"extra": {"type": "array", "items": extra}}
    return {"type": "object", "properties": properties, "required": list(texts), "additionalProperties": False}


def spark_schema(document_type: str | None = None) -> T.StructType:
    """The same as a struct for from_json; without a type, of all fields."""
    reading = T.StructType([T.StructField("value", T.StringType()), T.StructField("confidence", T.DoubleType())])
    item = T.StructType([T.StructField("field_name", T.StringType()), *reading.fields])
    names = list(FIELDS) if document_type is None else fields_of(document_type)
    return T.StructType([T.StructField("document_type", T.StringType()), T.StructField("source_document_name", T.StringType()), *[T.StructField(f, reading) for f in names], T.StructField("extra", T.ArrayType(item))])


#: Words the other dialect does not know.
UNKNOWN_WORDS = ("$schema", "$id", "additionalProperties", "unevaluatedProperties", "patternProperties", "dependencies", "dependentRequired", "dependentSchemas", "title", "default", "examples", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum")
#: Words whose keys are names, not words of the dialect.
_NAMES = ("properties", "$defs", "definitions")


def translated(schema: dict) -> dict:
    """A copy of a JSON schema for endpoints of the smaller dialect.

    Unknown words go, wherever they stand as words (a field may be called title), types are lower case, and objects state the
    order of their properties. Definitions, references, enumerations and lengths stay.
    """
    whole = json.loads(json.dumps(schema))
    todo = [(whole, False)]
    while todo:
        node, names = todo.pop()
        if isinstance(node, dict) and not names:
            for word in node.keys() & set(UNKNOWN_WORDS):
                del node[word]
            if "type" in node:
                node["type"] = node["type"].lower() if isinstance(node["type"], str) else [t.lower() if isinstance(t, str) else t for t in node["type"]]
            fields = node.get("properties")
            if node.get("type") == "object" and isinstance(fields, dict) and fields:
                node.setdefault("propertyOrdering", list(fields))
        inner = node.items() if isinstance(node, dict) else enumerate(node)
        todo += [(x, not names and k in _NAMES and isinstance(x, dict)) for k, x in inner if isinstance(x, (dict, list)) and k not in ("enum", "const", "required", "propertyOrdering", "type")]
    return whole


#: What to mind when reading a type, beside its list of fields.
GUIDANCE = {
    "driver_license": ("The holder is the driver; give no owner from this paper.",),
    "lease_agreement": ("The lessor is the owner, the customer the lessee.", "Give the address of the lessee as one address, not in parts of several."),
    "dealer_invoice": ("The seller is the dealership; the buyer is the owner unless a lessor is named.",),
    "manufacturer_certificate": ("Copy the VIN by character; the certificate outweighs other papers.",),
    "other": ("Give only what is labelled; everything else goes into extra.",),
}
#: What a field is, where its name does not say it.
DESCRIPTIONS = {
    "vehicle_vin": "vehicle identification number, 17 characters", "odometer_reading": "odometer reading in whole miles", "purchase_price": "price of the vehicle before tax", "owner_license_or_entity_id": "driver license number of a person, entity number of a firm",
    "dealership_entity_id": "entity number of the dealership", "lienholder_id": "lienholder code", "driver_dob": "date of birth of the driver", "plate_type": "plates asked for",
}


def described(field: str) -> str:
    return DESCRIPTIONS.get(field, field.replace("_", " "))


def extraction_prompt(document_type: str | None, document_name: str, source: str) -> str:
    """What a model is asked for one document."""
    known = document_type in DOCUMENT_TYPES and document_type != "other"
    lines = [f"Read the paper {document_name!r} from {source}: {(document_type or 'other').replace('_', ' ')}.", "Give each field below that the paper states as an object of value and confidence (0 to 1); leave out what it does not state.", "Put other labelled values into extra as field_name, value and confidence."]
    lines.append("Give no field that is not listed." if known else "The kind of paper is not known: give listed fields only where they are clearly labelled.")
    lines += [f"Mind: {g}" for g in GUIDANCE.get(document_type or "other", ())]
    return "\n".join([*lines, "Fields:", *[f"- {f}: {described(f)}" for f in fields_of(document_type)]])


def classification_prompt(document_types: list[tuple[str, str, list[str]]], total_pages: int | None = None) -> str:
    """What a model is asked for a packet; document_types are (type, label, aliases)."""
    lines = ["Name the documents of this packet with the pages of each; pages count from 1." if total_pages is None else f"Name the documents of this packet of {total_pages} pages with the pages of each; pages count from 1.", "Every page belongs to one document or is empty. Answer as JSON: documents (id, name, type, pages) and empty_pages.", "Types:"]
    return "\n".join([*lines, *[f"- {t}: {label}" + (f" (also {', '.join(sorted(a))})" if a else "") for t, label, a in document_types]])


def prompts(documents: DataFrame) -> DataFrame:
    """packet_id, doc_ord, doc_type, prompt of documents to be read (packet_id, doc_ord, doc_name, doc_type, pdf_path): one
    template a type, filled by replacing."""
    templates = F.create_map(*[F.lit(x) for t in DOCUMENT_TYPES for x in (t, extraction_prompt(t, "\x01", "\x02"))])
    other = F.lit(extraction_prompt(None, "\x01", "\x02"))
    name, path = F.coalesce("doc_name", F.lit("document")), F.coalesce("pdf_path", F.lit("unknown"))
    filled = F.replace(F.replace(F.coalesce(templates[F.col("doc_type")], other), F.lit(repr("\x01")), F.concat(F.lit("'"), name, F.lit("'"))), F.lit("\x02"), path)
    return documents.select("packet_id", "doc_ord", "doc_type", filled.alias("prompt"))


def instructions(spark: SparkSession) -> DataFrame:
    """document_type, fields, instruction, schema: one row a type."""
    rows = [(t, len(fields_of(t)), extraction_prompt(t, "document", "packet"), json.dumps(json_schema(t))) for t in DOCUMENT_TYPES]
    return spark.createDataFrame(rows, "document_type string, fields int, instruction string, schema string")


def parsed_answers(answers: DataFrame, column: str, document_type: str | None = None) -> DataFrame:
    """With payload (struct) and parse_status: ok, empty or invalid."""
    text = F.btrim(column, F.lit(" \t\r\n"))
    payload = F.from_json(text, spark_schema(document_type), {"mode": "PERMISSIVE"})
    # A text that is no JSON object parses to a struct of nulls; json_object_keys is null for it.
    status = F.when(text.isNull() | (text == ""), "empty").when(F.json_object_keys(text).isNull(), "invalid").otherwise("ok")
    return answers.withColumn("parse_status", status).withColumn("payload", F.when(F.col("parse_status") == "ok", payload))
