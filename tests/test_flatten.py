import json

import pyarrow as pa

from packetflow.operators import flatten

FV = "struct<value string, confidence double>"
EXTRA = "array<struct<field_name string, value string, confidence double>>"


def test_child_rows_keep_positions_and_keys():
    lists = pa.array([[1, None, 3], None, [], [4]])
    keys, position, values = flatten.child_rows(lists, {"k": pa.array(["a", "b", "c", "d"])})
    assert keys["k"].to_pylist() == ["a", "a", "d"]
    assert position.to_pylist() == [0, 2, 0] and values.to_pylist() == [1, 3, 4]


def test_child_rows_of_a_slice():
    lists = pa.array([[9], [1, 2], [3]]).slice(1)
    keys, position, values = flatten.child_rows(lists, {"k": pa.array([1, 2])})
    assert keys["k"].to_pylist() == [1, 1, 2] and position.to_pylist() == [0, 1, 0] and values.to_pylist() == [1, 2, 3]


def records(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "record_id bigint, record_json string")


def nodes(spark, *texts):
    return sorted((r.record_id, r.kind, r.node_path, r.item_no) for r in flatten.flatten_records(records(spark, *texts)).collect())


def test_all_shapes(spark):
    record = {
        "vehicle_vin": {"value": None, "variants": [None, {"value": "A"}, {"value": "B"}]}, "vehicle_make": "X", "vehicle_year": None,
        "owner": [{"name": {"value": "N", "variants": {"value": "N"}}}, None, {"address": {"street": "S", "city": {"value": 3}}}], "lessee": {"address": None},
        "extra": {"Doc.1": [None, {"field_name": "f", "value": "v"}], "Lone": {"field_name": "g"}, "None": None},
    }
    found = nodes(spark, json.dumps(record))
    assert found == sorted([
        (0, "field", "vehicle_vin", -1), (0, "variant", "vehicle_vin", 1), (0, "variant", "vehicle_vin", 2), (0, "field", "vehicle_make", -1), (0, "field", "owner[0].name", -1), (0, "variant", "owner[0].name", 0),
        (0, "field", "owner[2].address.street", -1), (0, "field", "owner[2].address.city", -1), (0, "extra", "extra.Doc.1", 1), (0, "extra", "extra.Lone", 0),
    ])


def test_wrappers_and_broken_texts(spark):
    inner = '{"a": {"value": "1"}}'
    texts = [inner, f"[{inner}]", json.dumps(inner), f"﻿ {inner}", '{"consolidated_data": ' + inner + "}", inner[:-2], "", None, "null", "[]", inner + " x", "7"]
    assert nodes(spark, *texts) == [(i, "field", "a", -1) for i in range(5)]


def test_parent_links_and_values(spark):
    rows = flatten.flatten_records(records(spark, '{"owner": {"address": {"zip": {"value": "10", "confidence": "0.5", "review_required": true, "variants": [{"value": "11", "source_document_type": "t"}]}}}}')).collect()
    by = {r.kind: r for r in rows}
    assert by["field"].parent_path == "owner.address" and by["field"].value == "10" and by["field"].confidence == 0.5 and by["field"].review_required
    assert by["variant"].parent_path == "owner.address.zip" and by["variant"].source_document_type == "t"


def test_found_counts_redelivered_rows_once_and_takes_clashing_columns(spark):
    x = spark.createDataFrame([(1, [("f", "v", 1.0), None, ("g", "", None)], "p", -1), (1, [("f", "v", 1.0), None, ("g", "", None)], "p", -1), (2, None, "p", -1), (3, [], "p", -1)], f"extraction_id bigint, extra {EXTRA}, node_path string, item_no int")
    c = records(spark, '{"a": "b"}').withColumnRenamed("x", "y")
    found = sorted(map(tuple, flatten.found_nodes(c, x).collect()))
    assert found == [("consolidated_records", 0, "a", -1), ("extractions", 1, "extra", 0), ("extractions", 1, "extra", 2)]


def test_empty_tables(spark):
    x = spark.createDataFrame([], f"extraction_id bigint, extra {EXTRA}")
    assert flatten.found_nodes(records(spark).limit(0), x).count() == 0


def test_deep_and_long(spark):
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    long = json.dumps({"v": {"value": "x" * 2_000_000}})
    assert [r[:3] for r in nodes(spark, deep, long)] == [(1, "field", "v")]


def test_any_depth_of_wrapping():
    from packetflow.operators.flatten import _records

    text = wrapped = '{"a": "b"}'
    for _ in range(12):
        text = json.dumps(text)
        wrapped = '{"record": [%s]}' % wrapped
    assert _records(text) == _records(wrapped) == [{"a": "b"}]
