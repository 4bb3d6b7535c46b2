from hypothesis import given, settings, strategies as st

from packetflow.llm import canonical as C
from packetflow.llm.editing import deletion_keys, osa

SCHEMA = "extraction_id bigint, " + ", ".join(f"{f} struct<value string, confidence double>" for f in C.FIELDS) + ", raw_value string, token string"
REF = "canonical_id int, field_name string, canonical string, also_known array<string>, n int"


def reference(spark):
    rows = [(1, "vehicle_color", "BLACK", ["OBSIDIAN"], 0), (2, "vehicle_color", "BLUE", None, 0), (3, "vehicle_color", "RED", [None], 0), (4, "vehicle_color", "GREEN", [], 0), (5, "plate_type", "NEW PLATES", ["NEW TAGS"], 0), (6, "plate_type", "TRANSFER PLATES", [], 0), (7, "plate_type", "DEALER", [], 0), (8, None, "X", [], 0), (9, "vehicle_color", None, None, 0)]
    return spark.createDataFrame(rows, REF)


def mapped(spark, field, *values):
    fv = lambda v: None if v is None else (v, 0.5)
    rows = [(i, *[fv(v) if f == field else None for f in C.FIELDS], "clash", "clash") for i, v in enumerate(values)]
    found = C.map_values(spark.createDataFrame(rows, SCHEMA), reference(spark)).collect()
    assert len(found) == len({(r.field_name, r.raw_value) for r in found})
    return {r.raw_value: r.canonical_id for r in found}


def test_colors(spark):
    right = {"black": 1, "BLACK METALLIC": 1, "Midnight Black": 1, "Midnight Red": 3, "MIDNIGHT BLUE": 2, "BLCK": 1, "Blc.": 1, "B1ACK": 1, "OBSIDINA": 1, "BULE": 2, "Bluish": 0, "BLUEISH": 2, "negro": 1, "rojo": 3, "x" * 50_000: 0, "SEE INVOICE": 0, "D44-KQZ": 0, "  GREEN ": 4, "GREEN": 4}
    found = mapped(spark, "vehicle_color", *right, None, "", "   ", "black")
    right.pop("Bluish"), found.pop("Bluish")
    assert found == right


def test_plates(spark):
    right = {"NEW PLATES": 5, "NE WPLATES": 5, "1 SET NEW PLATES": 5, "Request Transfer Plates": 6, "Request Dealer": 7, "Nw Plts.": 5, "NW": 5, "ask dealer": 0, "PLATES": 0, "move plates": 6, "?": 0}
    assert mapped(spark, "plate_type", *right) == right


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.map_values(none, reference(spark)).count() == 0
    one = spark.createDataFrame([(1, ("RED", 0.5), None, None, None, "", "")], SCHEMA)
    assert [r.canonical_id for r in C.map_values(one, reference(spark).limit(0)).collect()] == [0]


def brute(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(0, 4))
def test_distance_and_keys(a, b, most):
    d = brute(a, b)
    assert osa(a, b, most) == min(d, most + 1)
    if d <= 2:
        assert deletion_keys(a, 2) & deletion_keys(b, 2)


def test_three_edits_of_long_words(spark):
    rows = [(1, "plate_type", "COMMERCIAL", [], 0), (2, "plate_type", "DUPLICATE", [], 0), (3, "plate_type", "DEALER", [], 0)]
    tokens = spark.createDataFrame([("plate_type", t) for t in ("CUMMARCEAL", "DAPLOCUTE", "CUMMARCEOL", "DOALOR")], "field_name string, token string")
    vocabulary = C._vocabulary(C.reference_names(spark.createDataFrame(rows, REF)), {})
    found = {(r.token, r.word) for r in C.repaired_tokens(tokens, vocabulary).collect()}
    assert found == {("CUMMARCEAL", "COMMERCIAL"), ("DAPLOCUTE", "DUPLICATE"), ("DOALOR", "DEALER")}
    field = C.map_values(spark.createDataFrame([(1, None, None, None, ("cummarceal", 0.5), "", "")], SCHEMA), spark.createDataFrame(rows, REF))
    assert [r.canonical_id for r in field.collect()] == [1]
