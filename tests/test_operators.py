import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from packetflow.functions import scalars as S
from packetflow.operators import chunks, classification as C, consensus as V, entities as E, payload, raster, runs
from packetflow.operators.edit import distance
from packetflow.functions.refdata import FIELDS, profile_fields

DOC = "struct<id string, name string, type string, pages array<int>>"
PACKETS = f"packet_id bigint, classified array<{DOC}>, empty_pages array<int>, total_pages int, missing string"


def packets(spark, *items):
    return spark.createDataFrame([(i, docs, empty, n, "clash") for i, (docs, empty, n) in enumerate(items)], PACKETS)


def doc(*pages, name="D", type="other", id="d"):
    return (id, name, type, list(pages))


def test_page_coverage(spark):
    found = C.page_coverage(packets(spark, ([doc(1, 2), doc(3)], [4], 5), ([doc(1, 2), doc(2)], [], 2), ([doc(1, 1, 9, 0)], None, 1), (None, None, 2), ([], [], None), ([doc(1), None], [None, 2], 2))).orderBy("packet_id").collect()
    assert [(r.missing, r.duplicate, r.invalid, r.is_complete) for r in found] == [([5], [], [], False), ([], [2], [], False), ([], [1], [0, 9], False), ([1, 2], [], [], False), ([], [], [], False), ([], [], [], True)]


def test_contiguity(spark):
    found = C.contiguity_conflicts(packets(spark, ([doc(3, 11), doc(6, 8)], [], 12), ([doc(4, 6, 7)], [5], 9), ([doc(1, 5), doc(3)], [3], 5))).collect()
    assert [(r.packet_id, r.doc_ord, r.conflicting) for r in found] == [(0, 0, [6, 8])]
    assert [r.is_contiguous for r in C.validity(packets(spark, ([doc(1, 3), doc(2)], [], 3), ([doc(1)], [], 1))).orderBy("packet_id").collect()] == [False, True]


def test_blank_documents_become_empty_pages(spark):
    r = C.normalized(packets(spark, ([doc(3, 1, name="Blank page"), doc(2, name="Seperator"), doc(5, 4, name=None)], [7, 3], 7))).first()
    assert r.empty_pages == [1, 2, 3, 7] and [d.pages for d in r.classified] == [[4, 5]]


def test_recovery(spark):
    p = packets(spark, ([doc(1, 2), doc(6)], [3, 4, 9], 9), ([doc(5)], [2], 5), ([], [1], 1), ([doc(), doc(3)], [1], 3))
    targets = {(r.packet_id, r.page_no): r.doc_ord for r in C.recovery_targets(p).collect()}
    assert targets == {(0, 3): 0, (0, 4): 0, (0, 9): 1, (1, 2): 0, (2, 1): None, (3, 1): 1}
    chain = sorted(map(tuple, C.recovered(p, F.col("empty_pages")).collect()))
    assert chain == [(0, 3, 0), (0, 4, 0), (0, 9, 1), (1, 2, 0), (3, 1, 1)]


def test_file_names(spark):
    p = packets(spark, ([doc(name=n) for n in ("A", "A_2", "A", "A", "Check #123 / Payment!", "  ", None, "Título é")], [], 1))
    names = [r.file_name for r in C.unique_file_names(p).orderBy("doc_ord").collect()]
    assert names == ["A", "A_2", "A_3", "A_4", "Check_123_Payment", "document", "document_2", "Titulo_e"]


def test_modes_and_skips(spark):
    d = C.documents(packets(spark, ([doc(type=t) for t in ("driver_license", "dealer_invoice", "other", None, "odd", "cover_letter")], [], 1)))
    assert [r["mode"] for r in C.modes(d).orderBy("doc_ord").collect()] == ["embedded_card", "full_page_form", "default", "default", "default", "full_page_form"]
    assert C.processable(d, ("cover_letter",)).count() == 5 and C.excluded(d, ("cover_letter",)).count() == 1


def test_classification_of_an_empty_table(spark):
    none = packets(spark, ([], [], 1)).limit(0)
    assert C.page_coverage(none).count() == C.validity(none).count() == C.unique_file_names(none).count() == 0


VOTES = "variant_id bigint, packet_id bigint, field_name string, value string, confidence double, source_document_name string, source_document_type string, key string"


def votes(spark, *items, field="vehicle_make"):
    return V.variants(spark.createDataFrame([(i, 1, field, v, c, f"n{i}", t, "clash") for i, (v, c, t) in enumerate(items)], VOTES))


def scored(spark, *items):
    counts = V.values(votes(spark, *items))
    return V.scored(counts, V.plurality(counts)).first()


def test_confidence(spark):
    assert scored(spark, ("A", 0.4, "t"))[2:] == ("A", 0.4, True)
    r = scored(spark, ("ABCDEFGH", 0.9, "t"), ("abcdefgh ", 0.8, "t"), ("ABCDEFGX", 0.5, "t"), ("ZZZ", 0.9, "t"), (None, 0.9, "t"), ("", 0.9, "t"), ("Q", None, "t"))
    base = 0.65 * 0.9 + 0.35 * 0.85
    expected = base * (0.85 + 0.15 * 2 / 3) * (1 - 0.35 * 0.125 * (0.5 / 3.1)) * 1.04 * 1.03
    assert r.consensus == "ABCDEFGH" and abs(r.confidence - round(expected, 4)) < 1e-9 and not r.review_required
    assert scored(spark, ("A", 0.9, "t"), ("B", 0.9, "t")).review_required


def test_vin_and_primary(spark):
    v = votes(spark, ("1M8GDM9AXKP042788", 0.4, "x"), ("1M8GDM9AXKP042788", 0.4, "x"), ("1M8GDM9AXKP0427889", 0.99, "x"), ("9M8GDM9A-XKP042788", 0.5, "manufacturer_certificate"), field="vehicle_vin")
    assert V.vin_consensus(v).first().vin == "1M8GDM9AXKP042788"
    assert tuple(V.primary_source(v).first())[2:] == ("9M8GDM9AXKP042788", False)
    assert tuple(V.primary_source(votes(spark, ("ABC", 0.5, "manufacturer_certificate"))).first())[2:] == ("ABC", True)


def test_aligned_consensus():
    assert V.aligned_consensus([("AAA", 0.1), ("BBB", 0.95)]) == "BBB"
    assert V.aligned_consensus([("Main Street", 0.6), ("Main Stret", 0.5), ("Main Street", 0.4)]) == "Main Street"
    assert V.aligned_consensus([]) is None and V.aligned_consensus([(" ", 1.0)]) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ABC-", min_size=1, max_size=6), st.floats(0.01, 1)), min_size=1, max_size=5))
def test_aligned_consensus_is_a_reading(readings):
    kept = [v for v, _ in readings if v.strip()]
    assert not kept or V.aligned_consensus(readings) in {" ".join(v.split()) for v in kept}


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_distance(a, b):
    full = lambda a, b: len(a) + len(b) if not a or not b else min(full(a[1:], b) + 1, full(a, b[1:]) + 1, full(a[1:], b[1:]) + (a[0] != b[0]))
    assert distance(a, b) == full(a, b)


def extractions(spark, *items):
    schema = "extraction_id bigint, packet_id bigint, document_type string, source_document_name string, extra array<struct<field_name string, value string, confidence double>>, " + ", ".join(f"{f} struct<value string, confidence double>" for f in FIELDS)
    return spark.createDataFrame([(i, 1, t, n, x, *[fs.get(f) for f in FIELDS]) for i, t, n, x, fs in items], schema)


def test_hypotheses(spark):
    x = extractions(spark, (1, "odometer_disclosure", "n", [("a", "b", 1.5), None, ("a", " ", 0.5)], {"vehicle_vin": (" V ", 1.5), "owner_full_name": ("no", 0.5), "vehicle_make": ("M", None), "vehicle_year": (" ", 0.5)}), (2, None, "n", None, {"owner_full_name": ("yes", -1.0)}))
    x = x.unionByName(x)
    assert sorted((r.extraction_id, r.field, r.value, r.confidence) for r in payload.hypotheses(x).collect()) == [(1, "vehicle_vin", "V", 1.0), (2, "owner_full_name", "yes", 0.0)]
    assert [(r.extraction_id, r.item_no, r.confidence) for r in payload.extra_items(x).collect()] == [(1, 0, 1.0)]
    assert len(profile_fields()) == len(set(profile_fields()))


def test_entity_source(spark):
    a = {"owner_full_name": ("X", 0.9), "owner_address_street": ("s", 0.9), "owner_address_city": ("c", 0.9)}
    x = extractions(spark, (1, "dealer_invoice", "inv", None, {"owner_full_name": ("Y", 1.0)}), (2, "universal_title_application", "uta", None, a), (3, "other", "o", None, a | {"owner_address_zip": ("z", 1.0)}))
    readings = E.entity_readings(payload.hypotheses(x))
    assert E.entity_source(readings).first().source_document_name == "uta"
    assert E.entity_values(E.entity_source(readings)).count() == 3


def test_scalars(spark):
    df = spark.createDataFrame([("$1,873.53", "0000001", "John Smith, Jr.", "1/2/31", "yes"), ("TAX SATISFIED 5", "12x", "", "01-02-1999", "?"), (None, None, None, None, None)], "a string, b string, c string, d string, e string")
    got = df.select(S.money_amount(F.col("a")), S.odometer_text(F.col("b")), S.last_name(F.col("c")), S.date_parts(F.col("d")), S.truthy(F.col("e"))).collect()
    assert tuple(got[0]) == (1873.53, "1", "SMITH", ("01", "02", "1931"), True) and tuple(got[1]) == (None, "12x", None, ("01", "02", "1999"), None) and tuple(got[2]) == (None,) * 5
    assert [r[0] for r in spark.range(3).select(S.backoff_seconds(F.col("id").cast("double"), 1.0, F.lit(True))).collect()] == [3.0, 6.0, 12.0]


def test_chunks(spark):
    sizes = [500, 600, 900, 5000, 1, None, 1999]
    parts = spark.createDataFrame([(g, i, s) for g in (1, 2) for i, s in enumerate(sizes)] + [(None, 9, 1)], "g bigint, o bigint, s bigint")
    found = {(r.group_id, r.part_id): r.chunk_no for r in chunks.greedy_chunks(parts, "g", "o", "s", 2000).collect()}
    assert [found[1, i] for i in range(7)] == [found[2, i] for i in range(7)] == [1, 1, 1, 2, 3, 3, 3]


def test_runs(spark):
    p = spark.createDataFrame([(1, "a/x.pdf", "ok", None, 2), (2, "b/x.PDF", None, "e", None), (3, "c.txt", "ok", None, 1)], "packet_id bigint, pdf_path string, run_status string, run_error string, total_pages int")
    assert [r.packet_id for r in runs.pending(p, p.filter("packet_id = 1")).collect()] == [2]
    assert {tuple(r) for r in runs.run_summary(p).collect()} == {("ok", 2, 3, 0), ("unknown", 1, 0, 1)}
    assert [tuple(r) for r in runs.shared_stems(p).collect()] == [("x", 2)]


def test_raster(spark):
    page = np.full((200, 160), 255, np.uint8)
    assert raster.content_score(page) == 0 and raster.is_blank_scan(page)
    page[50:90, 40:100] = 20
    assert raster.content_score(page) > raster.CONTENT_SHARE and not raster.is_blank_scan(page)
    assert raster.content_box(page, keep=0.1)[0] < 50 and raster.border_ink(page) == 0
    speck = np.full((100, 100), 255, np.uint8)
    speck[5, 5] = 0
    assert raster.content_score(speck) < raster.CONTENT_SHARE
    images = spark.createDataFrame([(1, 1, 200, 160, bytearray(page.tobytes())), (1, 2, 5, 5, bytearray(b"x")), (1, 3, 5, 5, None)], "packet_id bigint, page_no int, height int, width int, data binary")
    assert [r.is_blank for r in raster.page_scores(images).orderBy("page_no").collect()] == [False, None, None]
