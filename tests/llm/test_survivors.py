import datetime

from packetflow.llm import survivors as S

VARIANTS = "variant_id bigint, packet_id bigint, field_name string, value string, confidence double, source_document_type string, document_date date, trust int, types string"
TYPES = "type_id string, trust int, value string"


def types(spark):
    return spark.createDataFrame([("top", 100, ""), ("mid", 50, ""), ("low", 5, "")], TYPES)


def survive(spark, field, *items):
    day = lambda d: None if d is None else datetime.date(2025, 1, d)
    rows = [(i, 1, field, v, c, t, day(d), 0, "") for i, (v, c, t, d) in enumerate(items)]
    found = [(r.field_name, r.value_norm) for r in S.found_survivors(spark.createDataFrame(rows + rows, VARIANTS), types(spark)).collect()]
    return [v for _, v in found]


def test_trust(spark):
    votes = [("CORVATNTA", 0.94, "mid", 1)] * 2
    assert survive(spark, "vehicle_make", *votes, ("Corvanta ", 0.79, "top", 1)) == ["CORVANTA"]
    assert survive(spark, "vehicle_make", *votes, ("X", 0.29, "top", 1), ("N/A", 0.9, "top", 1), ("Y", 0.9, None, 1)) == ["CORVATNTA"]
    assert survive(spark, "vehicle_vin", ("1-a b", 0.9, "top", 1), ("zz", 0.9, "mid", 1)) == ["1AB"]


def test_dates_and_ties(spark):
    assert survive(spark, "odometer_reading", ("5", 0.9, "top", 1), ("7", 0.5, "low", 9), ("8", 0.9, "top", None)) == ["7"]
    assert survive(spark, "odometer_reading", ("5", 0.5, "top", 1), ("7", 0.9, "top", 1)) == ["7"]
    assert survive(spark, "odometer_reading", ("5", 0.5, "top", 1), ("7", 0.5, "top", 1)) == ["7"]


def test_names(spark):
    assert survive(spark, "owner_full_name", ("W. Moss", 0.98, "top", 1), ("Wanda Olga Moss", 0.71, "low", 1), ("WANDA MO", 0.97, "mid", 1), ("Wanda O Moss", 0.9, "mid", 1)) == ["WANDA OLGA MOSS"]
    assert survive(spark, "owner_full_name", ("OWNER: Ann Lee", 0.5, "top", 1), ("Ann Leee", 0.4, "top", 1), ("Ann Lee & Bob", 0.5, "mid", 1), ("Ann  Lee", 0.8, "low", 1)) == ["ANN LEE"]


def test_no_contradiction_no_row(spark):
    assert survive(spark, "vehicle_make", ("A", 0.9, "top", 1), (" a ", 0.5, "low", 1), (None, 0.9, "top", 1), ("", 0.9, "top", 1)) == []
    assert survive(spark, "vehicle_make", ("A", 0.1, "top", 1), ("TBD", 0.9, "low", 1)) == []
    assert S.found_survivors(spark.createDataFrame([], VARIANTS), types(spark)).count() == 0


def test_reliability_settles_on_the_type_that_wins(spark):
    rows = [(i * 10 + k, i, "other_field", "right" if t != "low" else "wrong", 0.9, t, None, 0, "") for i in range(30) for k, t in enumerate(("top", "mid", "low"))]
    found, moves = S.reliabilities(S.readings(spark.createDataFrame(rows, VARIANTS), types(spark)))
    assert found.of["other_field", "mid"] > 0.9 > 0.1 > found.of["other_field", "low"] and moves[-1] < S.SETTLED


def test_votes_decide(spark):
    """Two types of equal trust: the one that agrees with the rest elsewhere is believed where the two stand alone."""
    same = spark.createDataFrame([("top", 100, ""), ("mid", 100, ""), ("low", 5, "")], TYPES)
    rows = [(i * 10 + k, i, "vehicle_make", v, 0.8, t, None, 0, "") for i in range(20) for k, (t, v) in enumerate((("top", "Z"), ("mid", "A"), ("low", "A")))] + [(901, 99, "vehicle_make", "Z", 0.8, "top", None, 0, ""), (902, 99, "vehicle_make", "A", 0.8, "mid", None, 0, "")]
    out = {(r.packet_id, r.value_norm) for r in S.found_survivors(spark.createDataFrame(rows, VARIANTS), same).collect()}
    assert out == {(i, "A") for i in [*range(20), 99]}
    # Readings of one level are counted, not only the surest of each type.
    assert survive(spark, "vehicle_make", ("A", 0.9, "top", 1), ("B", 0.6, "top", 1), ("b", 0.6, "top", 2)) == ["B"]


def test_monotone():
    assert S.monotone([(0.5, 1.0), (0.1, 1.0), (0.9, 2.0), (0.8, 2.0)]) == [0.3, 0.3, 0.8500000000000001, 0.8500000000000001] and S.monotone([]) == []
