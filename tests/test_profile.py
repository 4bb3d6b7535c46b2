import random
from statistics import median

from pyspark.sql import functions as F

from packetflow.operators import profile as P

SCHEMA = "extraction_id bigint, feed_id int, load_no int, load_id bigint, " + ", ".join(f"{f} struct<value string, confidence double>" for f in P.FIELDS) + ", value string, number string"


def rows(spark, items):
    """items: (id, feed, load, vin, odometer, price, dob)"""
    fv = lambda v: None if v is None else (v, 0.5)
    return spark.createDataFrame([(i, f, n, f * 100 + n, *map(fv, vs), "clash", "clash") for i, f, n, *vs in items], SCHEMA)


def bad(spark, column, values):
    items = [(i, 0, 1, *[v if c == column else None for c in range(4)]) for i, v in enumerate(values)]
    return sorted(r.extraction_id for r in P.malformed_rows(rows(spark, items)).collect())


def test_vin(spark):
    good = ["1M8GDM9AXKP042788", "1m8gdm9axkp042788", "1M8GDM9A-XKP042788", " 1M8GDM9AXKP042788 ", None, "", "  "]
    assert bad(spark, 0, [*good, "1M8GDM9A1KP042788", "1M8GDM9AXKP04278", "1M8GDM9AXKPO42788", "SEE ATTACHED"]) == [7, 8, 9, 10]


def test_odometer(spark):
    good = ["0", "12", "1,234", "123,456 mi", "5MILES", "7 km", "499999", "000012"]
    assert bad(spark, 1, [*good, "500000", "1,23", "12  mi", "1k", "-5", "12.5", "1234,567", "9" * 400]) == list(range(8, 16))


def test_price(spark):
    good = ["500", "$500", "$ 1,234.50", "400000.00", "2500"]
    assert bad(spark, 2, [*good, "499.99", "400000.01", "$", "1,2345", "12.5", "$  700", "CALL"]) == list(range(5, 12))


def test_dob(spark):
    good = ["01/31/1950", "2009-12-31", "02/29/2000"]
    assert bad(spark, 3, [*good, "02/29/2001", "13/01/1980", "1/2/1980", "1924-12-31", "2010-01-01", "00/00/0000"]) == list(range(3, 9))


def test_loads_against_brute_force(spark):
    rng = random.Random(3)
    items, n = [], 0
    for load in range(1, 7):
        for _ in range(60):
            n += 1
            odo = str(rng.randrange(1000 * load ** (3 if load == 4 else 1)) ) if rng.random() < (0.2 if load == 5 else 0.9) else rng.choice([None, "", "TMU"])
            vin = "1M8GDM9AXKP042788" if load == 3 and rng.random() < 0.5 else str(n)
            items.append((n, 0, load, vin, odo, None, None))
    found = {(r.field_name, r.key_id) for r in P.found_quality(rows(spark, items)).filter("scope = 'load'").collect()}
    expected = set()
    for column, field in ((3, "vehicle_vin"), (4, "odometer_reading")):
        stats = {}
        for load in range(1, 7):
            vs = [i[column] for i in items if i[2] == load]
            filled = [v for v in vs if v]
            numbers = [float(v) for v in filled if v.isdigit()] if field == "odometer_reading" else []
            stats[load] = (len(vs), len(filled), max(map(filled.count, filled), default=0), numbers)
        for load in range(2, 7):
            (n1, f1, m1, k1), (n0, f0, m0, k0) = stats[load], stats[load - 1]
            a, b = f1 / n1, f0 / n0
            if a > 2 * b or a < b / 2 or min(f1, f0) >= 20 and abs(m1 / f1 - m0 / f0) > 0.15 or min(len(k1), len(k0)) >= 20 and (median(k1) > 1.5 * median(k0) or median(k1) < median(k0) / 1.5):
                expected.add((field, load))
    assert found == expected and expected


def test_medians_are_exact(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 50):
        numbers = [rng.randrange(400_000) for _ in range(n)]
        profile = P.load_profile(P.value_counts(rows(spark, [(i, 0, 1, None, str(v), None, None) for i, v in enumerate(numbers)])))
        assert profile.filter("field_name = 'odometer_reading'").first()["median"] == median(numbers)


def test_empty_table_repeats_and_stability(spark):
    assert P.found_quality(rows(spark, []).limit(0)).count() == 0
    twice = rows(spark, [(1, 0, 1, "X", None, None, None), (1, 0, 2, "X", None, None, None)])
    assert P.malformed_rows(twice).count() == 1
    shifted = rows(spark, [(i, 0, 1 + i // 50, "AB" if i < 50 else "12", None, None, None) for i in range(100)])
    psi = P.stability_index(P.value_counts(shifted)).filter("field_name = 'vehicle_vin'").first().psi
    same = rows(spark, [(i, 0, 1 + i // 50, "AB", None, None, None) for i in range(100)])
    assert psi > 1 and abs(P.stability_index(P.value_counts(same)).agg(F.max("psi")).first()[0]) < 1e-9


def test_stability_sees_values_behind_one_shape(spark):
    rng = random.Random(8)
    items = []
    for i in range(200):
        late = i >= 100
        odo, year, tail = rng.randrange(10_000, 40_000), rng.randrange(1940, 1960), i if not late or i % 2 else 0
        items.append((i, 0, 1 + late, f"VIN{tail:05d}", str(odo * (2 if late else 1)), None, f"01/01/{year + 30 * late}"))
    found = {r.field_name: r for r in P.stability_index(P.value_counts(rows(spark, items))).collect()}
    assert all(found[f].psi > 1 for f in ("vehicle_vin", "odometer_reading", "driver_dob")) and all(abs(r.psi_shape) < 1e-9 for r in found.values())
    assert abs(found["purchase_price"].psi) < 1e-9


def test_ranges_are_of_numbers_and_dates(spark):
    items = [(i, 0, 1, None, odo, None, dob) for i, (odo, dob) in enumerate([("9", "12/31/1950"), ("1,000", "1960-01-01"), ("80 mi", "01/01/1970"), ("TMU", "1900-01-01")])]
    found = {r.field_name: r for r in P.load_profile(P.value_counts(rows(spark, items))).collect()}
    assert (found["odometer_reading"].min_number, found["odometer_reading"].max_number) == (9, 1000)
    assert (str(found["driver_dob"].min_date), str(found["driver_dob"].max_date)) == ("1950-12-31", "1970-01-01")
