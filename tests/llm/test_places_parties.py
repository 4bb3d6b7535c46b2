import random

from packetflow.llm import parties as N, places as P
from packetflow.llm.components import components
from packetflow.llm.editing import osa
from packetflow.llm.parsing import address, firm_name, person_name, place

FV = "struct<value string, confidence double>"
ROLE = [f"{r}_address_{p}" for r in P.ROLES for p in ("street", "city", "state", "zip")]
NAMED = ["owner_full_name", "owner_license_or_entity_id", "owner_phone", "lienholder_name", "lienholder_id", "lienholder_phone", "dealership_name", "dealership_entity_id", "lessee_name"]
COLUMNS = ROLE + NAMED


def extractions(spark, *items):
    """items: (id, packet, {column: value})"""
    rows = [(i, p, *[None if (v := d.get(c)) is None else (v, 0.5) for c in COLUMNS], "clash", "clash") for i, p, d in items]
    return spark.createDataFrame(rows, "extraction_id bigint, packet_id bigint, " + ", ".join(f"{c} {FV}" for c in COLUMNS) + ", form string, location string")


def at(street, city=None, state=None, zip_=None, role="owner"):
    return {f"{role}_address_{p}": v for p, v in zip(("street", "city", "state", "zip"), (street, city, state, zip_))}


def clusters(pairs, keys):
    group = {k: k for k in keys}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in pairs:
        group[max(top(a), top(b))] = min(top(a), top(b))
    return {k: top(k) for k in keys}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(80)] + [(5000, 5001 + i) for i in range(60)] + [(6060, 6000 + i) for i in range(60)]
    shuffled = list(range(10_000, 10_101))
    rng.shuffle(shuffled)
    edges += list(zip(shuffled, shuffled[1:])) + [(20_000 + i, 20_001 + i) for i in range(100)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 8), (9, None)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(df).collect()}
    right = clusters([(a, b) for a, b in edges if a != b], {k for a, b in edges if a != b for k in (a, b)})
    assert found.keys() == right.keys() and len({(found[k], right[k]) for k in found}) == len({*right.values()}) == len({*found.values()})
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_parsing():
    assert address("98 Oak St, River Falls NJ 10704", None, None, None) == address("98 OAK STREET", "River Fls", "New Jersey", "10704-1234")
    assert address("UNIT 5B, 196 ELM BOULEVARD", "X", None, None).number == "196" and address("Elm Blvd 196 apt 2", "X", None, None).name == "ELM"
    assert address("Post Office Box 10", "A", "NJ", "1") == address("P.O. BOX 10", "a", "nj", "1") and address(None, "a", "b", "c") is None and address("n/a", None, None, None) is None
    assert address("1218 MEADOW CT", None, "NJ", None).kind == "COURT" and place("Ft. Lee Hgts") == "FORT LEE HEIGHTS"
    pool = frozenset({"WILLIAM", "ROSA", "MARGARET"})
    same = ["William R Moss", "MOSS, BILLY R", "Mr. William R. Moss", "moss william r"]
    assert len({person_name(n, pool) for n in same}) == 1 and person_name("Moss, Rosa JR", pool).suffix == "JR" and person_name("Cher", pool).given == ""
    towns = frozenset({"DOVER"})
    same = ["Acme Motor Credit of Dover, LLC", "The Acme Mtr Cr (Main Office)", "DOVER ACME MOTOR CREDIT INC ISAOA", "AC ME MOTOR CR. OF DOVER"]
    assert len({firm_name(n, "Dover", towns)[:1] + firm_name(n, "Dover", towns)[5:] for n in same}) == 1 and firm_name("LLC", None) is None


def place_pairs(spark, *items):
    return {(r.id_a, r.role_a, r.id_b, r.role_b) for r in P.found_places(extractions(spark, *items)).collect()}


def test_places(spark):
    items = [
        (1, 1, at("168 West Oak Road", "Dover", "NJ", "10012")), (2, 2, at("168 OAK RD, UNIT 4", "DOVER", "NJ", "10012")), (3, 3, at("168 west oak raod", None, None, None)), (4, 4, at("168 West Oak Road", "Dover", "NJ", "10012", "lessee")),
        (5, 5, at("168 West Oak Road", "Salem", "PA", "10777")), (6, 6, at("168 West Oak Lane", "Dover", "NJ", "10012")), (7, 7, at("169 West Oak Road", "Dover", "NJ", "10012")), (8, 8, at("168 W Oak Rd, Dover NJ 10102")), (9, 9, at("Oak 168", "Dover", "New Jersey")),
        (10, 10, at("PO Box 168", "Dover", "NJ", "10012")), (11, 11, at("box 168", "Dovr", None, "10012")), (12, 12, at(None, "Dover", "NJ", "10012")), (13, 13, at("N/A", "Dover")), (2, 2, at("168 OAK RD, UNIT 4", "DOVER", "NJ", "10012")),
    ]
    found = place_pairs(spark, *items)
    same = clusters([(a, c) for a, _, c, _ in found], range(1, 14))
    assert {k for k in same if same[k] == 1} == {1, 2, 4, 8} and same[9] == 9 and same[11] == 10 and same[3] == 3 and same[5] == 5 and same[6] == 6 and same[7] == 7
    assert (1, "owner", 4, "lessee") not in found and len(found) == 6  # 1 and 4 are written alike


def test_crowded_tokens_find_the_same(spark):
    """Splitting a token by what else must agree links what comparing its members links."""
    rng = random.Random(4)
    towns = ["".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(4)).upper() for _ in range(40)]
    rows = [(k, "MAIN", t, f"{10000 + 7 * i}") for i, t in enumerate(towns) for k in ("12", "14")] + [("12", "MAIN", t[:2] + "X" + t[3:], "") for t in towns[:15]] + [("12", "MAIN", "", f"{10000 + 7 * i}") for i in range(15, 25)] + [("12", "MAIM", towns[3], "10021"), ("12", "MAIN", "", ""), ("16", "ELM", "DOVER", "07801"), ("16", "ELM", "DOVRE", ""), ("16", "ELM", "", ""), ("BOX 9", "", "DOVER", ""), ("BOX 9", "", "DOVER", "07801")]
    df = spark.createDataFrame([(i, 1, 1, n, "", name, "STREET" if name else "", c, "", z) for i, (n, name, c, z) in enumerate(rows)], "id bigint, n bigint, n_name bigint, number string, direction string, name string, kind string, city string, state string, zip string")
    groups = lambda crowd: sorted(map(tuple, map(sorted, _sets(clusters([(r.a, r.b) for r in P.location_links(df, crowd).collect()], range(len(rows)))))))
    assert groups(2) == groups(10_000) and max(map(len, groups(2))) == 3


def _sets(labels):
    found = {}
    for k, v in labels.items():
        found.setdefault(v, []).append(k)
    return found.values()


def test_pairs_over_the_threshold_are_linked(spark):
    """Every pair that meets the threshold and agrees in town or zip ends in one location, crowded tokens or not."""
    rng = random.Random(9)
    towns = ["COAXOFIELD FALLS", "DOVER", "SALEM", "WEALILEY", "FORT LEE"]
    slip = lambda w: (lambda i: w[:i] + rng.choice(["", "X", w[i : i + 1] * 2]) + w[i + 1 :])(rng.randrange(len(w))) if w and rng.random() < 0.5 else w
    base = [(str(rng.randrange(1, 4)), "", n, "STREET", t, "NJ", f"{10000 + 777 * i}") for i, t in enumerate(towns) for n in ("TRAILHURST", "OAK", "ROWAN")] + [(f"BOX {k}", "", "", "", t, "NJ", f"{10000 + 777 * i}") for k in (1, 2) for i, t in enumerate(towns)]
    found = sorted({P.Address(n, d, slip(s), rng.choice([k, ""]), slip(c), rng.choice([st, ""]), rng.choice([slip(z), slip(z), ""])) for n, d, s, k, c, st, z in base * 12})
    found += [P.Address("216", "", "TRAILIHURST", "HIGHWAY", "COAXOFFIELD FALLS", "DE", "10784"), P.Address("216", "", "TTAILIHURST", "HIGHWAY", "COAXOFILED FALLS", "DE", "16784"), P.Address("BOX 8", "", "", "", "LAKE WUMOBY", "NY", ""), P.Address("BOX 8", "", "", "", "LAKE WUNOBY", "NY", "10876")]
    found += [P.Address("250", "", "QUARRY", "TURNPIKE", "DOVER", "NJ", "10178"), P.Address("250", "", "QURRY", "TURNPIKE", "DOVER", "NJ", "10173"), P.Address("250", "", "QARRY", "", "DOVER", "NJ", "10173")]
    df = spark.createDataFrame([(i, 1, 1, *a) for i, a in enumerate(found)], "id bigint, n bigint, n_name bigint, number string, direction string, name string, kind string, city string, state string, zip string")
    due = [(i, j) for j, b in enumerate(found) for i, a in enumerate(found[:j]) if (a.city and b.city or a.zip and b.zip) and P.contained(a, b) >= P.CONTAINED]
    assert len(due) > 400 and all(P.contained(a, b) == P.contained(b, a) for a in found[::7] for b in found)
    for crowd in (10_000, 2):
        label = clusters([(r.a, r.b) for r in P.location_links(df, crowd).collect()], range(len(found)))
        assert [p for p in due if label[p[0]] != label[p[1]]] == []


def test_town_and_zip_apart(spark):
    """Where nothing tells of the town in both, one location that fits is joined, one of several is not."""
    items = [("361", "GRANITE", "WEALILEY", ""), ("361", "GRANITE", "", "10194"), ("12", "MAIN", "DOVER", ""), ("12", "MAIN", "", "10777"), ("12", "MAIN", "SALEM", ""), ("12", "MAIN", "", ""), ("14", "MAIN", "DOVER", "07801"), ("14", "MAIN", "", "10777"), ("14", "MAIM", "", ""), ("16", "MAIN", "", "10777"), ("16", "MAIM", "", ""), ("18", "MAIN", "", ""), ("18", "MAIM", "", "")]
    df = spark.createDataFrame([(i, 1, 1, n, "", name, "", c, "", z) for i, (n, name, c, z) in enumerate(items)], "id bigint, n bigint, n_name bigint, number string, direction string, name string, kind string, city string, state string, zip string")
    for crowd in (10_000, 1):
        label = clusters([(r.a, r.b) for r in P.location_links(df, crowd).collect()], range(len(items)))
        assert [sorted(g) for g in _sets(label) if len(g) > 1] == [[0, 1], [9, 10], [11, 12]]


def test_no_places(spark):
    assert place_pairs(spark, (1, 1, {})) == set()
    assert P.found_places(extractions(spark, (1, 1, {})).limit(0)).count() == 0


def test_close_texts_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(3, 11))) for _ in range(250)]
    texts = {(("x", "y")[i % 2], t, rng.randrange(1, 9)) for i, t in enumerate(base + [b[:-1] + "z" for b in base[:60]])}
    texts = {(b, t): (b, t, n) for b, t, n in texts}.values()
    df = spark.createDataFrame(list(texts), "block string, text string, n bigint")
    found = {(r.block, r.text, r.other) for r in N.close_texts(df, cell=12).collect()}
    expected = set()
    for b1, t1, n1 in texts:
        for b2, t2, n2 in texts:
            if b1 == b2 and t1 != t2 and (n2, t1) > (n1, t2) and (lambda r: osa(t1, t2, r) <= r)(min(N._radius(t1), N._radius(t2))):
                expected.add((b1, t1, t2))
    # Levenshtein pivots bound plain edits; a swap of neighbours counts as two of them.
    assert found <= expected and {e for e in expected if lev(e[1], e[2]) <= min(N._radius(e[1]), N._radius(e[2]))} <= found


def lev(a, b):
    from packetflow.operators.edit import distance

    return distance(a, b)


def person(name, number=None, phone=None, street=None):
    return {"owner_full_name": name, "owner_license_or_entity_id": number, "owner_phone": phone, "owner_address_street": street}


def test_parties(spark):
    crowd = [(1000 + i, 5000 + i, person(f"William{' R' if i % 2 else ''} Stone{c}{c}", f"S{i:02d}345678901234")) for i, c in enumerate("abcdefgh")] + [(1100 + i, 5100 + i, person(f"Rosa Hill{c}{c}", f"H{i:02d}345678901234")) for i, c in enumerate("abcdefgh")]
    items = [
        (1, 1, person("William R Moss", "M12345678901234")), (2, None, person("MOSS, BILLY", "M123456789012344")), (3, 3, person("W. Moss", "M12345678901239")), (4, 4, person("William Mosss", "M12345678901234")),
        (5, 5, person("William Moss", "M99999999999999")), (6, 6, person("Rosa Moss", None, None, "9 Elm St")), (7, 7, person("William Mooss", None, "201-555-1234", "9 Elm St")), (8, 8, person("Bill Moss", None, "2015551234")),
        (9, 9, {"lienholder_name": "Acme Motor Credit of Dover, LLC"}), (10, 10, {"dealership_name": "The Acme Mtr Cr of Dover"}), (11, 11, {"lienholder_name": "Acme Motor Credit of Salem"}), (12, 12, {"lienholder_name": "Acme Auto Finance of Dover"}), (13, 13, {"owner_full_name": "ACME MOTOR CREDIT LLC", "owner_license_or_entity_id": "7654321"}),
        (14, 14, {"lienholder_name": "N/A"}), (15, 15, {"lienholder_name": " "}), (1, 1, person("William R Moss", "M12345678901234")), (16, 16, person("Rosa Lake JR", "L12345678901234", None, "1 Bay Rd")), (17, 17, person("Rosa Lake Sr", "L99945678901234", None, "1 Bay Road")),
    ]
    found = {(r.id_a, r.field_a, r.id_b, r.field_b) for r in N.found_parties(extractions(spark, *items, *crowd)).collect()}
    same = clusters([(a, c) for a, _, c, _ in found if a < 1000], range(1, 18))
    assert {k for k in same if same[k] == 1} == {1, 2, 3, 4} and same[5] == 5 and same[6] == 6 and same[8] == 7 and {k for k in same if same[k] == 9} == {9, 10} and same[11] == 11 and same[12] == 12 and same[13] == 13 and same[17] == 17
    assert all(a < 1000 for a, *_ in found)


def test_no_parties(spark):
    assert N.found_parties(extractions(spark, (1, 1, {})).limit(0)).count() == 0 and N.found_parties(extractions(spark, (1, None, {"lessee_name": "Ann Lee"}))).count() == 0


def test_close_texts_with_swaps_across_cells(spark):
    rng = random.Random(6)
    base = list({"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 10))) for _ in range(150)})
    swapped = []
    for t in base:
        i = rng.randrange(len(t) - 1)
        s = t[:i] + t[i + 1] + t[i] + t[i + 2 :]
        j = (i + 2) % (len(s) - 1)
        swapped += [s, s[:j] + s[j + 1] + s[j] + s[j + 2 :], s + "z"]
    texts = {t: rng.randrange(1, 9) for t in [*base, *swapped]}
    found = {(r.text, r.other) for r in N.close_texts(spark.createDataFrame([("x", t, n) for t, n in texts.items()], "block string, text string, n bigint"), cell=12).collect()}
    r = lambda a, b: min(N._radius(a), N._radius(b))
    assert found == {(a, b) for a in texts for b in texts if a != b and (texts[b], a) > (texts[a], b) and osa(a, b, r(a, b)) <= r(a, b)}
