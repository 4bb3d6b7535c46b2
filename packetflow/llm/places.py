"""Addresses that denote the same location (p6).

Set-containment join. Addresses are parsed into components (units left out) and made distinct; each is a set of tokens
that pair the house or box number with another component (street name, town, zip). An address is indexed under its
tokens and under those of other addresses that it may misspell, and a pair counts when the weighted components of the
barer address are contained in the fuller one (misspellings count in part) and no component contradicts. The links make
locations by connected components. Where an address leaves open what tells locations apart (ROAD or LANE), or nothing
tells of the town in both (a town here and a zip there, or neither), it is linked only where one location fits.

Results for odd input: a null or placeholder street, or one without house and box number, is no address; null, empty and
unreadable other parts are missing and contradict nothing; repeated rows are one entry; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from packetflow.functions.text import squeeze_upper
from packetflow.llm.components import components
from packetflow.llm.editing import deletion_keys, osa
from packetflow.llm.parsing import Address, address
from packetflow.session import cut_lineage, spread

ROLES = ("owner", "lienholder", "dealership", "lessee")
#: Weights of the components in the containment, and the share that must be contained.
WEIGHTS = {"name": 3.0, "city": 2.0, "zip": 2.0, "state": 0.5, "kind": 1.0, "direction": 0.5}
CONTAINED = 0.7
#: Addresses from which a token is split by what else must agree.
CROWD = 500
#: A street name on that many house and town pairs, and on this share of the pairs of a similar one, is a name of its own.
COMMON_NAME, COMMON_SHARE = 8, 0.05
PARTS = ("number", "direction", "name", "kind", "city", "state", "zip")


def entries(extractions: DataFrame, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """(extraction_id, role, street, city, state, zip, form): each address once; form is its normalized text."""
    part = lambda r, p: F.col(f"{r}_address_{p}.value")
    one = F.array(*[F.struct(F.lit(r).alias("role"), *[part(r, p).alias(p) for p in ("street", "city", "state", "zip")]) for r in roles])
    rows = extractions.select("extraction_id", F.explode(one).alias("a")).select("extraction_id", "a.*").filter("street is not null")
    rows = rows.dropDuplicates(["extraction_id", "role"])
    return rows.withColumn("form", F.concat_ws("\x1f", *[F.coalesce(squeeze_upper(p), F.lit("")) for p in ("street", "city", "state", "zip")]))


def parsed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the components of street, city, state, zip; rows that are no address are left out."""
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + [f"{p} string" for p in PARTS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            none = lambda v: v if isinstance(v, str) else None
            found = [address(none(s), none(c), none(t), none(z)) for s, c, t, z in zip(b.street, b.city, b.state, b.zip)]
            at = [i for i, a in enumerate(found) if a]
            out = b[keep].iloc[at].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame([found[i] for i in at], columns=PARTS, dtype=object)], axis=1)

    return rows.select(*keep, "street", "city", "state", "zip").mapInPandas(run, schema)


def _near(a: str, b: str) -> float:
    """1 for equal, less for a misspelling, 0 for different words."""
    if a == b:
        return 1.0
    most = 0 if min(len(a), len(b)) < 4 else 1 if min(len(a), len(b)) < 6 else 2
    d = osa(a, b, most)
    return 1 - 0.2 * d if d <= most else 0.0


def contained(bare: Address, full: Address, common: tuple[int, int] = (0, 0)) -> float:
    """Weighted share of the barer address found in the fuller one; 0 when a component contradicts."""
    if bare.number != full.number:
        return 0.0
    got = whole = 0.0
    likeness = {}
    for part, weight in WEIGHTS.items():
        a, b = getattr(bare, part), getattr(full, part)
        if not a or not b:
            continue
        if part == "zip":
            like = 1.0 if a == b else 0.6 if osa(a, b, 1) <= 1 else 0.0
        else:
            like = _near(a, b)
        if like == 0 and part not in ("city", "zip"):
            return 0.0
        likeness[part] = like
        whole += weight
        got += weight * like
    if 0 < likeness.get("name", 1) < 1 and min(common) >= max(COMMON_NAME, COMMON_SHARE * max(common)):
        return 0.0
    if likeness.get("city") == 0 and likeness.get("zip", 0) < 1 or likeness.get("zip") == 0 and likeness.get("city", 0) < 0.7:
        return 0.0
    if not likeness.keys() & {"name", "city", "zip"}:
        return 0.0
    return got / whole if whole else 0.0


def _edits(word: str, label: str = "") -> int:
    return 1 if label == "z" else 0 if len(word) < 4 else 1 if len(word) < 6 else 2


def _grouped(batches: Iterator[pd.DataFrame], key: str, columns: list[str], work) -> Iterator[list]:
    """work of the rows of each key, of rows sorted by it, in lists as long as a batch is."""
    held, last = [], None
    for b in batches:
        out: list = []
        for k, *row in zip(b[key], *[b[c] for c in columns]):
            if k != last and held:
                out += work(held)
                held = []
            last = k
            held.append(row)
        yield out
    yield work(held) if held else []


def _near_words(words: DataFrame) -> DataFrame:
    """(label, number, word, other): different words (label, number, word, n) of one number that count as misspelled; other is
    the more frequent, then the smaller. Words within the allowed edits share a text left by deletions, so also how it begins."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sorted({k[:4] for k in deletion_keys(w[: 4 + _edits(w, x)], _edits(w, x))}) for x, w in zip(b.label, b.word)]
            out = b.iloc[[at for at, ks in enumerate(found) for _ in ks]].reset_index(drop=True)
            out["key"] = pd.Series([f"{x}|{y}|{k}" for x, y, ks in zip(b.label, b.number, found) for k in ks], dtype=object)
            yield out

    def near(held: list) -> list:
        return [(label, number, a, b) for label, number, a, n in held for _, _, b, m in held if (m, a) > (n, b) and osa(a, b, most := min(_edits(a, label), _edits(b, label))) <= most]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _grouped(batches, "key", ["label", "number", "word", "n"], near):
            yield pd.DataFrame(out, columns=["label", "number", "word", "other"], dtype=object)

    several = words.groupBy("label", "number").agg(F.count("*").alias("words")).filter("words > 1").drop("words")
    keyed = words.join(several, ["label", "number"]).select("label", "number", "word", "n").mapInPandas(keys, "label string, number string, word string, n bigint, key string")
    return spread(keyed, "key").sortWithinPartitions("key").mapInPandas(run, "label string, number string, word string, other string").distinct()


def _with_near(keyed: DataFrame) -> DataFrame:
    """Rows (label, number, word, ...) once more under each word that is more frequent there and that theirs may misspell."""
    near = cut_lineage(_near_words(keyed.groupBy("label", "number", "word").agg(F.count("*").alias("n"))))
    return keyed.unionByName(keyed.join(near, ["label", "number", "word"]).withColumn("word", F.col("other")).drop("other"))


def _indexed(addresses: DataFrame) -> DataFrame:
    """Addresses with label and token: n with the street's name, c and z with town and zip, which only addresses without a
    name and those of their number need; each under its own word and under the more frequent ones that it may misspell."""
    beside = addresses.join(addresses.filter("name = ''").select("number").distinct(), "number", "left_semi")
    keyed = [df.filter(F.col(part) != "").select(F.lit(label).alias("label"), F.col(part).alias("word"), "id", "n", "n_name", *PARTS) for df, label, part in ((addresses, "n", "name"), (beside, "c", "city"), (beside, "z", "zip"))]
    return _with_near(keyed[0].unionByName(keyed[1])).unionByName(keyed[2]).withColumn("token", F.concat_ws("|", "label", "number", "word")).drop("word")


def _refined(hot: DataFrame) -> DataFrame:
    """Members of crowded street tokens under the token with what else must agree: the town or the zip, misspelled as far as
    is allowed."""
    keyed = [hot.filter(F.col(part) != "").select(F.lit(label).alias("label"), F.col("number").alias("own"), F.col("token").alias("number"), F.col(part).alias("word"), "id", "n_name", *PARTS[1:]) for label, part in (("c", "city"), ("z", "zip"))]
    found = _with_near(keyed[0].unionByName(keyed[1])).withColumn("token", F.concat_ws("|", "number", "label", "word"))
    return found.select("token", F.lit("n").alias("label"), "id", "n_name", F.col("own").alias("number"), *PARTS[1:])


def _agree(members: DataFrame) -> DataFrame:
    """(a, b, score): pairs of the members (token, label, id, n_name, components) of a token that fit each other, in town or
    zip among the rest."""

    def work(held: list) -> list:
        members_, out = [(i, k, Address(*ps)) for _, i, k, *ps in held], []
        named = held[0][0] == "n"
        for at, (i, k, a) in enumerate(members_):
            for j, m, b in members_[:at]:
                if (a.city and b.city or a.zip and b.zip) and (named or not a.name or not b.name) and (score := contained(a, b, (k, m))) >= CONTAINED:
                    out.append((max(i, j), min(i, j), score))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _grouped(batches, "token", ["label", "id", "n_name", *PARTS], work):
            yield pd.DataFrame(out, columns=["a", "b", "score"])

    return spread(members.select("token", "label", "id", "n_name", *PARTS), "token").sortWithinPartitions("token").mapInPandas(run, "a bigint, b bigint, score double")


def _unclear(pairs: DataFrame, addresses: DataFrame) -> DataFrame:
    """(a, b): pairs to be left out, the larger id first, since one of the two leaves open what sets addresses apart that it
    fits (OAK between OAK ROAD and OAK LANE). It keeps those it fits best, unless they are apart too."""
    parts = [p for p in PARTS if p not in ("number", "zip")]
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    seen = both.join(addresses.select(F.col("id").alias("b"), *parts), "b")
    ends = seen.groupBy("a").agg(*[f(F.nullif(p, F.lit(""))).alias(f"{n}_{p}") for p in parts for n, f in (("low", F.min), ("high", F.max))])
    open_ = ends.join(addresses.select(F.col("id").alias("a"), *[F.col(p).alias(f"own_{p}") for p in parts]), "a").filter(" or ".join(f"own_{p} = '' and low_{p} <> high_{p}" for p in parts))

    def classes(values: set[str]) -> dict[str, int]:
        """Values by class: those that may misspell each other, in one step or several."""
        found: dict[str, int] = {}
        for n, v in enumerate(sorted(values)):
            met = {found[w] for w in found if _near(v, w)}
            found = {w: n if c in met else c for w, c in found.items()} | {v: n}
        return found

    def work(held: list) -> list:
        at, own = held[0][0], held[0][1 : 1 + len(parts)]
        rows = [row[1 + len(parts) :] for row in held]  # (b, score, parts)
        of = {k: classes({row[2 + k] for row in rows} - {""}) for k, o in enumerate(own) if not o}
        apart = lambda rows: any(len({of[k][row[2 + k]] for row in rows if row[2 + k]}) > 1 for k in of)
        if not apart(rows):
            return []
        best = max(row[1] for row in rows)
        gone = rows if apart([row for row in rows if row[1] == best]) else [row for row in rows if row[1] < best]
        return [(max(at, row[0]), min(at, row[0])) for row in gone]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _grouped(batches, "a", ["a", *[f"own_{p}" for p in parts], "b", "score", *parts], work):
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    asked = seen.join(open_.select("a", *[f"own_{p}" for p in parts]), "a")
    return spread(asked, "a").sortWithinPartitions("a").mapInPandas(run, "a bigint, b bigint").distinct()


_SHAPE = ["direction", "name", "kind", "state"]


def _fit(number: str, s: tuple, t: tuple) -> bool:
    """Whether two writings (direction, name, kind, state, n_name) of one number agree where nothing tells of the town."""
    at = lambda x: Address(number, x[0], x[1], x[2], "", x[3], "")
    return contained(at(s), at(t), (s[4], t[4])) >= CONTAINED


def _one_town_each(shapes: DataFrame) -> DataFrame:
    """(location, other): locations known by town only and by zip only that fit each other and no further one."""

    def work(held: list) -> list:
        by: tuple[dict, dict] = {}, {}
        for at, town, has_zip, number, *shape, _ in held:
            if town != has_zip:
                by[has_zip].setdefault(tuple(shape), []).append(at)
        out = []
        for own, others in (by, by[::-1]):
            for s, ids in own.items():
                if found := [x for t, xs in others.items() if _fit(number, s, t) for x in (min(xs), max(xs))]:
                    out += [(i, min(found), max(found)) for i in ids]
        return out

    one = _folded(shapes, work, "low bigint, high bigint").groupBy("a").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low = high").select("a", F.col("low").alias("b"))
    return one.join(one.toDF("b", "a"), ["a", "b"]).filter("a > b")


def _bare_ones(shapes: DataFrame) -> DataFrame:
    """(a, b): addresses without town and zip and the one location they fit; where none fits, the one fuller writing they fit."""

    def work(held: list) -> list:
        ends: dict[tuple, list[int]] = {}
        bare = []
        for at, town, has_zip, number, *shape, n in held:
            if not town and not has_zip:
                bare.append((-sum(map(bool, shape[:4])), -n, shape, at))
            else:
                low_high = ends.setdefault(tuple(shape), [at, at])
                low_high[:] = min(low_high[0], at), max(low_high[1], at)
        out, leaders = [], []
        for _, _, shape, at in sorted(bare):
            if found := [x for t, low_high in ends.items() if _fit(number, shape, t) for x in low_high]:
                out.append((at, min(found), max(found), True))
            elif found := [x for x, t in leaders if _fit(number, shape, t)]:
                out.append((at, min(found), max(found), False))
            else:
                leaders.append((at, shape))
        return out

    found = cut_lineage(_folded(shapes, work, "low bigint, high bigint, placed boolean").groupBy("a", "placed").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    placed = found.filter("placed")
    among = found.filter("not placed").join(placed.select("a"), "a", "left_anti").join(placed.select(F.col("a").alias("low")), "low", "left_anti")
    return placed.unionByName(among).filter("low = high").select("a", F.col("low").alias("b"))


def _folded(shapes: DataFrame, work, schema: str) -> DataFrame:
    names = ["a", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _grouped(batches, "token", ["location", "town", "has_zip", "number", *_SHAPE, "n_name", "n"], work):
            yield pd.DataFrame(out, columns=names)

    return spread(shapes, "token").sortWithinPartitions("token").mapInPandas(run, f"a bigint, {schema}")


def location_links(addresses: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between the ids of distinct addresses (id, n, n_name and the components) at the same location.

    Addresses that meet the threshold and agree in town or zip are linked, whatever is misspelled in them, unless one of them
    leaves open what sets apart those it fits. Tokens that more
    than ``crowd`` addresses carry (a house number on Main Street, of every town) tell too little: their members are indexed
    under longer keys that also hold what must agree besides. What remains open, as nothing tells of the town in both, is
    decided between the locations found so far: one known by town only and one by zip only are linked where they fit each
    other and no further one, an address with neither where one location fits.
    """
    addresses = cut_lineage(addresses)
    indexed = _indexed(addresses)
    counted = indexed.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1")
    members = cut_lineage(indexed.join(counted, "token"))
    hot = F.col("label").eqNullSafe("n") & (F.col("members") > crowd)
    pairs = _agree(members.filter(~hot))
    if not members.filter(hot).isEmpty():
        refined = _refined(members.filter(hot))
        several = refined.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("token")
        pairs = pairs.unionByName(_agree(refined.join(several, "token")))
    pairs = cut_lineage(pairs.distinct())
    links = cut_lineage(pairs.join(_unclear(pairs, addresses), ["a", "b"], "left_anti").select("a", "b"))
    placed = addresses.select(F.col("id"), F.col("city") != "", F.col("zip") != "").toDF("id", "town", "has_zip").join(components(links).toDF("id", "component"), "id", "left").withColumn("location", F.coalesce("component", "id"))
    known = placed.groupBy("location").agg(F.max("town").alias("town"), F.max("has_zip").alias("has_zip"))
    placed = cut_lineage(placed.select("id", "location").join(known, "location"))
    shapes = members.filter("label = 'n'").join(placed, "id").groupBy("token", "location", "town", "has_zip", "number", *_SHAPE, "n_name").agg(F.max("n").alias("n"))
    kinds = shapes.groupBy("token").agg(F.min("location").alias("low"), F.max("location").alias("high"), F.max(~F.col("town") & ~F.col("has_zip")).alias("bare"), F.max(F.col("town") & ~F.col("has_zip")).alias("by_town"), F.max(~F.col("town") & F.col("has_zip")).alias("by_zip"))
    shapes = cut_lineage(shapes.join(kinds.filter("low <> high and (bare or by_town and by_zip)").select("token"), "token"))
    met = cut_lineage(_one_town_each(shapes))
    shapes = shapes.join(met.toDF("location", "into"), "location", "left").withColumn("location", F.coalesce("into", "location")).drop("into")
    return links.unionByName(met).unionByName(_bare_ones(shapes)).distinct()


def distinct_addresses(forms: DataFrame) -> DataFrame:
    """(id, n, n_name, components) of every distinct parsed address; n_name counts the house and town pairs of its street name."""
    each = forms.groupBy(*PARTS).agg(F.sum("n").alias("n"))
    names = each.filter("name <> ''").select("name", "number", "city").distinct().groupBy("name").agg(F.count("*").alias("n_name"))
    return each.join(names, "name", "left").select(F.xxhash64(*PARTS).alias("id"), "n", F.coalesce("n_name", F.lit(0)).alias("n_name"), *PARTS)


def locations(extractions: DataFrame) -> DataFrame:
    """(extraction_id, role, form, location): every readable address with the id of its location."""
    rows = cut_lineage(entries(extractions))
    forms = parsed(rows.groupBy("form").agg(F.count("*").alias("n"), *[F.first(p).alias(p) for p in ("street", "city", "state", "zip")]), ["form", "n"])
    forms = cut_lineage(forms)
    labels = components(location_links(distinct_addresses(forms)))
    placed = forms.select("form", F.xxhash64(*PARTS).alias("node")).join(labels, "node", "left").select("form", F.coalesce("component", "node").alias("location"))
    return rows.select("extraction_id", "role", "form").join(placed, "form")


def pairs(placed: DataFrame, group: str, id_column: str, part: str, names: tuple[str, str, str, str]) -> DataFrame:
    """All pairs of a group's entries whose forms differ, the smaller (id, part) first. The result is pairs by its definition.

    The entries of a form go together and forms are paired, so entries written alike, however many, never meet; only entries
    are shuffled, once, and no pairs.
    """
    entries_ = placed.select(F.col(group).alias("g"), F.xxhash64("form").alias("f"), F.struct(F.col(id_column).alias("i"), F.col(part).alias("p")).alias("e"))
    forms = entries_.repartition("g").groupBy("g", "f").agg(F.collect_list("e").alias("es"))
    both = forms.toDF("g", "f1", "es1").join(forms.toDF("g", "f2", "es2"), "g").filter("f1 < f2")
    found = both.select(F.explode("es1").alias("e1"), "es2").select("e1", F.explode("es2").alias("e2")).select(F.least("e1", "e2").alias("a"), F.greatest("e1", "e2").alias("b"))
    return found.select(*[F.col(c).alias(n) for c, n in zip(("a.i", "a.p", "b.i", "b.p"), names)])


def found_places(extractions: DataFrame) -> DataFrame:
    """(id_a, role_a, id_b, role_b): pairs of differently written addresses at the same location."""
    return pairs(locations(extractions), "location", "extraction_id", "role", ("id_a", "role_a", "id_b", "role_b"))
