"""Best value of each packet and field out of contradicting readings (p4).

Iterative truth discovery: the vote of a reading is its confidence times the reliability of its document type in that
field; the reliability of a type is the share of its votes that went to winning values; both are estimated in turn until
no reliability moves by SETTLED. What a field is known to follow is the prior of the sources. Votes count in levels that
lie beyond each other, so the support of a value is its votes level by level, highest first, and the value with the
highest support survives; a level without votes does not count. In vehicle fields a level is a document type, in the order
of the estimated reliabilities, which may rise with trust only (pooled where the data say otherwise); for street and
odometer it is a document date; for names how well read and complete the name is; other fields have one level, where the
weighted votes alone decide.

Readings are reduced to one row per packet, field and value with its votes by type and date (by type, where dates do not
matter), combined before every shuffle; a round is then a map and one combined aggregate over those rows, so a packet that
holds a third of all readings is never in one task's memory. Only the reliabilities (document types x fields) reach the driver.

Results for odd input: null, blank and placeholder values and readings below the least confidence never survive; where
nothing else is left there is no row; a null or unknown document type has least trust; a null confidence counts as the
least confidence, a null date as the oldest; rows delivered again under one variant_id vote once; ties end with the
greater value in text order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetflow.functions.text import squeeze_upper
from packetflow.session import cut_lineage

TRUST_FIELDS = ("vehicle_vin", "vehicle_make", "vehicle_year")
DATE_FIELDS = ("owner_address_street", "odometer_reading")
NAME_FIELDS = ("owner_full_name",)
LEAST_CONFIDENCE = 0.3
#: Names read with less are taken only where no other reading is left.
WELL_READ = 0.6
#: Reliabilities that move less have settled; from DAMPED rounds on they move half the way; unsettled after ROUNDS is an error.
SETTLED, DAMPED, ROUNDS = 0.01, 6, 60
_UNIT = 1_000_000
#: Texts that stand for a missing value.
PLACEHOLDERS = ("", "-", "--", ".", "?", "NA", "N/A", "NONE", "NULL", "NIL", "TBD", "TBA", "UNKNOWN", "UNK", "SEE ATTACHED", "SEEATTACHED", "SEE FILE", "PENDING", "XXX", "NOT LISTED", "SAME")
#: What is written around a name without being part of it.
BEFORE_NAME, AFTER_NAME = r"^[A-Z ]{2,20}: *", r" *(&|/| AND | OR |\(| DBA | AKA | C/O | ET AL| DL COPY| COPY ON| ON FILE| SEE ).*$"
SUFFIXES = r" (JR|SR|II|III|IV)\.?$"


def normalized(field: Column, value: Column) -> Column:
    """Upper case, stripped, single spaces; for the VIN only letters and digits."""
    plain = squeeze_upper(value)
    return F.when(field == "vehicle_vin", F.regexp_replace(plain, "[^A-Z0-9]", "")).otherwise(plain)


def readings(variants: DataFrame, document_types: DataFrame) -> DataFrame:
    """(packet_id, field_name, value_norm, types array<struct<type, trust, day, units, surest>>): eligible values, one row each."""
    known = document_types.groupBy(F.col("type_id").alias("type")).agg(F.max("trust").alias("trust"))
    field = F.col("field_name")
    norm = normalized(field, F.col("value"))
    norm = F.when(field.isin(*NAME_FIELDS), F.trim(F.regexp_replace(F.regexp_replace(norm, BEFORE_NAME, ""), AFTER_NAME, ""))).otherwise(norm)
    day = F.when(field.isin(*DATE_FIELDS), F.datediff("document_date", F.lit("1900-01-01").cast("date")))
    units = F.round(F.coalesce("confidence", F.lit(LEAST_CONFIDENCE)) * _UNIT).cast("bigint")
    rows = variants.select("variant_id", "packet_id", "field_name", norm.alias("value_norm"), units.alias("units"), F.col("source_document_type").alias("type"), day.alias("day"))
    rows = rows.filter(F.col("value_norm").isNotNull() & ~F.col("value_norm").isin(*PLACEHOLDERS) & (F.col("units") >= round(LEAST_CONFIDENCE * _UNIT)))
    rows = rows.join(known, "type", "left").withColumn("type", F.when(F.col("trust").isNotNull(), F.col("type")).otherwise("unknown")).withColumn("trust", F.coalesce("trust", F.lit(0)))
    key = ["packet_id", "field_name", "value_norm"]
    once = rows.groupBy(*key, "type", "trust", "day", "variant_id").agg(F.max("units").alias("units"))
    each = once.groupBy(*key, "type", "trust", "day").agg(F.sum("units").alias("units"), F.max("units").alias("surest"))
    return each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("type", "trust", "day", "units", "surest"))).alias("types"))


def contradicted(variants: DataFrame) -> DataFrame:
    """(packet_id, field_name) with at least two different normalized non-blank values."""
    norm = normalized(F.col("field_name"), F.col("value"))
    rows = variants.select("packet_id", "field_name", norm.alias("v")).filter("v <> ''")
    return rows.groupBy("packet_id", "field_name").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low <> high").select("packet_id", "field_name")


def monotone(shares: list[tuple[float, float]]) -> list[float]:
    """Means of (value, weight) pooled so that they never fall, in the order given."""
    pools: list[list[float]] = []
    for value, weight in shares:
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v, w, n = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + v * w) / (pools[-1][1] + w), pools[-1][1] + w, pools[-1][2] + n]
    return [v for v, _, n in pools for _ in range(n)]


class Reliability:
    """What is known of the document types of each field: how reliable each is, and its place among those of the field."""

    def __init__(self, given: dict[tuple[str, str], tuple[int, int]], won: dict[tuple[str, str], int] | None = None, last: Reliability | None = None):
        self.given, self.of, self.place = given, {}, {}
        for field in sorted({f for f, _ in given}):
            types = sorted((t for f, t in given if f == field), key=lambda t: (given[field, t][1], t))
            shares = [0.1 + 0.8 * min(given[field, t][1], 100) / 100 if won is None else (won.get((field, t), 0) + _UNIT) / (given[field, t][0] + 2 * _UNIT) for t in types]
            if field in TRUST_FIELDS:  # among types of equal trust nothing is known, so their order is the estimated one
                pairs = sorted(zip(types, shares), key=lambda p: (given[field, p[0]][1], p[1], p[0]))
                types, shares = [t for t, _ in pairs], monotone([(x, given[field, t][0] + 2.0 * _UNIT) for t, x in pairs])
            if last:
                shares = [(x + last.of[field, t]) / 2 for x, t in zip(shares, types)]
            self.of |= {(field, t): x for x, t in zip(shares, types)}
            order = sorted(types, key=lambda t: (self.of[field, t], given[field, t][1]))
            levels = sorted({(self.of[field, t], given[field, t][1]) for t in types})
            self.place |= {(field, t): float(levels.index((self.of[field, t], given[field, t][1]))) for t in order}

    def moved(self, other: Reliability) -> float:
        return max((abs(x - other.of[k]) for k, x in self.of.items()), default=0.0)

    def _of_types(self, numbers: dict[tuple[str, str], float]) -> Column:
        """map<type, number> of the row's field."""
        by_field = {f: F.create_map(*[F.lit(x) for (g, t), n in sorted(numbers.items()) if g == f for x in (t, float(n))]) for f in sorted({f for f, _ in numbers})}
        return F.create_map(*[x for f, m in by_field.items() for x in (F.lit(f), m)])[F.col("field_name")]

    def support(self, values: DataFrame) -> DataFrame:
        """values with support array<struct<level, votes>>, highest level first."""
        if not self.of:
            return values.withColumn("support", F.lit(None).cast("array<struct<level:struct<a:double,b:double,c:double>,votes:double>>"))
        rows = values.withColumns({"weights": self._of_types(self.of), "places": self._of_types(self.place)})
        field, value = F.col("field_name"), F.col("value_norm")
        zero = F.lit(0.0)
        full = F.when(field.isin(*NAME_FIELDS), F.size(F.filter(F.split(value, " "), lambda w: F.length(F.regexp_replace(w, "[^A-Z0-9]", "")) >= 2)).cast("double")).otherwise(zero)
        rows = rows.withColumns({"full": full, "chars": F.when(field.isin(*NAME_FIELDS), F.length(value).cast("double")).otherwise(zero)})

        def level(t: Column) -> Column:
            first = F.when(field.isin(*TRUST_FIELDS), F.col("places")[t["type"]]).when(field.isin(*DATE_FIELDS), F.coalesce(t["day"].cast("double"), F.lit(-1.0))).when(field.isin(*NAME_FIELDS), (t["surest"] >= round(WELL_READ * _UNIT)).cast("double")).otherwise(zero)
            return F.struct(first.alias("a"), F.col("full").alias("b"), F.col("chars").alias("c"))

        rows = rows.withColumn("each", F.transform("types", lambda t: F.struct(level(t).alias("level"), (t["units"] / _UNIT * F.col("weights")[t["type"]]).alias("votes"))))
        voting = F.filter("each", lambda v: v["votes"] > 0)
        levels = F.array_sort(F.array_distinct(F.transform(voting, lambda v: v["level"])))
        summed = F.reverse(F.transform(levels, lambda x: F.struct(x.alias("level"), F.aggregate(F.filter(voting, lambda v: v["level"] == x), zero, lambda a, v: a + v["votes"]).alias("votes"))))
        # Most values have one reading, or several of one level: nothing to sort.
        support = F.when(F.size("each") == 1, voting).otherwise(summed)
        return rows.withColumn("support", support).drop("weights", "places", "full", "chars", "each")


def reliabilities(values: DataFrame) -> tuple[Reliability, list[float]]:
    """The settled reliabilities, and by how much the largest change of every round moved one."""
    t = F.explode("types").alias("t")
    given = {(r.field_name, r.type): (r.given, r.trust) for r in values.select("field_name", t).groupBy("field_name", "t.type").agg(F.sum("t.units").alias("given"), F.max("t.trust").alias("trust")).collect()}  # types x fields
    now, moves = Reliability(given), []
    while given:
        best = now.support(values).groupBy("packet_id", "field_name").agg(F.max(F.struct("support", "value_norm", "types")).alias("best"))
        won = {(r.field_name, r.type): r.won for r in best.select("field_name", F.explode("best.types").alias("t")).groupBy("field_name", "t.type").agg(F.sum("t.units").alias("won")).collect()}  # types x fields
        last, now = now, Reliability(given, won, now if len(moves) >= DAMPED else None)
        moves.append(now.moved(last))
        if moves[-1] < SETTLED:
            break
        if len(moves) == ROUNDS:
            raise RuntimeError(f"reliabilities have not settled in {ROUNDS} rounds: {moves[-3:]}")
    return now, moves


def survivors(variants: DataFrame, document_types: DataFrame) -> DataFrame:
    """(packet_id, field_name, value_norm, votes, n_values): the surviving value of every packet and field that has one."""
    values = cut_lineage(readings(variants, document_types))
    reliability, _ = reliabilities(values)
    ranked = reliability.support(values).select("packet_id", "field_name", F.struct("support", "value_norm").alias("x"))
    best = ranked.groupBy("packet_id", "field_name").agg(F.max("x").alias("x"), F.count("*").alias("n_values"))
    votes = F.aggregate("x.support", F.lit(0.0), lambda a, s: a + s["votes"])
    return best.select("packet_id", "field_name", "x.value_norm", votes.alias("votes"), "n_values")


def found_survivors(variants: DataFrame, document_types: DataFrame) -> DataFrame:
    """(packet_id, field_name, value_norm) where readings contradict each other."""
    return survivors(variants, document_types).join(contradicted(variants), ["packet_id", "field_name"]).select("packet_id", "field_name", "value_norm")
