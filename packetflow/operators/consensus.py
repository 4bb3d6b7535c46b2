"""Votes over contradicting readings of a field: variants, plurality, confidence, review, VIN and aligned consensus.

Readings are grouped by packet and field. Sums of confidences are kept in hundred-millionths, so they do not depend on
the order of rows. Readings with a blank value or without confidence do not vote; a reading delivered again under its id
votes once; ties go to the higher sum of confidence, then to the smaller text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from packetflow.functions.refdata import PRIMARY_SOURCE
from packetflow.functions.scalars import confidence, fixed, normalize_vin
from packetflow.functions.text import squeeze_upper, strip

#: Share of edits up to which a value counts as near another.
NEAR = 0.15
REVIEW_BELOW = 0.75
KEYS = ["packet_id", "field_name"]
_UNIT = 100_000_000


def variants(readings: DataFrame) -> DataFrame:
    """Voting readings: variant_id, packet_id, field_name, value, key, confidence, units, doc_name, doc_type."""
    rows = readings.select("variant_id", *KEYS, strip("value").alias("value"), squeeze_upper("value").alias("key"), confidence(F.col("confidence")).alias("confidence"), F.col("source_document_name").alias("doc_name"), F.col("source_document_type").alias("doc_type"))
    rows = rows.filter("value <> '' and confidence is not null").dropDuplicates(["variant_id"])
    return rows.withColumn("units", F.round(F.col("confidence") * _UNIT).cast("bigint"))


def unique_variants(votes: DataFrame) -> DataFrame:
    """The surest spelling of every normalized value, the first reading on a tie."""
    best = F.max_by(F.struct("value", "confidence", "variant_id"), F.struct("units", -F.col("variant_id")))
    return votes.groupBy(*KEYS, "key").agg(best.alias("b")).select(*KEYS, "key", "b.value", "b.confidence", "b.variant_id")


def ratio(a: Column, b: Column) -> Column:
    """Edits over the length of the longer text."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def values(votes: DataFrame) -> DataFrame:
    """Per normalized value: readings, units, highest confidence. Everything after works on these few rows."""
    return votes.groupBy(*KEYS, "key").agg(F.count("*").alias("n"), F.sum("units").alias("units"), F.max("units").alias("peak"))


def plurality(counts: DataFrame) -> DataFrame:
    """packet_id, field_name, consensus, exact, second: the value with most readings, and the next count."""
    order = W.partitionBy(*KEYS).orderBy(F.desc("n"), F.desc("units"), "key")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    return ranked.groupBy(*KEYS).agg(F.max(F.when(F.col("rank") == 1, F.col("key"))).alias("consensus"), F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("exact"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("n"))), F.lit(0)).alias("second"))


def compared(counts: DataFrame, chosen: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Values beside the chosen consensus of their group, each exact, near or distant; keep are further columns of chosen."""
    both = counts.join(chosen.select(*KEYS, "consensus", *(keep or [])), KEYS)
    d = ratio(F.col("consensus"), F.col("key"))
    return both.withColumn("distance", d).withColumn("part", F.when(F.col("key") == F.col("consensus"), "exact").when(d <= NEAR, "near").otherwise("distant"))


def partition(counts: DataFrame, chosen: DataFrame) -> DataFrame:
    """packet_id, field_name, n_exact, n_near, n_distant readings."""
    n = lambda p: F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(f"n_{p}")
    return compared(counts, chosen).groupBy(*KEYS).agg(n("exact"), n("near"), n("distant"))


def scored(counts: DataFrame, chosen: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """packet_id, field_name, consensus, confidence (4 decimals), review_required.

    Confidence starts from the peak and mean of the readings that agree, is lowered by other pluralities and by near misses
    in proportion to their distance and weight, and raised a little by agreement; without agreement it is 0.6 of the best near miss.
    """
    kept = keep or []
    parts = compared(counts, chosen, kept)
    of = lambda p, c: F.coalesce(F.sum(F.when(F.col("part") == p, F.col(c))), F.lit(0))
    near_steps = F.coalesce(F.sum(F.when(F.col("part") == "near", F.round(F.col("distance") * F.col("n") * 1_000_000_000).cast("bigint"))), F.lit(0))
    got = parts.groupBy(*KEYS, "consensus", *kept).agg(
        of("exact", "n").alias("exact"), of("exact", "units").alias("exact_units"), F.max(F.when(F.col("part") == "exact", F.col("peak"))).alias("peak"),
        of("near", "n").alias("near"), of("near", "units").alias("near_units"), F.max(F.when(F.col("part") == "near", F.col("peak"))).alias("near_peak"), near_steps.alias("near_steps"),
        F.sum("n").alias("all"), F.sum("units").alias("all_units"), F.coalesce(F.max(F.when(F.col("part") != "exact", F.col("n"))), F.lit(0)).alias("second"),
    )
    c = F.col
    base = 0.65 * (c("peak") / _UNIT) + 0.35 * (F.try_divide(c("exact_units") / _UNIT, c("exact")))
    loss = F.when(c("near") > 0, 0.35 * (c("near_steps") / 1_000_000_000 / c("near")) * F.coalesce(F.try_divide("near_units", "all_units"), F.lit(0.0))).otherwise(0.0)
    value = base * (0.85 + 0.15 * F.try_divide(c("exact"), c("exact") + c("second"))) * (1 - loss)
    value = F.when(c("exact") >= 2, F.least(F.lit(1.0), 1.04 * value)).otherwise(value)
    value = F.when((c("exact") >= 2) & (c("exact") > c("second")), F.least(F.lit(1.0), 1.03 * value)).otherwise(value)
    value = F.when(c("all") == 1, c("all_units") / _UNIT).when(c("exact") == 0, F.coalesce(0.6 * (c("near_peak") / _UNIT), F.lit(0.0))).otherwise(value)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    got = got.withColumn("c", value)
    review = c("consensus").isNull() | (c("c") < REVIEW_BELOW) | (c("exact") == 0) | (c("exact") <= c("second"))
    return got.select(*KEYS, "consensus", *kept, fixed(c("c"), 4).cast("double").alias("confidence"), review.alias("review_required"))


def vin_consensus(votes: DataFrame, field: str = "vehicle_vin") -> DataFrame:
    """packet_id, vin: the candidate with most confidence, then readings, then the surest single one; 17 characters go first."""
    rows = votes.filter(F.col("field_name") == field).withColumn("vin", normalize_vin(F.col("value"))).filter("vin <> ''")
    each = rows.groupBy("packet_id", "vin").agg(F.sum("units").alias("units"), F.count("*").alias("n"), F.max("units").alias("peak"), F.min("variant_id").alias("first"))
    rank = F.struct((F.length("vin") == 17).alias("whole"), "units", "n", "peak", (-F.col("first")).alias("first"))
    return each.groupBy("packet_id").agg(F.max_by("vin", rank).alias("vin"))


def primary_source(votes: DataFrame) -> DataFrame:
    """packet_id, field_name, value, confirmed: see primary_readings."""
    return primary_readings(votes).drop("spelling")


def primary_readings(votes: DataFrame) -> DataFrame:
    """packet_id, field_name, value, spelling, confirmed: the surest reading of the field's primary document type,
    normalized and as written, and whether another type confirms it or none speaks."""
    first = F.create_map(*[F.lit(x) for pair in PRIMARY_SOURCE.items() for x in pair])
    rows = votes.withColumn("primary", first[F.col("field_name")]).filter("primary is not null").withColumn("is_primary", F.coalesce(F.col("doc_type") == F.col("primary"), F.lit(False)))
    norm = F.when(F.col("field_name") == "vehicle_vin", normalize_vin(F.col("value"))).otherwise(F.col("key"))
    each = rows.withColumn("norm", norm).groupBy(*KEYS, "is_primary", "norm").agg(F.max(F.struct("units", (-F.col("variant_id")).alias("v"), "value")).alias("top"))
    best = each.filter("is_primary").groupBy(*KEYS).agg(F.max_by(F.struct("norm", F.col("top.value").alias("spelling")), "top").alias("b")).select(*KEYS, F.col("b.norm").alias("value"), "b.spelling")
    others = each.filter("not is_primary").select(*KEYS, F.col("norm").alias("other"))
    confirms = F.when(F.col("field_name") == "vehicle_vin", F.col("other") == F.col("value")).otherwise(ratio(F.col("value"), F.col("other")) <= NEAR)
    return best.join(others, KEYS, "left").groupBy(*KEYS, "value", "spelling").agg(F.coalesce(F.max(confirms), F.lit(True)).alias("confirmed"))


def _columns(center: str, other: str) -> list[tuple[int, str]]:
    """other aligned to center by fewest edits: (column, character); inserted characters stand half a column later."""
    n, m = len(center), len(other)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (center[i - 1] != other[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (center[i - 1] != other[j - 1]):
            i, j = i - 1, j - 1
            out.append((2 * i, other[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((2 * i, ""))
        else:
            j -= 1
            out.append((2 * i - 1, other[j]))
    return out


def aligned_consensus(readings: list[tuple[str, float]], spread: float = 0.75) -> str | None:
    """Vote by character over readings aligned to the surest one, then the spelling nearest to the outcome.

    Readings further than spread from the surest do not vote. The result is always one of the readings.
    """
    from packetflow.operators.edit import distance

    known = [(" ".join(v.split()), c) for v, c in readings if v and v.strip()]
    if not known:
        return None
    seed = max(known, key=lambda x: x[1])[0].upper()
    close = [(v.upper(), c) for v, c in known if distance(seed, v.upper()) <= spread * max(len(seed), len(v), 1)]
    weight: dict[int, dict[str, float]] = {}
    present: dict[int, float] = {}
    for v, c in close:
        for column, ch in _columns(seed, v):
            weight.setdefault(column, {}).setdefault(ch, 0.0)
            weight[column][ch] += c
            present[column] = present.get(column, 0.0) + c
    total = sum(c for _, c in close)
    text = ""
    for column in sorted(weight):
        votes = weight[column] if column % 2 == 0 else weight[column] | {"": total - present[column]}
        text += max(votes, key=lambda ch: votes[ch])
    exact = [(c, v) for v, c in known if v.upper() == text]
    if exact:
        return max(exact, key=lambda x: x[0])[1]
    return min(known, key=lambda x: (distance(x[0].upper(), text), -x[1]))[0]


def rover(votes: DataFrame) -> DataFrame:
    """packet_id, field_name, value: aligned consensus of the distinct spellings of every packet and field."""
    spellings = unique_variants(votes)
    grouped = spellings.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "value"))).alias("readings"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            value = [aligned_consensus([(r["value"], -r["c"]) for r in rs]) for rs in b.readings]
            yield pd.DataFrame({"packet_id": b.packet_id, "field_name": b.field_name, "value": value})

    return grouped.mapInPandas(run, "packet_id bigint, field_name string, value string")
