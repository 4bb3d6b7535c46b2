"""Queries over extracted readings: hypotheses, votes, entities and scalar clean-up, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetflow.functions import refdata, scalars as S
from packetflow.operators import assembly, consensus as V, consolidate as K, entities as E, flatten, payload
from packetflow.sources.tables import table


def q_hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    return payload.hypotheses(table(spark, folder, "extractions")).select("extraction_id", "packet_id", "field", "value", "confidence")


def q_extra_items(spark: SparkSession, folder: str) -> DataFrame:
    return payload.extra_items(table(spark, folder, "extractions"))


def _votes(spark: SparkSession, folder: str) -> DataFrame:
    return V.variants(table(spark, folder, "field_variants"))


def q_source_variants(spark: SparkSession, folder: str) -> DataFrame:
    return _votes(spark, folder).select("variant_id", "packet_id", "field_name", "value", "confidence", "doc_name", "doc_type")


def q_unique_variants(spark: SparkSession, folder: str) -> DataFrame:
    return V.unique_variants(_votes(spark, folder)).select("packet_id", "field_name", "key", "value", "confidence", "variant_id")


def q_plurality(spark: SparkSession, folder: str) -> DataFrame:
    return V.plurality(V.values(_votes(spark, folder)))


def q_variant_partition(spark: SparkSession, folder: str) -> DataFrame:
    counts = V.values(_votes(spark, folder))
    return V.partition(counts, V.plurality(counts))


def q_field_consensus(spark: SparkSession, folder: str) -> DataFrame:
    counts = V.values(_votes(spark, folder))
    return V.scored(counts, V.plurality(counts))


def q_review_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Per packet: fields, fields without review, share of the latter in percent."""
    found = q_field_consensus(spark, folder).groupBy("packet_id").agg(F.count("*").alias("fields"), F.count_if(~F.col("review_required")).alias("accepted"))
    return found.withColumn("accepted_percent", S.fixed(100.0 * F.col("accepted") / F.col("fields"), 1).cast("double"))


def q_vin_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return V.vin_consensus(_votes(spark, folder))


def q_primary_source(spark: SparkSession, folder: str) -> DataFrame:
    return V.primary_source(_votes(spark, folder))


def q_aligned_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return V.rover(_votes(spark, folder))


def q_entity_source(spark: SparkSession, folder: str) -> DataFrame:
    found = E.entity_source(E.entity_readings(payload.hypotheses(table(spark, folder, "extractions"))))
    return found.select("packet_id", "nest", "source_document_name", "document_type", "parts", "fields")


def q_entity_values(spark: SparkSession, folder: str) -> DataFrame:
    return E.entity_values(E.entity_source(E.entity_readings(payload.hypotheses(table(spark, folder, "extractions")))))


_SCORED = ["packet_id", "field_name", "value", "confidence", "review_required"]


def q_primary_scored(spark: SparkSession, folder: str) -> DataFrame:
    votes = _votes(spark, folder)
    return K.primary_scored(votes, V.values(votes)).select(*_SCORED)


def q_vin_scored(spark: SparkSession, folder: str) -> DataFrame:
    votes = _votes(spark, folder)
    return K.vin_scored(votes, V.values(votes)).select(*_SCORED)


def q_entities_scored(spark: SparkSession, folder: str) -> DataFrame:
    hypotheses = payload.hypotheses(table(spark, folder, "extractions"))
    return K.entity_scored(hypotheses, V.values(K.votes(hypotheses))).select(*_SCORED)


def q_consolidated(spark: SparkSession, folder: str) -> DataFrame:
    """Every field of every packet, by whichever rule chooses it."""
    return K.consolidated(table(spark, folder, "extractions"))


def q_record_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Records written as JSON with their variants and read again: fields, accepted fields, variants and extra items."""
    return assembly.record_counts(flatten.flatten_records(K.records(table(spark, folder, "extractions")), "packet_id")).withColumnRenamed("record_id", "packet_id")


def q_scalars(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "extractions").dropDuplicates(["extraction_id"])
    dob = S.date_parts(F.col("driver_dob.value"))
    return x.select(
        "extraction_id", S.short_vin(F.col("vehicle_vin.value")).alias("short_vin"), S.expand_color(F.col("vehicle_color.value")).alias("color"), S.odometer_text(F.col("odometer_reading.value")).alias("odometer"),
        S.money_amount(F.col("purchase_price.value")).alias("amount"), S.currency_text(F.col("purchase_price.value")).alias("currency_text"), S.last_name(F.col("owner_full_name.value")).alias("last_name"), S.truthy(F.col("plate_type.value")).alias("flag"),
        F.concat_ws("-", dob["year"], dob["month"], dob["day"]).alias("birth_date"), F.array_join(S.license_segments(F.col("owner_license_or_entity_id.value")), "/").alias("license"),
        S.first_value(F.col("owner_full_name.value"), F.col("lessee_name.value"), F.col("lienholder_name.value")).alias("party"),
    )


QUERIES = {f.__name__: f for f in (q_hypotheses, q_extra_items, q_source_variants, q_unique_variants, q_plurality, q_variant_partition, q_field_consensus, q_review_rate, q_vin_consensus, q_primary_source, q_aligned_consensus, q_entity_source, q_entity_values, q_primary_scored, q_vin_scored, q_entities_scored, q_consolidated, q_record_summary, q_scalars)}

_TRIM = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_SQUEEZE = lambda c: rf"upper(trim(regexp_replace({c}, '\s+', ' ', 'g')))"
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)
_FIELDS = ", ".join(f"{{'field': '{f}', 'v': {f}.value, 'c': {f}.confidence}}" for f in refdata.FIELDS)
_ALLOWED = ", ".join(f"('{t}', '{f}')" for t, f in refdata.profile_fields())
_HYPOTHESES = f"""
WITH once AS (SELECT DISTINCT ON (extraction_id) * FROM extractions
), allowed(t, f) AS (VALUES {_ALLOWED}
), long AS (
  SELECT extraction_id, packet_id, document_type, source_document_name, r.field, nullif({_TRIM("r.v")}, '') AS value, CASE WHEN r.c IS NOT NULL THEN greatest(0.0, least(1.0, r.c)) END AS confidence
  FROM (SELECT extraction_id, packet_id, document_type, source_document_name, unnest([{_FIELDS}]) AS r FROM once)
), hypotheses AS (
  SELECT long.* FROM long JOIN allowed ON allowed.f = long.field AND allowed.t = CASE WHEN document_type IN ({_quoted(refdata.DOCUMENT_TYPES)}) THEN document_type ELSE 'other' END
  WHERE value IS NOT NULL AND long.confidence IS NOT NULL
)"""
_READ = rf"""
WITH votes AS (
  SELECT DISTINCT ON (variant_id) variant_id, packet_id, field_name, {_TRIM("value")} AS value, {_SQUEEZE("value")} AS key, greatest(0.0, least(1.0, confidence)) AS confidence,
    CAST(round(greatest(0.0, least(1.0, confidence)) * 100000000) AS BIGINT) AS units, source_document_name AS doc_name, source_document_type AS doc_type
  FROM field_variants WHERE {_TRIM("value")} <> '' AND confidence IS NOT NULL
), counts AS (SELECT packet_id, field_name, key, count(*) AS n, CAST(sum(units) AS BIGINT) AS units, max(units) AS peak FROM votes GROUP BY ALL
), ordered AS (SELECT *, row_number() OVER (PARTITION BY packet_id, field_name ORDER BY n DESC, units DESC, key) AS k FROM counts
), plurality AS (SELECT packet_id, field_name, max(key) FILTER (k = 1) AS consensus, max(n) FILTER (k = 1) AS exact, coalesce(max(n) FILTER (k = 2), 0) AS second FROM ordered GROUP BY ALL
"""
_SCORE = """), compared AS (
  SELECT *, CASE WHEN key = consensus THEN 'exact' WHEN distance <= 0.15 THEN 'near' ELSE 'distant' END AS part
  FROM (SELECT c.*, p.consensus, levenshtein(p.consensus, c.key) / greatest(length(p.consensus), length(c.key), 1) AS distance FROM counts c JOIN CHOSEN p USING (packet_id, field_name))
), got AS (
  SELECT packet_id, field_name, consensus, coalesce(sum(n) FILTER (part = 'exact'), 0) AS exact, coalesce(sum(units) FILTER (part = 'exact'), 0) AS exact_units, max(peak) FILTER (part = 'exact') AS peak,
    coalesce(sum(n) FILTER (part = 'near'), 0) AS near, coalesce(sum(units) FILTER (part = 'near'), 0) AS near_units, max(peak) FILTER (part = 'near') AS near_peak,
    coalesce(sum(CAST(round(distance * n * 1000000000) AS BIGINT)) FILTER (part = 'near'), 0) AS near_steps, sum(n) AS everyone, sum(units) AS all_units, coalesce(max(n) FILTER (part <> 'exact'), 0) AS second
  FROM compared GROUP BY ALL
), raw AS (
  SELECT *, (0.65::DOUBLE * (peak / 100000000) + 0.35::DOUBLE * (exact_units / 100000000 / exact)) * (0.85::DOUBLE + 0.15::DOUBLE * (exact / (exact + second)))
    * (1 - CASE WHEN near > 0 THEN 0.35::DOUBLE * (near_steps / 1000000000 / near) * coalesce(near_units / nullif(all_units, 0), 0) ELSE 0.0::DOUBLE END) AS v FROM got
), raised AS (SELECT *, CASE WHEN exact >= 2 THEN least(1.0::DOUBLE, 1.04::DOUBLE * v) ELSE v END AS v1 FROM raw
), final AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN everyone = 1 THEN all_units / 100000000 WHEN exact = 0 THEN coalesce(0.6::DOUBLE * (near_peak / 100000000), 0.0) WHEN exact >= 2 AND exact > second THEN least(1.0::DOUBLE, 1.03::DOUBLE * v1) ELSE v1 END)) AS c FROM raised
), scored AS (SELECT packet_id, field_name, consensus, CAST(printf('%.4f', c) AS DOUBLE) AS confidence, c < 0.75 OR exact = 0 OR exact <= second AS review_required FROM final)
"""
_VOTES = _READ + _SCORE.replace("CHOSEN", "plurality")
_VIN = "regexp_replace(upper(value), '[^A-Z0-9]', '', 'g')"
_VOTED_VIN = f"""vins AS (SELECT packet_id, {_VIN} AS vin, units, variant_id FROM votes WHERE field_name = 'vehicle_vin'
), each_vin AS (SELECT packet_id, vin, CAST(sum(units) AS BIGINT) AS units, count(*) AS n, max(units) AS peak, min(variant_id) AS first FROM vins WHERE vin <> '' GROUP BY ALL
), voted_vin AS (SELECT packet_id, vin FROM each_vin QUALIFY row_number() OVER (PARTITION BY packet_id ORDER BY (length(vin) = 17) DESC, units DESC, n DESC, peak DESC, first) = 1)"""
_FIRSTS = f"""firsts(f, t) AS (VALUES {", ".join(f"('{f}', '{t}')" for f, t in refdata.PRIMARY_SOURCE.items())}
), known AS (SELECT packet_id, field_name, value AS spelling, CASE WHEN field_name = 'vehicle_vin' THEN {_VIN} ELSE key END AS norm, units, variant_id, coalesce(doc_type = t, false) AS is_primary FROM votes JOIN firsts ON f = field_name
), best AS (SELECT packet_id, field_name, norm AS value, spelling FROM known WHERE is_primary QUALIFY row_number() OVER (PARTITION BY packet_id, field_name ORDER BY units DESC, variant_id) = 1
), primary_source AS (
  SELECT packet_id, field_name, best.value, best.spelling, coalesce(bool_or(CASE WHEN field_name = 'vehicle_vin' THEN k.norm = best.value ELSE levenshtein(best.value, k.norm) / greatest(length(best.value), length(k.norm), 1) <= 0.15 END), true) AS confirmed
  FROM best LEFT JOIN (SELECT packet_id, field_name, norm FROM known WHERE NOT is_primary) k USING (packet_id, field_name) GROUP BY ALL)"""
_ENTITY = (
    _HYPOTHESES
    + f""", nests(nest, f, part) AS (VALUES {", ".join(f"('{n}', '{f}', {str(a).lower()})" for n, f, a in refdata.entity_fields())}
), entity AS (
  SELECT packet_id, nest, source_document_name, document_type, field, part, value, CAST(round(confidence * 10000) AS BIGINT) AS units, extraction_id
  FROM hypotheses JOIN nests ON nests.f = field WHERE NOT (nest = 'owner' AND coalesce(document_type IN ({_quoted(refdata.OWNER_EXCLUDED_TYPES)}), false))
), readings AS (SELECT * FROM entity QUALIFY row_number() OVER (PARTITION BY packet_id, nest, source_document_name, document_type, field ORDER BY units DESC, extraction_id, value DESC) = 1
), sources AS (
  SELECT packet_id, nest, source_document_name, document_type, count(*) FILTER (part) AS parts, coalesce(bool_or(field = 'owner_full_name' AND regexp_matches(upper(value), '{"|".join(refdata.ENTITY_NAME_TOKENS)}')), false) AS firm,
    CASE document_type WHEN 'manufacturer_certificate' THEN 3 WHEN 'dealer_invoice' THEN 2 WHEN 'retail_certificate_of_sale' THEN 1 ELSE 0 END AS boost, count(*) AS fields, CAST(sum(units) AS BIGINT) AS units, min(extraction_id) AS first
  FROM readings GROUP BY ALL
), won AS (SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY packet_id, nest ORDER BY parts DESC, firm DESC, boost DESC, fields DESC, units / fields DESC, units DESC, first) = 1)
"""
)
_COLORS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.COLOR_CODES.items())

ORACLE = {
    "q_hypotheses": _HYPOTHESES + " SELECT extraction_id, packet_id, field, value, confidence FROM hypotheses",
    "q_extra_items": f"""WITH once AS (SELECT DISTINCT ON (extraction_id) extraction_id, extra FROM extractions
), items AS (SELECT extraction_id, unnest(extra) AS x, generate_subscripts(extra, 1) - 1 AS item_no FROM once)
SELECT extraction_id, CAST(item_no AS INTEGER) AS item_no, {_TRIM("x.field_name")} AS field_name, {_TRIM("x.value")} AS value, greatest(0.0, least(1.0, x.confidence)) AS confidence FROM items
WHERE {_TRIM("x.field_name")} <> '' AND {_TRIM("x.value")} <> '' AND x.confidence IS NOT NULL""",
    "q_source_variants": _VOTES + " SELECT variant_id, packet_id, field_name, value, confidence, doc_name, doc_type FROM votes",
    "q_unique_variants": _VOTES + " SELECT packet_id, field_name, key, value, confidence, variant_id FROM votes QUALIFY row_number() OVER (PARTITION BY packet_id, field_name, key ORDER BY units DESC, variant_id) = 1",
    "q_plurality": _VOTES + " SELECT * FROM plurality",
    "q_variant_partition": _VOTES + " SELECT packet_id, field_name, CAST(coalesce(sum(n) FILTER (part = 'exact'), 0) AS BIGINT) AS n_exact, CAST(coalesce(sum(n) FILTER (part = 'near'), 0) AS BIGINT) AS n_near, CAST(coalesce(sum(n) FILTER (part = 'distant'), 0) AS BIGINT) AS n_distant FROM compared GROUP BY ALL",
    "q_field_consensus": _VOTES + " SELECT * FROM scored",
    "q_review_rate": _VOTES + " SELECT packet_id, count(*) AS fields, count(*) FILTER (NOT review_required) AS accepted, CAST(printf('%.1f', 100.0::DOUBLE * (count(*) FILTER (NOT review_required)) / count(*)) AS DOUBLE) AS accepted_percent FROM scored GROUP BY packet_id",
    "q_vin_consensus": _VOTES + f", {_VOTED_VIN} SELECT packet_id, vin FROM voted_vin",
    "q_primary_source": _VOTES + f", {_FIRSTS} SELECT packet_id, field_name, value, confirmed FROM primary_source",
    "q_entity_source": _ENTITY + " SELECT packet_id, nest, source_document_name, document_type, parts, fields FROM won",
    "q_entity_values": _ENTITY + " SELECT packet_id, nest, field, value, readings.units / 10000 AS confidence FROM readings JOIN won w USING (packet_id, nest) WHERE readings.source_document_name IS NOT DISTINCT FROM w.source_document_name AND readings.document_type IS NOT DISTINCT FROM w.document_type",
    "q_primary_scored": _READ
    + f"""), {_FIRSTS}, primary_ AS (
  SELECT packet_id, field_name, confirmed, written, upper(trim(regexp_replace(written, '\\s+', ' ', 'g'))) AS consensus
  FROM (SELECT *, CASE WHEN field_name = 'vehicle_vin' THEN coalesce(nullif({_VIN.replace("value", "spelling")}, ''), spelling) ELSE spelling END AS written FROM primary_source)
"""
    + _SCORE.replace("CHOSEN", "primary_")
    + " SELECT packet_id, field_name, written AS value, confidence, NOT confirmed AS review_required FROM scored JOIN primary_ USING (packet_id, field_name)",
    "q_vin_scored": _READ + f"), {_VOTED_VIN}, vin_ AS (SELECT packet_id, 'vehicle_vin' AS field_name, vin AS consensus FROM voted_vin " + _SCORE.replace("CHOSEN", "vin_") + " SELECT packet_id, field_name, consensus AS value, confidence, review_required FROM scored",
    "q_entities_scored": _ENTITY
    + f""", votes AS (SELECT extraction_id AS variant_id, packet_id, field AS field_name, value, {_SQUEEZE("value")} AS key, confidence, CAST(round(confidence * 100000000) AS BIGINT) AS units FROM hypotheses
), counts AS (SELECT packet_id, field_name, key, count(*) AS n, CAST(sum(units) AS BIGINT) AS units, max(units) AS peak FROM votes GROUP BY ALL
), entity_ AS (
  SELECT packet_id, field AS field_name, value AS written, {_SQUEEZE("value")} AS consensus FROM readings JOIN won w USING (packet_id, nest)
  WHERE readings.source_document_name IS NOT DISTINCT FROM w.source_document_name AND readings.document_type IS NOT DISTINCT FROM w.document_type
"""
    + _SCORE.replace("CHOSEN", "entity_")
    + " SELECT packet_id, field_name, written AS value, confidence, review_required FROM scored JOIN entity_ USING (packet_id, field_name)",
    "q_scalars": rf"""WITH once AS (SELECT DISTINCT ON (extraction_id) extraction_id, vehicle_vin.value AS vin, vehicle_color.value AS color, odometer_reading.value AS odo, purchase_price.value AS price, owner_full_name.value AS owner, plate_type.value AS plate, driver_dob.value AS dob, owner_license_or_entity_id.value AS lic, lessee_name.value AS lessee, lienholder_name.value AS lien FROM extractions
), t AS (SELECT *, trim(regexp_replace(color, '\s+', ' ', 'g')) AS color_plain, regexp_replace({_TRIM("odo")}, ',', '', 'g') AS odo_plain, nullif({_TRIM("price")}, '') AS price_plain, regexp_replace(upper(lic), '[^A-Z0-9]', '', 'g') AS lic_plain,
    nullif(regexp_extract(regexp_replace(translate(price, '$,', ''), '\s', '', 'g'), '([0-9]+(\.[0-9]+)?)', 1), '') AS price_number, replace(price_plain, ',', '') AS price_digits, '^\s*([0-9]{{1,2}})[/-]([0-9]{{1,2}})[/-]([0-9]{{4}}|[0-9]{{2}})\s*$' AS dp,
    list_filter(string_split(upper(trim(regexp_replace(replace(owner, ',', ' '), '\s+', ' ', 'g'))), ' '), lambda w: w <> '') AS owner_words FROM once
)
SELECT extraction_id, right(regexp_replace(upper(vin), '[^A-Z0-9]', '', 'g'), 8) AS short_vin, CASE upper(color_plain) {_COLORS} ELSE color_plain END AS color,
  CASE WHEN regexp_full_match(odo_plain, '[0-9]+') THEN CASE WHEN regexp_full_match(odo_plain, '0+') THEN '0' ELSE ltrim(odo_plain, '0') END ELSE nullif({_TRIM("odo")}, '') END AS odometer,
  CASE WHEN NOT regexp_matches(lower(price), '{"|".join(S.PAID_MARKERS)}') AND CAST(price_number AS DOUBLE) > 0 THEN CAST(price_number AS DOUBLE) END AS amount,
  CASE WHEN starts_with(price_plain, '$') THEN price_plain WHEN regexp_full_match(price_digits, '[0-9]+(\.[0-9]+)?') THEN '$ ' || format('{{:,.2f}}', CAST(price_digits AS DOUBLE)) ELSE price_plain END AS currency_text,
  CASE WHEN len(owner_words) > 1 AND rtrim(owner_words[-1], '.') IN ({_quoted(S.NAME_SUFFIXES)}) THEN owner_words[-2] ELSE owner_words[-1] END AS last_name, CASE WHEN lower({_TRIM("plate")}) IN ({_quoted(S.YES)}) THEN true WHEN lower({_TRIM("plate")}) IN ({_quoted(S.NO)}) THEN false END AS flag,
  CASE WHEN regexp_matches(dob, dp) THEN (CASE WHEN length(regexp_extract(dob, dp, 3)) = 2 THEN CASE WHEN CAST(regexp_extract(dob, dp, 3) AS INTEGER) > 30 THEN '19' ELSE '20' END ELSE '' END) || regexp_extract(dob, dp, 3) || '-' || lpad(regexp_extract(dob, dp, 1), 2, '0') || '-' || lpad(regexp_extract(dob, dp, 2), 2, '0') ELSE '' END AS birth_date,
  CASE WHEN length(lic_plain) >= 10 THEN substr(lic_plain, 1, 5) || '/' || substr(lic_plain, 6, 5) || '/' || substr(lic_plain, 11, 5) END AS license,
  coalesce(nullif({_TRIM("owner")}, ''), nullif({_TRIM("lessee")}, ''), nullif({_TRIM("lien")}, '')) AS party FROM t""",
}
