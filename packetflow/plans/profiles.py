"""Queries of flattening and load profiling, with the profile's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetflow.operators import assembly, flatten, profile
from packetflow.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return flatten.found_nodes(table(spark, folder, "consolidated_records"), table(spark, folder, "extractions"))


def p1_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Fields, variants and extra items of all records with their values."""
    return flatten.flatten_records(table(spark, folder, "consolidated_records"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return profile.found_quality(table(spark, folder, "extractions"))


def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Per field and load: rows, filled, distinct values, most frequent count, well-formed count and median; ranges are in p2_ranges."""
    loads = profile.load_profile(profile.value_counts(table(spark, folder, "extractions")))
    return loads.select("field_name", "feed_id", "load_no", "load_id", "n_rows", "filled", "distinct_values", "mode_n", "good", F.round("median", 3).alias("median"))


def p2_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Per field and load: smallest and largest number or birth date of the well-formed values."""
    loads = profile.load_profile(profile.value_counts(table(spark, folder, "extractions")))
    return loads.select("field_name", "feed_id", "load_no", "load_id", "min_number", "max_number", "min_date", "max_date")


def p2_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Per field and load: every distinct value, missing as null, with its rows."""
    return profile.value_counts(table(spark, folder, "extractions")).select("field_name", "feed_id", "load_no", "load_id", "value", "n")


def p2_stability(spark: SparkSession, folder: str) -> DataFrame:
    """Population stability indexes of each load against the one before: of values, of shapes, of missing and malformed shares."""
    found = profile.stability_index(profile.value_counts(table(spark, folder, "extractions")))
    return found.withColumns({c: F.round(c, 6) for c in ("psi", "psi_shape", "psi_state")})


def q_record_counts(spark: SparkSession, folder: str) -> DataFrame:
    return assembly.record_counts(flatten.flatten_records(table(spark, folder, "consolidated_records")))


def q_record_values(spark: SparkSession, folder: str) -> DataFrame:
    paths = {"vin": ("vehicle_vin",), "owner": ("owner.full_name", "owner.name", "owner[0].full_name"), "city": ("owner.address.city", "lessee.address.city"), "lienholder": ("lienholder.name",)}
    return assembly.record_values(flatten.flatten_records(table(spark, folder, "consolidated_records")), paths)


QUERIES = {f.__name__: f for f in (q_record_counts, q_record_values, p1_found, p1_nodes, p2_found, p2_profile, p2_ranges, p2_frequencies, p2_stability)}

_AT = lambda j, k: f"json_extract({j}, '/' || replace(replace({k}, '~', '~0'), '/', '~1'))"
_ITEMS = lambda j: f"CASE WHEN {j} IS NULL OR json_type({j}) = 'NULL' THEN [] WHEN json_type({j}) = 'ARRAY' THEN json_extract({j}, '$[*]') ELSE [{j}] END"
_PLAIN = lambda j: f"CASE WHEN json_type({j}) = 'NULL' THEN NULL ELSE {j} ->> '$' END"
_DOUBLE = lambda j: f"CASE WHEN json_type({j}) IN ('NULL', 'BOOLEAN', 'OBJECT', 'ARRAY') THEN NULL ELSE try_cast({j} ->> '$' AS DOUBLE) END"
_NODES = f"""
WITH RECURSIVE opened AS (
  SELECT record_id, '' AS spot, json(ltrim(record_json, chr(65279))) AS j FROM consolidated_records WHERE json_valid(ltrim(record_json, chr(65279)))
  UNION ALL
  SELECT record_id, spot || '/' || CAST(x.i AS VARCHAR), x.j FROM (
    SELECT record_id, spot, unnest(list_transform(inner_, lambda y, i: {{'i': i, 'j': y}})) AS x FROM (
      SELECT record_id, spot, CASE
        WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(ltrim(j ->> '$', chr(65279))) THEN [json(ltrim(j ->> '$', chr(65279)))] ELSE [] END
        WHEN json_type(j) = 'ARRAY' THEN list_filter(json_extract(j, '$[*]'), lambda y: json_type(y) IN ('OBJECT', 'VARCHAR'))
        WHEN json_type(j) = 'OBJECT' AND len(json_keys(j)) = 1 AND json_keys(j)[1] IN ('consolidated_data', 'record', 'record_json')
          AND (json_type({_AT("j", "json_keys(j)[1]")}) = 'ARRAY' OR json_type({_AT("j", "json_keys(j)[1]")}) = 'OBJECT' AND NOT json_exists({_AT("j", "json_keys(j)[1]")}, '$.value')) THEN [{_AT("j", "json_keys(j)[1]")}]
        ELSE [] END AS inner_
      FROM opened))
), records AS (
  SELECT record_id, spot, j FROM opened
  WHERE json_type(j) = 'OBJECT' AND NOT (len(json_keys(j)) = 1 AND json_keys(j)[1] IN ('consolidated_data', 'record', 'record_json')
    AND (json_type({_AT("j", "json_keys(j)[1]")}) = 'ARRAY' OR json_type({_AT("j", "json_keys(j)[1]")}) = 'OBJECT' AND NOT json_exists({_AT("j", "json_keys(j)[1]")}, '$.value')))
), walk AS (
  SELECT record_id, spot, k AS path, '' AS parent, {_AT("j", "k")} AS node FROM (SELECT record_id, spot, j, unnest(json_keys(j)) AS k FROM records) WHERE k <> 'extra'
  UNION ALL
  SELECT record_id, spot, path || x.label, path, x.node FROM (
    SELECT record_id, spot, path, unnest(CASE
      WHEN json_type(node) = 'OBJECT' AND NOT json_exists(node, '$.value') THEN list_transform(json_keys(node), lambda k: {{'label': '.' || k, 'node': {_AT("node", "k")}}})
      WHEN json_type(node) = 'ARRAY' THEN list_transform(json_extract(node, '$[*]'), lambda y, i: {{'label': '[' || CAST(i - 1 AS VARCHAR) || ']', 'node': y}})
      ELSE [] END) AS x FROM walk)
), fields AS (
  SELECT record_id, path AS node_path, parent AS parent_path, node FROM walk WHERE json_type(node) = 'VARCHAR' OR json_type(node) = 'OBJECT' AND json_exists(node, '$.value')
  QUALIFY row_number() OVER (PARTITION BY record_id, path ORDER BY spot) = 1
), variants AS (
  SELECT record_id, node_path, x.i - 1 AS item_no, x.j AS item FROM (
    SELECT record_id, node_path, unnest(list_transform({_ITEMS("json_extract(node, '$.variants')")}, lambda y, i: {{'i': i, 'j': y}})) AS x FROM fields WHERE json_type(node) = 'OBJECT')
  WHERE json_type(x.j) <> 'NULL'
), documents AS (
  SELECT record_id, 'extra.' || k AS node_path, {_AT("e", "k")} AS items FROM (SELECT record_id, spot, json_extract(j, '$.extra') AS e, unnest(json_keys(json_extract(j, '$.extra'))) AS k FROM records WHERE json_type(json_extract(j, '$.extra')) = 'OBJECT')
  QUALIFY row_number() OVER (PARTITION BY record_id, k ORDER BY spot) = 1
), extras AS (
  SELECT record_id, node_path, x.i - 1 AS item_no, x.j AS item FROM (SELECT record_id, node_path, unnest(list_transform({_ITEMS("items")}, lambda y, i: {{'i': i, 'j': y}})) AS x FROM documents) WHERE json_type(x.j) <> 'NULL'
), valued AS (
  SELECT record_id, node_path, CASE WHEN json_type(node) = 'OBJECT' THEN json_extract_string(node, '$.value') ELSE node ->> '$' END AS value, json_type(node) = 'OBJECT' AND coalesce(json_type(json_extract(node, '$.review_required')) = 'BOOLEAN' AND json_extract_string(node, '$.review_required') = 'true', false) AS review_required FROM fields
)"""
_JUDGED = r"""
WITH long AS (
  SELECT extraction_id, feed_id, load_no, load_id, u.field_name, nullif(regexp_replace(u.v, '^\s+|\s+$', '', 'g'), '') AS value
  FROM extractions, unnest([
    {'field_name': 'vehicle_vin', 'v': vehicle_vin.value}, {'field_name': 'odometer_reading', 'v': odometer_reading.value},
    {'field_name': 'purchase_price', 'v': purchase_price.value}, {'field_name': 'driver_dob', 'v': driver_dob.value}]) AS t(u)
), numbered AS (
  SELECT *, CASE
      WHEN field_name = 'odometer_reading' AND regexp_full_match(value, '(?i)([0-9]+|[0-9]{1,3}(,[0-9]{3})+) ?(mi|miles|km)?')
        THEN try_cast(regexp_replace(regexp_extract(value, '^[0-9,]+'), ',', '', 'g') AS DOUBLE)
      WHEN field_name = 'purchase_price' AND regexp_full_match(value, '\$? ?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]{2})?')
        THEN try_cast(regexp_replace(value, '[$ ,]', '', 'g') AS DOUBLE) END AS raw_number,
    regexp_replace(upper(value), '[- ]', '', 'g') AS vin,
    CASE WHEN regexp_full_match(value, '[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN try_cast(substr(value, 7, 4) || '-' || substr(value, 1, 2) || '-' || substr(value, 4, 2) AS DATE)
         WHEN regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(value AS DATE) END AS dob
  FROM long
), checked AS (
  SELECT *, CASE WHEN field_name = 'odometer_reading' AND raw_number <= 499999 OR field_name = 'purchase_price' AND raw_number BETWEEN 500 AND 400000 THEN raw_number END AS number,
    list_sum(list_transform(range(1, 18), lambda i: (instr('0123456789', substr(translate(vin, 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789'), i, 1)) - 1) * [8,7,6,5,4,3,2,10,0,9,8,7,6,5,4,3,2][i])) % 11 AS rest
  FROM numbered
), judged AS (
  SELECT extraction_id, feed_id, load_no, load_id, field_name, value, number, CASE WHEN field_name = 'driver_dob' AND dob BETWEEN DATE '1925-01-01' AND DATE '2009-12-31' THEN dob END AS born, CASE WHEN value IS NULL THEN NULL
      WHEN field_name = 'vehicle_vin' THEN regexp_full_match(vin, '[A-HJ-NPR-Z0-9]{17}') AND substr(vin, 9, 1) = CASE WHEN rest = 10 THEN 'X' ELSE CAST(rest AS VARCHAR) END
      WHEN field_name = 'driver_dob' THEN coalesce(dob BETWEEN DATE '1925-01-01' AND DATE '2009-12-31', false)
      ELSE number IS NOT NULL END AS ok
  FROM checked
), counts AS (
  SELECT field_name, feed_id, load_no, max(load_id) AS load_id, value, count(*) AS n FROM judged GROUP BY field_name, feed_id, load_no, value
), modes AS (
  SELECT field_name, feed_id, load_no, coalesce(max(n) FILTER (value IS NOT NULL), 0) AS mode_n, count(value) AS distinct_values FROM counts GROUP BY ALL
), loads AS (
  SELECT field_name, feed_id, load_no, max(load_id) AS load_id, count(*) AS n_rows, count(value) AS filled, count(*) FILTER (ok) AS good, median(number) FILTER (ok) AS median FROM judged GROUP BY field_name, feed_id, load_no
), profile AS (SELECT * FROM loads JOIN modes USING (field_name, feed_id, load_no))
"""

ORACLE = {
    "p1_found": _NODES
    + """ SELECT 'consolidated_records' AS source_table, record_id, node_path, -1 AS item_no FROM fields
UNION SELECT 'consolidated_records', record_id, node_path, CAST(item_no AS INTEGER) FROM variants UNION SELECT 'consolidated_records', record_id, node_path, CAST(item_no AS INTEGER) FROM extras
UNION SELECT 'extractions', extraction_id, 'extra', CAST(i - 1 AS INTEGER) FROM (SELECT extraction_id, unnest(extra) AS x, generate_subscripts(extra, 1) AS i FROM extractions) WHERE x IS NOT NULL""",
    "p1_nodes": _NODES
    + f""", told AS (
  SELECT record_id, 'field' AS kind, parent_path, node_path, -1 AS item_no, CASE WHEN json_type(node) = 'OBJECT' THEN {_PLAIN("json_extract(node, '$.value')")} ELSE node ->> '$' END AS value, CASE WHEN json_type(node) = 'OBJECT' THEN {_DOUBLE("json_extract(node, '$.confidence')")} END AS confidence,
    NULL::VARCHAR AS source_document_name, NULL::VARCHAR AS source_document_type, NULL::VARCHAR AS field_name, CASE WHEN json_type(node) = 'OBJECT' AND json_type(json_extract(node, '$.review_required')) = 'BOOLEAN' THEN json_extract_string(node, '$.review_required') = 'true' END AS review_required FROM fields
  UNION ALL
  SELECT record_id, 'variant', node_path, node_path, CAST(item_no AS INTEGER), CASE WHEN json_type(item) = 'OBJECT' THEN {_PLAIN("json_extract(item, '$.value')")} ELSE {_PLAIN("item")} END, CASE WHEN json_type(item) = 'OBJECT' THEN {_DOUBLE("json_extract(item, '$.confidence')")} END,
    CASE WHEN json_type(item) = 'OBJECT' THEN {_PLAIN("json_extract(item, '$.source_document_name')")} END, CASE WHEN json_type(item) = 'OBJECT' THEN {_PLAIN("json_extract(item, '$.source_document_type')")} END, NULL, NULL FROM variants
  UNION ALL
  SELECT record_id, 'extra', 'extra', node_path, CAST(item_no AS INTEGER), CASE WHEN json_type(item) = 'OBJECT' THEN {_PLAIN("json_extract(item, '$.value')")} ELSE {_PLAIN("item")} END, CASE WHEN json_type(item) = 'OBJECT' THEN {_DOUBLE("json_extract(item, '$.confidence')")} END,
    NULL, NULL, CASE WHEN json_type(item) = 'OBJECT' THEN {_PLAIN("json_extract(item, '$.field_name')")} END, NULL FROM extras)
SELECT * FROM told""",
    "q_record_counts": _NODES
    + """, counted AS (
  SELECT record_id, count(*) AS fields, count(*) FILTER (NOT review_required) AS accepted, 0 AS variants, 0 AS extra_items FROM valued GROUP BY record_id
  UNION ALL SELECT record_id, 0, 0, count(*), 0 FROM variants GROUP BY record_id UNION ALL SELECT record_id, 0, 0, 0, count(*) FROM extras GROUP BY record_id)
SELECT record_id, CAST(sum(fields) AS BIGINT) AS fields, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(variants) AS BIGINT) AS variants, CAST(sum(extra_items) AS BIGINT) AS extra_items FROM counted GROUP BY record_id""",
    "q_record_values": _NODES
    + """, picked AS (SELECT record_id, node_path, trim(value) AS v FROM valued WHERE trim(value) <> '')
SELECT record_id, max(v) FILTER (node_path = 'vehicle_vin') AS vin, coalesce(max(v) FILTER (node_path = 'owner.full_name'), max(v) FILTER (node_path = 'owner.name'), max(v) FILTER (node_path = 'owner[0].full_name')) AS owner,
  coalesce(max(v) FILTER (node_path = 'owner.address.city'), max(v) FILTER (node_path = 'lessee.address.city')) AS city, max(v) FILTER (node_path = 'lienholder.name') AS lienholder
FROM picked WHERE node_path IN ('vehicle_vin', 'owner.full_name', 'owner.name', 'owner[0].full_name', 'owner.address.city', 'lessee.address.city', 'lienholder.name') GROUP BY record_id""",
    "p2_profile": _JUDGED
    + "SELECT field_name, feed_id, load_no, load_id, n_rows, filled, distinct_values, CAST(mode_n AS BIGINT) AS mode_n, good, round(median, 3) AS median FROM profile",
    "p2_ranges": _JUDGED
    + """SELECT field_name, feed_id, load_no, max(load_id) AS load_id, min(number) AS min_number, max(number) AS max_number,
  min(dob) FILTER (field_name = 'driver_dob' AND dob BETWEEN DATE '1925-01-01' AND DATE '2009-12-31') AS min_date,
  max(dob) FILTER (field_name = 'driver_dob' AND dob BETWEEN DATE '1925-01-01' AND DATE '2009-12-31') AS max_date
FROM checked GROUP BY field_name, feed_id, load_no""",
    "p2_frequencies": _JUDGED + "SELECT field_name, feed_id, load_no, max(load_id) AS load_id, value, count(*) AS n FROM judged GROUP BY field_name, feed_id, load_no, value",
    "p2_stability": _JUDGED
    + """, tagged AS (SELECT field_name, feed_id, load_no, unnest([
    {'kind': 'psi', 'class': CASE WHEN value IS NULL THEN 'missing' WHEN number IS NOT NULL THEN 'number ' || CAST(CAST(floor(2 * log2(number + 1)) AS BIGINT) AS VARCHAR) WHEN born IS NOT NULL THEN 'date ' || CAST(year(born) // 5 AS VARCHAR) ELSE 'value ' || value END},
    {'kind': 'psi_shape', 'class': coalesce(regexp_replace(regexp_replace(upper(value), '[A-Z]+', 'A', 'g'), '[0-9]+', '9', 'g'), 'missing')},
    {'kind': 'psi_state', 'class': CASE WHEN value IS NULL THEN 'missing' WHEN ok THEN 'well-formed' ELSE 'malformed' END}]) AS c FROM judged
), classes AS (SELECT field_name, feed_id, load_no, c.kind AS kind, c.class AS class, count(*) AS n FROM tagged GROUP BY ALL
), pairs AS (
  SELECT field_name, feed_id, load_no, n_rows AS total, lag(load_no) OVER w AS p_load_no, lag(n_rows) OVER w AS p_total FROM loads WINDOW w AS (PARTITION BY field_name, feed_id ORDER BY load_no)
), sides AS (
  SELECT p.field_name, p.feed_id, p.load_no, total, p_total, kind, class, n, NULL AS p_n FROM pairs p JOIN classes c ON c.field_name = p.field_name AND c.feed_id = p.feed_id AND c.load_no = p.load_no WHERE p_load_no IS NOT NULL
  UNION ALL
  SELECT p.field_name, p.feed_id, p.load_no, total, p_total, kind, class, NULL, n FROM pairs p JOIN classes c ON c.field_name = p.field_name AND c.feed_id = p.feed_id AND c.load_no = p.p_load_no WHERE p_load_no IS NOT NULL
), both_sides AS (SELECT field_name, feed_id, load_no, kind, class, coalesce(max(n), 0.5::DOUBLE) / max(total) AS p, coalesce(max(p_n), 0.5::DOUBLE) / max(p_total) AS q FROM sides GROUP BY ALL
), parts AS (SELECT *, (p - q) * ln(p / q) AS part FROM both_sides)
SELECT field_name, feed_id, load_no, round(sum(part) FILTER (kind = 'psi'), 6) AS psi, round(sum(part) FILTER (kind = 'psi_shape'), 6) AS psi_shape, round(sum(part) FILTER (kind = 'psi_state'), 6) AS psi_state FROM parts GROUP BY field_name, feed_id, load_no""",
    "p2_found": _JUDGED
    + """, lagged AS (
  SELECT *, lag(n_rows) OVER w AS p_rows, lag(filled) OVER w AS p_filled, lag(mode_n) OVER w AS p_mode, lag(good) OVER w AS p_good, lag(median) OVER w AS p_median
  FROM profile WINDOW w AS (PARTITION BY field_name, feed_id ORDER BY load_no)
)
SELECT DISTINCT field_name, 'row' AS scope, extraction_id AS key_id FROM judged WHERE NOT ok
UNION
SELECT field_name, 'load', load_id FROM lagged
WHERE filled / n_rows > 2 * (p_filled / p_rows) OR filled / n_rows < (p_filled / p_rows) / 2
   OR filled >= 20 AND p_filled >= 20 AND abs(mode_n / filled - p_mode / p_filled) > 0.15
   OR field_name IN ('odometer_reading', 'purchase_price') AND good >= 20 AND p_good >= 20 AND (median > 1.5 * p_median OR median < p_median / 1.5)""",
}
