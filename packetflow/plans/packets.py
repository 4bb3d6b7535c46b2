"""Queries over packet classifications and runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetflow.functions.refdata import EMBEDDED_CARD_TYPES, FULL_PAGE_TYPES, SKIP_APPEND, SKIP_EXTRACT
from packetflow.functions.scalars import backoff_seconds
from packetflow.operators import assembly, chunks, classification as C, runs
from packetflow.operators import reports
from packetflow.sources import providers, schemas
from packetflow.sources.tables import table


def _joined(pages: str) -> Column:
    return F.array_join(F.transform(pages, lambda p: p.cast("string")), ",")


def q_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return C.normalized(table(spark, folder, "packets")).select("packet_id", F.coalesce(F.size("classified"), F.lit(0)).cast("bigint").alias("n_documents"), _joined("empty_pages").alias("empty_pages"))


def q_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = C.modes(C.documents(table(spark, folder, "packets")))
    return found.select("packet_id", "doc_ord", "doc_id", "doc_type", "mode", F.size("pages").cast("bigint").alias("n_pages"), C.is_blank_name(F.col("doc_name")).alias("is_blank_name"))


def q_page_coverage(spark: SparkSession, folder: str) -> DataFrame:
    found = C.page_coverage(table(spark, folder, "packets"))
    return found.select("packet_id", _joined("missing").alias("missing"), _joined("duplicate").alias("duplicate"), _joined("invalid").alias("invalid"), "is_complete")


def q_contiguity(spark: SparkSession, folder: str) -> DataFrame:
    found = C.contiguity_conflicts(table(spark, folder, "packets"))
    return found.select("packet_id", "doc_ord", "doc_id", "first_page", "last_page", _joined("conflicting").alias("conflicting"))


def q_validity(spark: SparkSession, folder: str) -> DataFrame:
    return C.validity(table(spark, folder, "packets"))


def q_recovery_targets(spark: SparkSession, folder: str) -> DataFrame:
    return C.recovery_targets(table(spark, folder, "packets"))


def q_recovered_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All empty pages taken as pages with content, attached one after the other."""
    return C.recovered(table(spark, folder, "packets"), F.coalesce("empty_pages", F.array().cast("array<int>")))


def q_file_names(spark: SparkSession, folder: str) -> DataFrame:
    docs = C.documents(table(spark, folder, "packets"))
    return docs.select("packet_id", "doc_ord", C.file_name(F.col("doc_name")).alias("file_name"))


def q_unique_file_names(spark: SparkSession, folder: str) -> DataFrame:
    return C.unique_file_names(table(spark, folder, "packets"))


def q_file_types(spark: SparkSession, folder: str) -> DataFrame:
    return C.file_types(table(spark, folder, "packets"))


def q_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents left out of debug runs, with the reason."""
    return C.exclusions(C.documents(table(spark, folder, "packets"))).select("packet_id", "doc_ord", "doc_type", "reason")


def q_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """What is asked of a model for every document without an extraction."""
    packets = table(spark, folder, "packets")
    missing = assembly.unextracted(packets, table(spark, folder, "extractions"), SKIP_EXTRACT)
    asked = schemas.prompts(missing.join(packets.select("packet_id", "pdf_path"), "packet_id"))
    return asked.select("packet_id", "doc_ord", "doc_type", F.length("prompt").cast("bigint").alias("prompt_chars"), F.contains("prompt", F.lit("not known")).alias("open_type"))


def q_usage_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Events as model calls whose usage comes in two shapes of JSON, one of them without its total at times."""
    e = table(spark, folder, "events")
    tokens, made, cached = F.round(F.col("value") * 1000).cast("bigint"), F.col("event_id") % 900, F.col("event_id") % 5000
    one = F.to_json(F.struct(tokens.alias("input_tokens"), made.alias("output_tokens"), (tokens + made).alias("total_tokens"), F.struct(cached.alias("cached_tokens")).alias("input_tokens_details")))
    other = F.to_json(F.struct(tokens.alias("prompt_token_count"), made.alias("candidates_token_count"), F.when(F.col("event_id") % 4 == 0, tokens + made + 1).alias("total_token_count"), cached.alias("cached_content_token_count")))
    parsed = providers.usage(F.when(F.col("event_id") % 2 == 0, other).when(F.col("event_id") % 5 != 0, one), F.col("event_type"))
    return e.select("event_id", parsed.alias("u")).select("event_id", "u.*")


def q_usage_text(spark: SparkSession, folder: str) -> DataFrame:
    """Usage totals as the line a report prints."""
    t = q_usage_totals(spark, folder)
    return t.select("event_type", reports.usage_text(F.col("input_tokens"), F.col("output_tokens"), F.col("input_tokens") + F.col("output_tokens"), F.col("cached_tokens"), F.col("model")).alias("line"))


def q_exclusion_lines(spark: SparkSession, folder: str) -> DataFrame:
    return reports.exclusion_lines(table(spark, folder, "packets"))


def q_report_lines(spark: SparkSession, folder: str) -> DataFrame:
    return reports.packet_lines(table(spark, folder, "packets"))


def q_excluded(spark: SparkSession, folder: str) -> DataFrame:
    return C.excluded(C.documents(table(spark, folder, "packets")), SKIP_EXTRACT).select("packet_id", "doc_ord", "doc_type")


def q_processable(spark: SparkSession, folder: str) -> DataFrame:
    return C.processable(C.documents(table(spark, folder, "packets")), SKIP_EXTRACT).select("packet_id", "doc_ord", "doc_type")


def q_appendable(spark: SparkSession, folder: str) -> DataFrame:
    return C.processable(C.documents(table(spark, folder, "packets")), SKIP_APPEND).select("packet_id", "doc_ord", "doc_type")


def q_pending_packets(spark: SparkSession, folder: str) -> DataFrame:
    return runs.pending(table(spark, folder, "packets"), table(spark, folder, "consolidated_records")).select("packet_id", runs.stem(F.col("pdf_path")).alias("path_stem"))


def q_run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_summary(table(spark, folder, "packets"))


def q_shared_stems(spark: SparkSession, folder: str) -> DataFrame:
    return runs.shared_stems(table(spark, folder, "packets"))


def q_usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Events as model calls: value in thousandths are input tokens."""
    tokens = F.round(F.col("value") * 1000).cast("bigint")
    calls = table(spark, folder, "events").select("event_type", F.col("event_id").alias("ord"), tokens.alias("input_tokens"), (F.col("event_id") % 5000).alias("cached_tokens"), (F.col("event_id") % 900).alias("output_tokens"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string"))).alias("model"))
    return runs.usage_totals(calls, ["event_type"])


def q_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Events as attempts: errors are dropped connections."""
    e = table(spark, folder, "events")
    return e.select("event_id", backoff_seconds((F.col("event_id") % 4).cast("double"), 1.0, F.col("event_type") == "error").alias("delay_s"))


def q_upload_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a packet in order, in chunks of at most 2,000 characters."""
    return chunks.greedy_chunks(table(spark, folder, "documents"), "packet_id", "doc_id", "n_chars", 2_000)


def q_split_plan(spark: SparkSession, folder: str) -> DataFrame:
    found = assembly.split_plan(table(spark, folder, "packets"))
    return found.select("packet_id", "doc_ord", "status", _joined("pages").alias("pages"))


def q_packet_parts(spark: SparkSession, folder: str) -> DataFrame:
    return assembly.packet_parts(table(spark, folder, "packets"), ("cover", "application", "registration", "ownership"), SKIP_APPEND)


def q_unextracted(spark: SparkSession, folder: str) -> DataFrame:
    return assembly.unextracted(table(spark, folder, "packets"), table(spark, folder, "extractions"), SKIP_EXTRACT).select("packet_id", "doc_ord", "doc_type")


QUERIES = {f.__name__: f for f in (q_split_plan, q_packet_parts, q_unextracted, q_normalized, q_documents, q_page_coverage, q_contiguity, q_validity, q_recovery_targets, q_recovered_pages, q_file_names, q_unique_file_names, q_file_types, q_exclusions, q_prompts, q_usage_parsed, q_usage_text, q_report_lines, q_exclusion_lines, q_excluded, q_processable, q_appendable, q_pending_packets, q_run_summary, q_shared_stems, q_usage_totals, q_backoff, q_upload_chunks)}

_BLANK = "regexp_matches(coalesce(d.name, ''), '\\b(blank|separator|seperator|empty\\s+page|empty|divider|unused|no\\s+content|intentionally\\s+blank)\\b', 'i')"
_list = lambda names: ", ".join(f"'{n}'" for n in names)
_DOCS = """
WITH docs AS (
  SELECT packet_id, CAST(ord - 1 AS INTEGER) AS doc_ord, d.id AS doc_id, d.name AS doc_name, d.type AS doc_type, list_sort(list_filter(coalesce(d.pages, []), lambda p: p IS NOT NULL)) AS pages, d
  FROM (SELECT packet_id, unnest(classified) AS d, generate_subscripts(classified, 1) AS ord FROM packets) WHERE d IS NOT NULL
), owned AS (SELECT packet_id, doc_ord, unnest(pages) AS page FROM docs
), empties AS (SELECT packet_id, unnest(empty_pages) AS page FROM packets
)"""
_COVER = (
    _DOCS
    + """, claims AS (SELECT packet_id, page FROM owned UNION ALL SELECT packet_id, page FROM empties WHERE page IS NOT NULL
), per AS (SELECT packet_id, page, count(*) AS n FROM claims GROUP BY packet_id, page
), missing AS (SELECT packet_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS missing FROM (SELECT packet_id, unnest(range(1, total_pages + 1)) AS p FROM packets) x ANTI JOIN per ON per.packet_id = x.packet_id AND per.page = x.p GROUP BY packet_id
), dup AS (SELECT packet_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS duplicate FROM per WHERE n > 1 GROUP BY packet_id
), bad AS (SELECT packet_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS invalid FROM per JOIN packets USING (packet_id) WHERE total_pages >= 1 AND (page < 1 OR page > total_pages) GROUP BY packet_id
), cover AS (
  SELECT packet_id, coalesce(missing, '') AS missing, coalesce(duplicate, '') AS duplicate, coalesce(invalid, '') AS invalid, coalesce(total_pages >= 1, false) AND missing IS NULL AND duplicate IS NULL AND invalid IS NULL AS is_complete
  FROM packets LEFT JOIN missing USING (packet_id) LEFT JOIN dup USING (packet_id) LEFT JOIN bad USING (packet_id)
), spans AS (SELECT packet_id, doc_ord, doc_id, list_min(pages) AS first_page, list_max(pages) AS last_page FROM docs WHERE len(pages) > 1
), conflicts AS (
  SELECT s.packet_id, s.doc_ord, s.doc_id, s.first_page, s.last_page, string_agg(DISTINCT CAST(o.page AS VARCHAR), ',' ORDER BY lpad(CAST(o.page AS VARCHAR), 9, '0')) AS conflicting
  FROM spans s JOIN owned o ON o.packet_id = s.packet_id AND o.page > s.first_page AND o.page < s.last_page
  WHERE NOT EXISTS (SELECT 1 FROM owned w WHERE w.packet_id = s.packet_id AND w.doc_ord = s.doc_ord AND w.page = o.page)
    AND NOT EXISTS (SELECT 1 FROM empties e WHERE e.packet_id = s.packet_id AND e.page = o.page)
  GROUP BY ALL
)"""
)

_FILE_NAME = r"""coalesce(nullif(substr(regexp_replace(trim(regexp_replace(replace(strip_accents(doc_name), chr(160), ' '), '[^A-Za-z0-9_\s\-().]', '', 'g'), E' \t\n\r'), '\s+', '_', 'g'), 1, 120), ''), 'document')"""
_NAMED = (
    _DOCS.replace("WITH docs", "WITH RECURSIVE docs", 1)
    + f""", bases AS (SELECT packet_id, doc_ord, doc_type, {_FILE_NAME} AS base, row_number() OVER (PARTITION BY packet_id ORDER BY doc_ord) AS k FROM docs
), given AS (
  SELECT packet_id, k, base AS file_name, [base] AS used FROM bases WHERE k = 1
  UNION ALL
  SELECT packet_id, k, file_name, list_append(used, file_name) FROM (
    SELECT b.packet_id, b.k, g.used, list_filter(list_transform(range(1, len(g.used) + 2), lambda n: CASE WHEN n = 1 THEN b.base ELSE b.base || '_' || CAST(n AS VARCHAR) END), lambda t: NOT list_contains(g.used, t))[1] AS file_name
    FROM given g JOIN bases b ON b.packet_id = g.packet_id AND b.k = g.k + 1)
), named AS (SELECT packet_id, doc_ord, CAST(k - 1 AS INTEGER) AS at_, doc_type, file_name FROM bases JOIN given USING (packet_id, k))"""
)
_USAGE = """WITH calls AS (SELECT event_type, event_id AS ord, CAST(round(value * 1000) AS BIGINT) AS input_tokens, event_id % 5000 AS cached_tokens, event_id % 900 AS output_tokens, CASE WHEN event_id % 7 <> 0 THEN 'm' || CAST(event_id % 5 AS VARCHAR) END AS model FROM events
), totals AS (SELECT event_type, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(least(cached_tokens, input_tokens)) AS BIGINT) AS cached_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, arg_min(model, ord) FILTER (model IS NOT NULL) AS model FROM calls GROUP BY event_type)"""

ORACLE = {
    "q_unique_file_names": _NAMED + " SELECT packet_id, at_ AS doc_ord, file_name FROM named",
    "q_file_types": _NAMED + " SELECT packet_id, file_name, doc_type FROM named",
    "q_packet_parts": _NAMED
    + f""" SELECT packet_id, CAST(i - 1 AS INTEGER) AS ord, part FROM (SELECT packet_id, unnest(['cover', 'application', 'registration', 'ownership']) AS part, unnest([1, 2, 3, 4]) AS i FROM packets)
UNION ALL SELECT packet_id, CAST(at_ + 4 AS INTEGER), file_name FROM named WHERE doc_type IS NULL OR doc_type NOT IN ({_list(SKIP_APPEND)})""",
    "q_exclusions": _DOCS + f" SELECT packet_id, doc_ord, doc_type, replace(doc_type, '_', ' ') || ': written by the pipeline, no input' || CASE WHEN doc_type IN ({_list(SKIP_EXTRACT)}) THEN '' ELSE '; read, not appended' END AS reason FROM docs WHERE doc_type IN ({_list(SKIP_APPEND)})",
    "q_usage_parsed": """WITH calls AS (SELECT event_id, event_type AS model, CAST(round(value * 1000) AS BIGINT) AS t, event_id % 900 AS o, event_id % 5000 AS c FROM events)
SELECT event_id, model, CASE WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN 0 ELSE t END AS input_tokens, CASE WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN 0 ELSE o END AS output_tokens, CASE WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN 0 ELSE c END AS cached_tokens,
  CASE WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN 0 WHEN event_id % 4 = 0 THEN t + o + 1 ELSE t + o END AS total_tokens FROM calls""",
    "q_report_lines": _COVER
    + """, spelled AS (
  SELECT packet_id, 1 AS line_no, 'Page coverage: ' || CAST(total_pages - CASE WHEN missing = '' THEN 0 ELSE len(string_split(missing, ',')) END AS VARCHAR) || '/' || CAST(total_pages AS VARCHAR) || ' pages accounted for' AS line FROM cover JOIN packets USING (packet_id) WHERE total_pages >= 0
  UNION ALL SELECT packet_id, 2, '  Missing pages: ' || replace(missing, ',', ', ') FROM cover WHERE missing <> ''
  UNION ALL SELECT packet_id, 3, '  Duplicate pages: ' || replace(duplicate, ',', ', ') FROM cover WHERE duplicate <> ''
  UNION ALL SELECT packet_id, 4, '  Invalid pages: ' || replace(invalid, ',', ', ') FROM cover WHERE invalid <> ''
  UNION ALL SELECT packet_id, 5, '  All pages are uniquely covered.' FROM cover WHERE is_complete
  UNION ALL SELECT packet_id, 6, CASE WHEN packet_id IN (SELECT packet_id FROM conflicts) THEN 'Document contiguity issues:' ELSE 'Document contiguity: all documents have valid page grouping.' END FROM packets
  UNION ALL SELECT c.packet_id, 7 + c.doc_ord, '  - [' || coalesce(c.doc_id, '') || '] ' || coalesce(d.doc_name, '') || ' (pages=' || array_to_string(d.pages, ', ') || ') spans other documents on pages: ' || replace(c.conflicting, ',', ', ')
    FROM conflicts c JOIN docs d ON d.packet_id = c.packet_id AND d.doc_ord = c.doc_ord
) SELECT packet_id, CAST(line_no AS INTEGER) AS line_no, line FROM spelled""",
    "q_normalized": _DOCS
    + f""", blank AS (SELECT packet_id, unnest(pages) AS page FROM docs WHERE {_BLANK}
), gone AS (SELECT packet_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS empty_pages FROM (SELECT packet_id, page FROM blank UNION SELECT packet_id, page FROM empties WHERE page IS NOT NULL) GROUP BY packet_id
), kept AS (SELECT packet_id, count(*) AS n_documents FROM docs WHERE NOT {_BLANK} GROUP BY packet_id)
SELECT packet_id, coalesce(n_documents, 0) AS n_documents, coalesce(g.empty_pages, '') AS empty_pages FROM packets LEFT JOIN kept USING (packet_id) LEFT JOIN gone g USING (packet_id)""",
    "q_documents": _DOCS
    + f""" SELECT packet_id, doc_ord, doc_id, doc_type, CASE WHEN doc_type IN ({_list(EMBEDDED_CARD_TYPES)}) THEN 'embedded_card' WHEN doc_type IN ({_list(FULL_PAGE_TYPES)}) THEN 'full_page_form' ELSE 'default' END AS mode, len(pages) AS n_pages, {_BLANK} AS is_blank_name FROM docs""",
    "q_page_coverage": _COVER + " SELECT * FROM cover",
    "q_contiguity": _COVER + " SELECT * FROM conflicts",
    "q_validity": _COVER + " SELECT packet_id, is_complete, packet_id NOT IN (SELECT packet_id FROM conflicts) AS is_contiguous, is_complete AND packet_id NOT IN (SELECT packet_id FROM conflicts) AS is_valid FROM cover",
    "q_recovery_targets": _DOCS
    + """, asked AS (SELECT DISTINCT packet_id, page AS page_no FROM empties WHERE page IS NOT NULL
), renumbered AS (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY doc_ord) - 1 AS pos FROM docs
), ranked AS (
  SELECT a.packet_id, a.page_no, r.pos, CASE WHEN list_contains(r.pages, a.page_no - 1) THEN 1 WHEN list_max(r.pages) < a.page_no THEN 2 WHEN list_min(r.pages) > a.page_no THEN 3 ELSE 4 END AS rule,
    CASE WHEN list_contains(r.pages, a.page_no - 1) THEN r.pos WHEN list_max(r.pages) < a.page_no THEN -list_max(r.pages) WHEN list_min(r.pages) > a.page_no THEN list_min(r.pages) ELSE r.pos END AS nearest
  FROM asked a JOIN renumbered r ON r.packet_id = a.packet_id
), best AS (SELECT *, row_number() OVER (PARTITION BY packet_id, page_no ORDER BY rule, nearest, pos) AS k FROM ranked)
SELECT packet_id, page_no, CAST(b.pos AS INTEGER) AS doc_ord FROM asked LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (packet_id, page_no)""",
    "q_file_names": _DOCS + r""" SELECT packet_id, doc_ord, coalesce(nullif(substr(regexp_replace(trim(regexp_replace(replace(strip_accents(doc_name), chr(160), ' '), '[^A-Za-z0-9_\s\-().]', '', 'g'), E' \t\n\r'), '\s+', '_', 'g'), 1, 120), ''), 'document') AS file_name FROM docs""",
    "q_split_plan": _DOCS
    + """, judged AS (
  SELECT d.packet_id, d.doc_ord, coalesce(len(list_filter(d.pages, lambda p: p < 1 OR p > p0.total_pages)) > 0 OR p0.total_pages IS NULL AND len(d.pages) > 0, false) AS outside,
    list_sort(list_distinct(list_filter(d.pages, lambda p: NOT list_contains(coalesce(p0.empty_pages, []), p)))) AS kept
  FROM docs d JOIN packets p0 USING (packet_id))
SELECT packet_id, doc_ord, CASE WHEN outside THEN 'failed' WHEN len(kept) = 0 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN outside OR len(kept) = 0 THEN '' ELSE array_to_string(kept, ',') END AS pages FROM judged""",
    "q_unextracted": _DOCS + f" SELECT packet_id, doc_ord, doc_type FROM docs d WHERE (doc_type IS NULL OR doc_type NOT IN ({_list(SKIP_EXTRACT)})) AND NOT EXISTS (SELECT 1 FROM extractions x WHERE x.packet_id = d.packet_id AND x.document_type = d.doc_type)",
    "q_excluded": _DOCS + f" SELECT packet_id, doc_ord, doc_type FROM docs WHERE doc_type IN ({_list(SKIP_EXTRACT)})",
    "q_processable": _DOCS + f" SELECT packet_id, doc_ord, doc_type FROM docs WHERE doc_type IS NULL OR doc_type NOT IN ({_list(SKIP_EXTRACT)})",
    "q_appendable": _DOCS + f" SELECT packet_id, doc_ord, doc_type FROM docs WHERE doc_type IS NULL OR doc_type NOT IN ({_list(SKIP_APPEND)})",
    "q_pending_packets": r"SELECT packet_id, regexp_extract(pdf_path, '([^/]+?)(?:\.[^./]*)?$', 1) AS path_stem FROM packets p WHERE lower(pdf_path) LIKE '%.pdf' AND NOT EXISTS (SELECT 1 FROM consolidated_records c WHERE c.packet_id = p.packet_id)",
    "q_run_summary": "SELECT coalesce(run_status, 'unknown') AS run_status, count(*) AS packets, CAST(coalesce(sum(total_pages), 0) AS BIGINT) AS pages, count(run_error) AS with_error FROM packets GROUP BY 1",
    "q_shared_stems": r"SELECT regexp_extract(pdf_path, '([^/]+?)(?:\.[^./]*)?$', 1) AS path_stem, count(DISTINCT pdf_path) AS paths FROM packets WHERE pdf_path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT pdf_path) > 1",
    "q_usage_totals": _USAGE + " SELECT * FROM totals",
    "q_usage_text": _USAGE
    + """ SELECT event_type, format('{:,}', input_tokens) || ' input, ' || format('{:,}', output_tokens) || ' output, ' || format('{:,}', input_tokens + output_tokens) || ' total' || CASE WHEN cached_tokens > 0 THEN ', ' || format('{:,}', cached_tokens) || ' cached input' ELSE '' END
  || CASE WHEN model <> '' THEN ', model=' || model ELSE '' END AS line FROM totals""",
    "q_exclusion_lines": _DOCS
    + f""", gone AS (SELECT *, replace(doc_type, '_', ' ') || ': written by the pipeline, no input' || CASE WHEN doc_type IN ({_list(SKIP_EXTRACT)}) THEN '' ELSE '; read, not appended' END AS reason FROM docs WHERE doc_type IN ({_list(SKIP_APPEND)}))
SELECT packet_id, 0 AS line_no, 'Debug exclusions (' || CAST(count(*) AS VARCHAR) || '): classified and preprocessed, excluded from further processing' AS line FROM gone GROUP BY packet_id
UNION ALL SELECT packet_id, CAST(doc_ord + 1 AS INTEGER), '  - [' || coalesce(doc_id, '') || '] ' || coalesce(doc_name, '') || ' (type=' || doc_type || ', pages=' || array_to_string(pages, ', ') || '): ' || reason FROM gone""",
    "q_backoff": "SELECT event_id, 1.0::DOUBLE * pow(2.0, event_id % 4) * CASE WHEN event_type = 'error' THEN 3 ELSE 1 END AS delay_s FROM events",
    "q_upload_chunks": """WITH RECURSIVE parts AS (SELECT packet_id AS group_id, doc_id AS part_id, coalesce(n_chars, 0) AS size, row_number() OVER (PARTITION BY packet_id ORDER BY doc_id) AS k FROM documents WHERE packet_id IS NOT NULL
), walk AS (
  SELECT group_id, part_id, k, size AS used, 1 AS chunk_no FROM parts WHERE k = 1
  UNION ALL
  SELECT p.group_id, p.part_id, p.k, CASE WHEN w.used + p.size > 2000 THEN p.size ELSE w.used + p.size END, CASE WHEN w.used + p.size > 2000 THEN w.chunk_no + 1 ELSE w.chunk_no END FROM walk w JOIN parts p ON p.group_id = w.group_id AND p.k = w.k + 1
) SELECT group_id, part_id, CAST(chunk_no AS INTEGER) AS chunk_no FROM walk""",
}
