"""Reports of a run as rows of text, one per line, so that they can be written, filtered and joined like any other result.

Lines of a packet are numbered by what they say, not by how many there are; a packet without pages or documents has the
lines that still hold. Nulls in names and ids are written as nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetflow.operators import classification as C


def _listed(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")


def packet_lines(packets: DataFrame) -> DataFrame:
    """packet_id, line_no, line: page coverage and contiguity of every packet."""
    c = C.page_coverage(packets)
    covered = F.col("total_pages") - F.size("missing")
    pages = lambda name, col: F.when(F.size(col) > 0, F.concat(F.lit(f"  {name} pages: "), _listed(F.col(col))))
    lines = [F.when(F.col("total_pages") >= 0, F.concat(F.lit("Page coverage: "), covered.cast("string"), F.lit("/"), F.col("total_pages").cast("string"), F.lit(" pages accounted for"))), pages("Missing", "missing"), pages("Duplicate", "duplicate"), pages("Invalid", "invalid"), F.when(F.col("is_complete"), F.lit("  All pages are uniquely covered."))]
    coverage = c.select("packet_id", F.posexplode(F.array(*lines)).alias("line_no", "line")).filter("line is not null").withColumn("line_no", F.col("line_no") + 1)
    issues = C.contiguity_conflicts(packets)
    head = packets.select("packet_id").join(issues.select("packet_id").distinct().withColumn("broken", F.lit(True)), "packet_id", "left")
    head = head.select("packet_id", F.lit(6).alias("line_no"), F.when(F.col("broken"), "Document contiguity issues:").otherwise("Document contiguity: all documents have valid page grouping.").alias("line"))
    named = C.documents(packets).select("packet_id", "doc_ord", "doc_name", "pages")
    text = F.concat(F.lit("  - ["), F.coalesce("doc_id", F.lit("")), F.lit("] "), F.coalesce("doc_name", F.lit("")), F.lit(" (pages="), _listed(F.col("pages")), F.lit(") spans other documents on pages: "), _listed(F.col("conflicting")))
    each = issues.join(named, ["packet_id", "doc_ord"]).select("packet_id", (F.col("doc_ord") + 7).alias("line_no"), text.alias("line"))
    return coverage.unionByName(head).unionByName(each)


def usage_text(input_tokens: Column, output_tokens: Column, total_tokens: Column, cached_tokens: Column, model: Column) -> Column:
    """1,200 input, 30 output, 1,230 total, 5 cached input, model=m; cached tokens and the model only where there are any."""
    n = lambda c, what: F.concat(F.format_number(c, 0), F.lit(f" {what}"))
    parts = F.array(n(input_tokens, "input"), n(output_tokens, "output"), n(total_tokens, "total"), F.when(cached_tokens > 0, n(cached_tokens, "cached input")), F.when(model != "", F.concat(F.lit("model="), model)))
    return F.array_join(parts, ", ")


def exclusion_lines(packets: DataFrame) -> DataFrame:
    """packet_id, line_no, line of the documents that debug runs leave out; packets without any have no line."""
    found = C.exclusions(C.documents(packets))
    head = found.groupBy("packet_id").agg(F.count("*").alias("n")).select("packet_id", F.lit(0).alias("line_no"), F.concat(F.lit("Debug exclusions ("), F.col("n").cast("string"), F.lit("): classified and preprocessed, excluded from further processing")).alias("line"))
    text = F.concat(F.lit("  - ["), F.coalesce("doc_id", F.lit("")), F.lit("] "), F.coalesce("doc_name", F.lit("")), F.lit(" (type="), F.col("doc_type"), F.lit(", pages="), _listed(F.col("pages")), F.lit("): "), F.col("reason"))
    return head.unionByName(found.select("packet_id", (F.col("doc_ord") + 1).alias("line_no"), text.alias("line")))
