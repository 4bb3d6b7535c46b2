"""Checks and normalization of page classifications.

Packets hold their documents and page lists as arrays, so every check is a higher-order function over one row: no
explode, no shuffle, whatever the number of packets. Null lists count as empty, null pages are left out, and a packet
without a page count has no missing or invalid pages but is not valid.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from packetflow.functions.refdata import DOCUMENT_TYPES, SKIP_APPEND, SKIP_EXTRACT, preprocess_mode

#: Names of separator sheets.
BLANK_NAMES = r"(?i)\b(blank|separator|seperator|empty\s+page|empty|divider|unused|no\s+content|intentionally\s+blank)\b"
_NO_PAGES = "array<int>"


def is_blank_name(name: Column) -> Column:
    return F.coalesce(name.rlike(BLANK_NAMES), F.lit(False))


def _pages(c: Column) -> Column:
    return F.array_compact(F.coalesce(c, F.array().cast(_NO_PAGES)))


def normalized(packets: DataFrame) -> DataFrame:
    """Documents named like separator sheets removed, their pages joined to the empty pages; page lists sorted."""
    blank = F.filter("classified", lambda d: d.isNotNull() & is_blank_name(d["name"]))
    kept = F.filter("classified", lambda d: d.isNotNull() & ~is_blank_name(d["name"]))
    gone = F.flatten(F.transform(blank, lambda d: _pages(d["pages"])))
    empty = F.array_sort(F.array_distinct(F.concat(_pages(F.col("empty_pages")), F.coalesce(gone, F.array().cast(_NO_PAGES)))))
    return packets.withColumns({"empty_pages": empty, "classified": F.transform(kept, lambda d: d.withField("pages", F.array_sort(_pages(d["pages"]))))})


def documents(packets: DataFrame) -> DataFrame:
    """One row per document in list order: packet_id, doc_ord, doc_id, doc_name, doc_type, pages (sorted, repeats kept)."""
    rows = packets.select("packet_id", F.posexplode("classified").alias("doc_ord", "d")).filter("d is not null")
    return rows.select("packet_id", "doc_ord", F.col("d.id").alias("doc_id"), F.col("d.name").alias("doc_name"), F.col("d.type").alias("doc_type"), F.array_sort(_pages(F.col("d.pages"))).alias("pages"))


def _owned() -> Column:
    return F.coalesce(F.flatten(F.transform(F.filter("classified", lambda d: d.isNotNull()), lambda d: _pages(d["pages"]))), F.array().cast(_NO_PAGES))


def page_coverage(packets: DataFrame) -> DataFrame:
    """packet_id, missing, duplicate, invalid pages and is_complete: every page 1..N in one place exactly."""
    claimed = packets.select("packet_id", "total_pages", F.array_sort(F.concat(_owned(), _pages(F.col("empty_pages")))).alias("claimed"))
    n, inside = F.col("total_pages"), F.col("total_pages") >= 1
    every = F.when(inside, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast(_NO_PAGES))
    # In a sorted list a page occurs twice where it equals the one before.
    twice = F.array_distinct(F.filter("claimed", lambda p, i: (i > 0) & (p == F.get("claimed", i - 1))))
    invalid = F.when(inside, F.array_distinct(F.filter("claimed", lambda p: (p < 1) | (p > n)))).otherwise(F.array().cast(_NO_PAGES))
    found = claimed.select("packet_id", "total_pages", F.array_except(every, "claimed").alias("missing"), twice.alias("duplicate"), invalid.alias("invalid"))
    return found.withColumn("is_complete", F.coalesce(inside & (F.size("missing") == 0) & (F.size("duplicate") == 0) & (F.size("invalid") == 0), F.lit(False)))


def contiguity_conflicts(packets: DataFrame) -> DataFrame:
    """packet_id, doc_ord, doc_id, first_page, last_page, conflicting: pages of other documents strictly inside a document's span."""
    base = packets.select("packet_id", "classified", _owned().alias("owned"), _pages(F.col("empty_pages")).alias("empty"))
    rows = base.select("packet_id", "owned", "empty", F.posexplode("classified").alias("doc_ord", "d")).filter("d is not null")
    rows = rows.select("packet_id", "owned", "empty", "doc_ord", F.col("d.id").alias("doc_id"), _pages(F.col("d.pages")).alias("pages")).filter(F.size("pages") > 1)
    rows = rows.withColumns({"first_page": F.array_min("pages"), "last_page": F.array_max("pages")})
    inner = F.filter("owned", lambda p: (p > F.col("first_page")) & (p < F.col("last_page")))
    conflicting = F.array_sort(F.array_except(F.array_except(F.array_distinct(inner), "pages"), "empty"))
    return rows.withColumn("conflicting", conflicting).filter(F.size("conflicting") > 0).select("packet_id", "doc_ord", "doc_id", "first_page", "last_page", "conflicting")


def validity(packets: DataFrame) -> DataFrame:
    """packet_id, is_complete, is_contiguous, is_valid."""
    conflicts = contiguity_conflicts(packets).select("packet_id").distinct().withColumn("broken", F.lit(True))
    joined = page_coverage(packets).select("packet_id", "is_complete").join(conflicts, "packet_id", "left")
    joined = joined.select("packet_id", "is_complete", F.col("broken").isNull().alias("is_contiguous"))
    return joined.withColumn("is_valid", F.col("is_complete") & F.col("is_contiguous"))


def recovery_target(documents_: Column, page: Column) -> Column:
    """Index of the document a page would be attached to: the first with the page before, else the one that ends last
    before it, else the one that starts first after it, else the first; null without documents."""
    indexed = F.transform(documents_, lambda d, i: F.struct(i.alias("i"), _pages(d["pages"]).alias("p")))
    beside = F.filter(indexed, lambda x: F.array_contains(x["p"], page - 1))
    before = F.filter(indexed, lambda x: F.array_max(x["p"]) < page)
    after = F.filter(indexed, lambda x: F.array_min(x["p"]) > page)
    last = F.array_max(F.transform(before, lambda x: F.struct(F.array_max(x["p"]).alias("m"), (-x["i"]).alias("i"))))
    first = F.array_min(F.transform(after, lambda x: F.struct(F.array_min(x["p"]).alias("m"), x["i"].alias("i"))))
    return F.coalesce(F.get(F.transform(beside, lambda x: x["i"]), 0), -last["i"], first["i"], F.when(F.size(documents_) > 0, 0))


def recovery_targets(packets: DataFrame) -> DataFrame:
    """packet_id, page_no, doc_ord: where each empty page would go if it had content."""
    return packets.select("packet_id", F.filter("classified", lambda d: d.isNotNull()).alias("docs"), F.explode(F.array_distinct(_pages(F.col("empty_pages")))).alias("page_no")).select(
        "packet_id", "page_no", recovery_target(F.col("docs"), F.col("page_no")).alias("doc_ord")
    )


def recovered(packets: DataFrame, has_content: Column) -> DataFrame:
    """packet_id, page_no, doc_ord of the empty pages with content, attached in page order; a page just attached draws the next.

    has_content is array<int>: the empty pages of the packet whose content score says they are not empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for packet, docs, content in zip(b.packet_id, b.docs, b.content):
                pages = [sorted(int(p) for p in d) for d in docs]
                for page in sorted({int(p) for p in content}):
                    if not pages:
                        break
                    beside = [i for i, d in enumerate(pages) if page - 1 in d]
                    before = [(-d[-1], i) for i, d in enumerate(pages) if d and d[-1] < page]
                    after = [(d[0], i) for i, d in enumerate(pages) if d and d[0] > page]
                    to = beside[0] if beside else min(before)[1] if before else min(after)[1] if after else 0
                    if page not in pages[to]:
                        pages[to] = sorted([*pages[to], page])
                    out.append((packet, page, to))
            yield pd.DataFrame(out, columns=["packet_id", "page_no", "doc_ord"])

    docs = F.transform(F.filter("classified", lambda d: d.isNotNull()), lambda d: _pages(d["pages"]))
    rows = packets.select("packet_id", docs.alias("docs"), has_content.alias("content")).filter(F.size("content") > 0)
    return rows.mapInPandas(run, "packet_id bigint, page_no int, doc_ord int")


def file_name(name: Column) -> Column:
    """A name for a file: letters, digits, - ( ) . and _ for spaces; at most 120 characters, document when nothing is left.

    Accented Latin letters lose their accents; what has no plain form is dropped.
    """
    accents = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    plain = F.translate(name, accents, "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")
    kept = F.regexp_replace(F.regexp_replace(plain, r"\x{A0}", " "), r"[^A-Za-z0-9_\s\-().]", "")
    joined = F.regexp_replace(F.btrim(kept, F.lit(" \t\n\r\f\v")), r"\s+", "_")
    return F.coalesce(F.nullif(F.substring(joined, 1, 120), F.lit("")), F.lit("document"))


def unique_file_names(packets: DataFrame) -> DataFrame:
    """packet_id, doc_ord, file_name: base, base_2, base_3 ... in list order, skipping names that are taken."""
    bases = packets.select("packet_id", F.transform(F.filter("classified", lambda d: d.isNotNull()), lambda d: file_name(d["name"])).alias("bases"))

    def add(used: Column, base: Column) -> Column:
        # Only names that begin alike can be in the way, so one more try than there are of them is enough.
        tries = F.transform(F.sequence(F.lit(1), F.size(F.filter(used, lambda u: F.startswith(u, base))) + 1), lambda k: F.when(k == 1, base).otherwise(F.concat(base, F.lit("_"), k.cast("string"))))
        return F.concat(used, F.array(F.get(F.filter(tries, lambda t: ~F.array_contains(used, t)), 0)))

    names = F.aggregate("bases", F.array().cast("array<string>"), add)
    return bases.select("packet_id", F.posexplode(names).alias("doc_ord", "file_name"))


def modes(documents_: DataFrame) -> DataFrame:
    """documents with the way their pages are repaired."""
    known = F.create_map(*[F.lit(x) for t in DOCUMENT_TYPES for x in (t, preprocess_mode(t))])
    return documents_.withColumn("mode", F.coalesce(known[F.col("doc_type")], F.lit("default")))


def excluded(documents_: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    return documents_.filter(F.col("doc_type").isin(*skip))


def processable(documents_: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    """Documents of no skipped type; a null type is processed."""
    return documents_.filter(F.coalesce(~F.col("doc_type").isin(*skip), F.lit(True)))


def exclusion_reason(document_type: Column) -> Column:
    """Why a type is left out of debug runs: the pipeline writes such papers itself; null for others."""
    by_type = {t: f"{t.replace('_', ' ')}: written by the pipeline, no input" + ("" if t in SKIP_EXTRACT else "; read, not appended") for t in SKIP_APPEND}
    return F.create_map(*[F.lit(x) for pair in by_type.items() for x in pair])[document_type]


def exclusions(documents_: DataFrame) -> DataFrame:
    """Documents left out of debug runs, with the reason."""
    return documents_.withColumn("reason", exclusion_reason(F.col("doc_type"))).filter("reason is not null")


def file_types(packets: DataFrame) -> DataFrame:
    """packet_id, file_name, doc_type: which type the file of a document holds."""
    typed = packets.select("packet_id", F.posexplode(F.filter("classified", lambda d: d.isNotNull())).alias("doc_ord", "d")).select("packet_id", "doc_ord", F.col("d.type").alias("doc_type"))
    return unique_file_names(packets).join(typed, ["packet_id", "doc_ord"]).select("packet_id", "file_name", "doc_type")
