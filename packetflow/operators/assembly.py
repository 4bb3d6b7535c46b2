"""Plans for splitting packets into documents and for putting packets together again; writing is left to a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packetflow.operators.classification import documents, processable, unique_file_names


def split_plan(packets: DataFrame) -> DataFrame:
    """packet_id, doc_ord, status, pages: pages to copy into each document's file.

    Pages the packet lists as empty are left out and repeats copied once; a document with a page outside 1..N has status
    failed and no pages, one with nothing left is skipped.
    """
    docs = documents(packets).join(packets.select("packet_id", "total_pages", "empty_pages"), "packet_id")
    outside = F.exists("pages", lambda p: (p < 1) | (p > F.col("total_pages")))
    kept = F.array_except("pages", F.coalesce("empty_pages", F.array().cast("array<int>")))
    status = F.when(F.coalesce(outside, F.lit(True)), "failed").when(F.size(kept) == 0, "skipped").otherwise("ok")
    return docs.select("packet_id", "doc_ord", status.alias("status"), kept.alias("kept")).select("packet_id", "doc_ord", "status", F.when(F.col("status") == "ok", F.col("kept")).otherwise(F.array().cast("array<int>")).alias("pages"))


def packet_parts(packets: DataFrame, forms: tuple[str, ...], skip: tuple[str, ...]) -> DataFrame:
    """packet_id, ord, part: the forms in order, then the files of documents that may be appended."""
    first = packets.select("packet_id", F.posexplode(F.array(*[F.lit(f) for f in forms])).alias("ord", "part"))
    named = processable(documents(packets), skip).join(unique_file_names(packets), ["packet_id", "doc_ord"])
    return first.unionByName(named.select("packet_id", (F.col("doc_ord") + len(forms)).alias("ord"), F.col("file_name").alias("part")))


def unextracted(packets: DataFrame, extractions: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    """Documents that should have been read and have no extraction of their type in their packet; a null type matches none."""
    done = extractions.select("packet_id", F.col("document_type").alias("doc_type")).distinct()
    return processable(documents(packets), skip).join(done, ["packet_id", "doc_type"], "left_anti")


def record_counts(nodes: DataFrame) -> DataFrame:
    """record_id, fields, accepted, variants, extra_items: of flattened records; a field without the flag counts as accepted."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    accepted = F.count_if((F.col("kind") == "field") & ~F.coalesce("review_required", F.lit(False)))
    return nodes.groupBy("record_id").agg(of("field").alias("fields"), accepted.alias("accepted"), of("variant").alias("variants"), of("extra").alias("extra_items"))


def record_values(nodes: DataFrame, paths: dict[str, tuple[str, ...]]) -> DataFrame:
    """record_id and one column per name: the first path of it that holds a value; other paths are filtered before the shuffle."""
    wanted = [p for ps in paths.values() for p in ps]
    fields = nodes.filter((F.col("kind") == "field") & F.col("node_path").isin(*wanted) & (F.trim("value") != ""))
    pick = lambda p: F.max(F.when(F.col("node_path") == p, F.trim("value")))
    return fields.groupBy("record_id").agg(*[F.coalesce(*[pick(p) for p in ps]).alias(name) for name, ps in paths.items()])
