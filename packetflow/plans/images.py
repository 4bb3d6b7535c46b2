"""Queries over page images. The tables hold none, so pages are drawn from what they hold, as binary columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetflow.operators import raster
from packetflow.sources.tables import table

LINE, GLYPH, MARGIN, COLUMNS = 12, 6, 30, 72
#: Bytes of drawn pages from which they are handed on; a batch of texts has many more.
PART = 8_000_000


def vector_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector as a page of eight by eight pixels: white from -0.1 on, darker below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [np.where(v >= -0.1, 255, np.floor((v + 1) * 127.5)).astype(np.uint8).tobytes() for v in (np.asarray(e, float) for e in b.embedding)]
            yield pd.DataFrame({"packet_id": b.vec_id, "page_no": 1, "height": 8, "width": 8, "data": data})

    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(run, "packet_id bigint, page_no int, height int, width int, data binary")


def drawn(text: str) -> np.ndarray:
    """A text as a page: lines of COLUMNS characters, every letter or digit a dark block as wide as its kind."""
    lines = [row[i : i + COLUMNS] for row in text.split("\n") for i in range(0, max(len(row), 1), COLUMNS)]
    page = np.full((2 * MARGIN + LINE * len(lines), 2 * MARGIN + GLYPH * COLUMNS), 255, np.uint8)
    for n, line in enumerate(lines):
        at = MARGIN
        for c in line:
            wide = 3 + ord(c) % 3 if c.isalnum() else 3
            if c.isalnum():
                page[MARGIN + LINE * n : MARGIN + LINE * n + 7, at : at + wide - 1] = 40
            at += wide
    return page


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a drawn page; one in three is scanned askew, one in seven sideways."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["packet_id", "page_no", "mode", "height", "width", "data"]
        for b in batches:
            out, held = [], 0
            for i, text in zip(b.doc_id, b.text):
                page = drawn(text or "")
                page = np.rot90(page) if i % 7 == 0 else raster.rotate(page, 3.0) if i % 3 == 0 else page
                out.append((i, 1, "default", *page.shape, np.ascontiguousarray(page).tobytes()))
                held += page.size
                if held >= PART:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns)

    return table(spark, folder, "documents").select("doc_id", "text").mapInPandas(run, "packet_id bigint, page_no int, mode string, height int, width int, data binary")


def q_page_borders(spark: SparkSession, folder: str) -> DataFrame:
    return raster.page_borders(vector_pages(spark, folder))


def q_page_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Content score of every drawn page, and whether it is blank."""
    return raster.page_scores(document_pages(spark, folder)).withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (q_page_borders, q_page_scores)}

_DARK = "list_transform(range(0, 64), lambda i: CASE WHEN CAST(embedding[i + 1] AS DOUBLE) >= -0.1 THEN 0.0 ELSE 1.0 END)"
ORACLE = {
    "q_page_borders": f"""WITH dark AS (SELECT vec_id, {_DARK} AS d FROM embeddings)
SELECT vec_id AS packet_id, 1 AS page_no, list_avg(d) AS dark_share, list_avg(list_filter(d, lambda x, i: i <= 16)) AS top, list_avg(list_filter(d, lambda x, i: i > 48)) AS bottom,
  list_avg(list_filter(d, lambda x, i: (i - 1) % 8 < 2)) AS left, list_avg(list_filter(d, lambda x, i: (i - 1) % 8 > 5)) AS right FROM dark""",
}
