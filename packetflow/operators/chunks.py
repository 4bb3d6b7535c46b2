"""Greedy chunking of ordered parts under a size limit.

Parts are added to a chunk while its size stays within the limit; a part above the limit is a chunk of its own. The
state is two numbers per group, carried through rows sorted within their partition, so no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def greedy_chunks(parts: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """group_id, part_id, chunk_no from 1; null groups are left out, null sizes count as 0, ties of order are not allowed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, chunk = None, 0, 0
        for b in batches:
            numbers = []
            for g, n in zip(b.group_id, b.part_size):
                if g != at:
                    at, used, chunk = g, 0, 1
                elif used + n > limit:
                    used, chunk = 0, chunk + 1
                used += n
                numbers.append(chunk)
            yield pd.DataFrame({"group_id": b.group_id, "part_id": b.part_id, "chunk_no": numbers})

    rows = parts.select(F.col(group).cast("bigint").alias("group_id"), F.col(order).cast("bigint").alias("part_id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("part_size")).filter("group_id is not null")
    return rows.repartition("group_id").sortWithinPartitions("group_id", "part_id").mapInPandas(run, "group_id bigint, part_id bigint, chunk_no int")
