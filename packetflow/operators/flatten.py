"""Deeply nested records to related flat tables.

Lists are flattened on Arrow buffers: list offsets give each child its parent index and position, and the parents'
keys follow by one vectorised take per key. JSON text is first decoded into such buffers, one decode per text; from
there on no code runs per row.

Results for odd input: null, blank, cut-off or otherwise invalid JSON gives no row; null list elements keep their
position and give no row; a lone object where a list may stand is a list of one; repeated source rows give the same
rows again and are removed once by ``distinct``; columns of the input other than the key and the nested column are
never touched, so their names cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Keys that may wrap a whole record; they are not part of a path.
WRAPPERS = frozenset({"consolidated_data", "record", "record_json"})
EXTRA = "extra"
NODE_SCHEMA = "record_id bigint, kind string, parent_path string, node_path string, item_no int, value string, confidence double, source_document_name string, source_document_type string, field_name string, review_required boolean"


def child_rows(lists: pa.Array, keys: dict[str, pa.Array]) -> tuple[dict[str, pa.Array], pa.Array, pa.Array]:
    """Elements of a list array with their parents' keys and positions; null lists give none, null elements are left out."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(lists)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    position = np.arange(len(parents), dtype=np.int64) - starts[parents]
    kept = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
    rows = pa.array(parents[kept])
    return {k: v.take(rows) for k, v in keys.items()}, pa.array(position[kept].astype(np.int32)), values.take(pa.array(kept))


def flatten_list(df: DataFrame, key: str, column: str, key_type: str = "bigint") -> DataFrame:
    """(key, item_no int) for every element of an array column that is not null, by Arrow kernels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, position, _ = child_rows(batch.column(1), {key: batch.column(0)})
            yield pa.RecordBatch.from_arrays([keys[key], position], names=[key, "item_no"])

    return df.select(key, column).mapInArrow(run, f"`{key}` {key_type}, item_no int")


class _Lists:
    """A list column under construction: one flat buffer per leaf and the offsets of the parents."""

    def __init__(self, leaves: dict[str, pa.DataType]):
        self.types, self.flat, self.offsets = leaves, {k: [] for k in leaves}, [0]
        self.valid: list[bool] = []

    def add(self, *leaves, valid: bool = True) -> None:
        for column, leaf in zip(self.flat.values(), leaves):
            column.append(leaf)
        self.valid.append(valid)

    def close(self) -> None:
        self.offsets.append(len(self.valid))

    def array(self, more: dict[str, pa.Array] | None = None) -> pa.ListArray:
        arrays = {k: pa.array(v, self.types[k]) for k, v in self.flat.items()} | (more or {})
        mask = pa.array(~np.array(self.valid, dtype=bool)) if self.valid else None
        values = pa.StructArray.from_arrays(list(arrays.values()), names=list(arrays), mask=mask)
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), values)


def _text(x) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _number(x) -> float | None:
    try:
        return None if x is None or isinstance(x, bool) else float(x)
    except (TypeError, ValueError):
        return None


def _records(text: str | None) -> list[dict]:
    """The record objects in a text: plain, in a list, in a JSON string, or under a wrapping key."""
    found, todo = [], [text]
    while todo:  # every step leaves less text, so any depth ends
        x = todo.pop()
        if isinstance(x, str):
            try:
                todo.append(json.loads(x.lstrip("﻿")))
            except (ValueError, RecursionError):
                pass
        elif isinstance(x, list):
            todo += [y for y in reversed(x) if isinstance(y, (dict, str))]
        elif isinstance(x, dict):
            inner = [k for k in x if k in WRAPPERS and isinstance(x[k], (dict, list)) and not (isinstance(x[k], dict) and "value" in x[k])]
            if len(x) == 1 and inner:
                todo.append(x[inner[0]])
            else:
                found.append(x)
    return found


def _as_list(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


_LEAVES = {"value": pa.string(), "confidence": pa.float64(), "source_document_name": pa.string(), "source_document_type": pa.string()}
_EXTRA_LEAVES = {"field_name": pa.string(), "value": pa.string(), "confidence": pa.float64()}


def _decode(texts: list[str | None]) -> tuple[pa.ListArray, pa.ListArray]:
    """Per text, list<field node with list<variant>> and list<document with list<extra item>>."""
    nodes = _Lists({"node_path": pa.string(), "parent_path": pa.string(), "value": pa.string(), "confidence": pa.float64(), "review_required": pa.bool_()})
    variants = _Lists(_LEAVES)
    documents = _Lists({"node_path": pa.string()})
    items = _Lists(_EXTRA_LEAVES)

    def field(path: str, parent: str, x) -> None:
        if isinstance(x, str):
            nodes.add(path, parent, x, None, None)
        else:
            review = x.get("review_required")
            nodes.add(path, parent, _text(x["value"]), _number(x.get("confidence")), review if isinstance(review, bool) else None)
            for v in _as_list(x.get("variants")):
                if isinstance(v, dict):
                    variants.add(_text(v.get("value")), _number(v.get("confidence")), _text(v.get("source_document_name")), _text(v.get("source_document_type")))
                else:
                    variants.add(_text(v), None, None, None, valid=v is not None)
        variants.close()

    for text in texts:
        seen: set[str] = set()
        for record in _records(text):
            stack = [(k, "", v) for k, v in reversed(record.items()) if k != EXTRA]
            while stack:
                path, parent, x = stack.pop()
                if isinstance(x, str) or isinstance(x, dict) and "value" in x:
                    if path not in seen:
                        seen.add(path)
                        field(path, parent, x)
                elif isinstance(x, dict):
                    stack += [(f"{path}.{k}", path, v) for k, v in reversed(x.items())]
                elif isinstance(x, list):
                    stack += [(f"{path}[{i}]", path, v) for i, v in reversed(list(enumerate(x)))]
            extra = record.get(EXTRA)
            if isinstance(extra, dict):
                for name, group in extra.items():
                    if (path := f"{EXTRA}.{name}") in seen:
                        continue
                    seen.add(path)
                    documents.add(path)
                    for item in _as_list(group):
                        if isinstance(item, dict):
                            items.add(_text(item.get("field_name")), _text(item.get("value")), _number(item.get("confidence")))
                        else:
                            items.add(None, _text(item), None, valid=item is not None)
                    items.close()
        nodes.close()
        documents.close()
    return nodes.array({"variants": variants.array()}), documents.array({"items": items.array()})


def _emit(kind: str, keys: dict[str, pa.Array], leaves: dict[str, pa.Array], position: pa.Array | None, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    n = len(keys["record_id"])
    have = keys | leaves | {"kind": pa.array([kind] * n, pa.string()), "item_no": position if position is not None else pa.array(np.full(n, -1, np.int32))}
    return pa.RecordBatch.from_arrays([have[k].cast(t) if k in have else pa.nulls(n, t) for k, t in zip(names, types)], names=names)


def _leaves(s: pa.Array) -> dict[str, pa.Array]:
    return dict(zip([f.name for f in s.type], s.flatten()))


def flatten_records(df: DataFrame, key: str = "record_id", text: str = "record_json", slice_rows: int = 256) -> DataFrame:
    """One table of fields, variants and extra items of nested JSON records, each row linked to its record and parent.

    kind is field (item_no -1), variant or extra; node_path is the field's or the document's path and parent_path the nest's
    (variants: the field's own path). slice_rows bounds how many decoded texts are in memory at once.
    """
    schema = pa.schema([("record_id", pa.int64()), ("kind", pa.string()), ("parent_path", pa.string()), ("node_path", pa.string()), ("item_no", pa.int32()), ("value", pa.string()), ("confidence", pa.float64()), ("source_document_name", pa.string()), ("source_document_type", pa.string()), ("field_name", pa.string()), ("review_required", pa.bool_())])
    names, types = schema.names, schema.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                nodes, documents = _decode(batch.column(1).to_pylist())
                keys, _, found = child_rows(nodes, {"record_id": batch.column(0)})
                leaves = _leaves(found)
                inner = leaves.pop("variants")
                yield _emit("field", keys, leaves, None, names, types)
                keys, position, variants = child_rows(inner, keys | {"node_path": leaves["node_path"], "parent_path": leaves["node_path"]})
                yield _emit("variant", keys, _leaves(variants), position, names, types)
                keys, _, found = child_rows(documents, {"record_id": batch.column(0)})
                leaves = _leaves(found)
                keys, position, items = child_rows(leaves["items"], keys | {"node_path": leaves["node_path"], "parent_path": pa.array([EXTRA] * len(found), pa.string())})
                yield _emit("extra", keys, _leaves(items), position, names, types)

    return df.select(F.col(key).cast("bigint").alias("record_id"), F.col(text).alias("record_json")).mapInArrow(run, NODE_SCHEMA)


def found_nodes(records: DataFrame, extractions: DataFrame) -> DataFrame:
    """(source_table, record_id, node_path, item_no) of every node of both tables, without duplicate rows."""
    nested = flatten_records(records).select(F.lit("consolidated_records").alias("source_table"), "record_id", "node_path", "item_no")
    extra = flatten_list(extractions.filter(F.size("extra") > 0), "extraction_id", EXTRA).select(F.lit("extractions").alias("source_table"), F.col("extraction_id").alias("record_id"), F.lit(EXTRA).alias("node_path"), "item_no")
    return nested.unionByName(extra).distinct()
