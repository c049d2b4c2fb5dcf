"""Deeply nested records to flat child tables, by Arrow list offsets and parent-index kernels."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BOM = "﻿"


def list_step(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Flatten one level: (elements, index of the parent list, position in it). Null lists have no elements, null elements keep their place."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    starts = np.cumsum(sizes) - sizes
    return flat, parent, np.arange(len(flat), dtype=np.int64) - starts[parent]


def walk(column: pa.Array, path: list[str]) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """Follow ``path`` (struct fields holding lists) below a list column: (elements, row index, a position array a level)."""
    flat, row, pos = list_step(column)
    places = [pos]
    for name in path:
        inner, parent, pos = list_step(pc.struct_field(flat, name))
        row, places, flat = row[parent], [p[parent] for p in places] + [pos], inner
    return flat, row, places


def _whole(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def flatten_child(df: DataFrame, keys: list[str], column: str, path: list[str], fields: dict[str, str], prefix: str = "") -> DataFrame:
    """One flat child table of ``df``: the elements at ``column`` / ``path``, linked by ``keys`` and their places.

    ``column`` is an array of structs; ``path`` names the arrays to descend into. ``fields`` maps a scalar field of the element to its
    SQL type. The result has ``keys``, ``{prefix}pos_0`` .. ``{prefix}pos_n`` (places from 0, empty places included) and
    ``{prefix}{field}``. Null or empty arrays give no row; a null element gives a row of null fields, so that places stay dense;
    repeated parents give repeated children; columns of ``df`` not named are never read.
    """
    taken = df.select(*keys, column)
    depth = len(path) + 1
    schema = ", ".join(
        [f"`{k}` {taken.schema[k].dataType.simpleString()}" for k in keys] + [f"`{prefix}pos_{i}` int" for i in range(depth)] + [f"`{prefix}{f}` {t}" for f, t in fields.items()]
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, row, places = walk(_whole(batch, column), path)
            take = pa.array(row)
            out = [_whole(batch, k).take(take) for k in keys] + [pa.array(p.astype(np.int32)) for p in places] + [pc.struct_field(flat, f) for f in fields]
            names = [*keys, *(f"{prefix}pos_{i}" for i in range(depth)), *(prefix + f for f in fields)]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return taken.mapInArrow(emit, schema)


_TOPIC = pa.struct([("place", pa.int32()), ("id", pa.string()), ("display_name", pa.string()), ("score", pa.float64()), ("subfield", pa.string()), ("field", pa.string()), ("domain", pa.string())])


def _decode(text: str | None):
    """The document in ``text``: JSON, JSON after a byte-order mark, or a printed Python literal; None if it is none of these."""
    if not text:
        return None
    text = text.lstrip(_BOM + " \n\r\t")
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


def _number(x) -> float | None:
    try:
        return None if x is None or isinstance(x, bool) else float(x)
    except (TypeError, ValueError):
        return None


def _name(x) -> str | None:
    return (x.get("display_name") if isinstance(x, dict) else x) if x is None or isinstance(x, (dict, str)) else str(x)


def _elements(node) -> list[tuple[int, object]]:
    """The (place, element) that ``node`` stands for: a list, an encoded list, a page of results, places as keys, or one element alone.

    Places given as keys are kept as they are, however far apart. Encodings within encodings are opened to any depth.
    """
    while isinstance(node, str):
        inner = _decode(node)
        if inner is None or isinstance(inner, (int, float)):
            return [(0, node)] if node.strip() else []
        node = inner
    if isinstance(node, (list, tuple)):
        return list(enumerate(node))
    if isinstance(node, dict):
        if isinstance(node.get("results"), (list, tuple)):
            return list(enumerate(node["results"]))
        if node and all(re.fullmatch(r"\d+", str(k)) for k in node):
            return sorted(((int(k), v) for k, v in node.items()), key=lambda e: e[0])
        return [(0, node)] if node else []
    return []


def _find(doc, name: str):
    """The value of ``name`` (any case) in a document, below encodings and wrapping objects of any number; the nearest holds."""
    level = [doc]
    while level:
        below = []
        for d in level:
            while isinstance(d, str) or isinstance(d, (list, tuple)) and len(d) == 1:
                d = _decode(d) if isinstance(d, str) else d[0]
            if not isinstance(d, dict):
                continue
            for k, v in d.items():
                if isinstance(k, str) and k.lower() == name:
                    return v
            below += [d[k] for k in ("data", "result", "record", "work") if isinstance(d.get(k), (dict, str, list))]
        level = below
    return None


def _topic(x) -> dict | None:
    if isinstance(x, str):
        return {"id": x}
    if not isinstance(x, dict):
        return None
    x = {str(k).lower(): v for k, v in x.items()}
    field = x.get("field")
    return {
        "id": None if x.get("id") is None else str(x["id"]), "display_name": _name(x.get("display_name")), "score": _number(x.get("score")),
        "subfield": _name(x.get("subfield")), "field": _name(field), "domain": _name(field.get("domain")) if isinstance(field, dict) else None,
    }


def topic_lists(texts: pa.Array) -> pa.Array:
    """The topics of each document as one Arrow list array; a document without topics, or not readable as one, gives an empty list."""
    return pa.array([[{"place": at, **(_topic(x) or {})} for at, x in _elements(_find(_decode(t), "topics"))] if t is not None and '"topics' in t.lower().replace("'", '"').replace("\\", "") else [] for t in texts.to_pylist()], pa.list_(_TOPIC))


def flatten_topics(df: DataFrame, keys: list[str], column: str = "openalex_data") -> DataFrame:
    """Child table of the topics inside the document text ``column``: ``keys``, ``pos_0``, ``id``, ``display_name``, ``score``, ``subfield``, ``field``, ``domain``.

    The text may be JSON, JSON with a byte-order mark or a printed Python literal; topics may be a list, one object, a page of results, an
    object keyed by place, or an encoded string of these. Null, blank and unreadable texts give no row; null elements keep their place.
    """
    taken = df.select(*keys, column)
    schema = ", ".join([f"`{k}` {taken.schema[k].dataType.simpleString()}" for k in keys] + ["pos_0 int, id string, display_name string, score double, subfield string, field string, domain string"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, row, _ = walk(topic_lists(_whole(batch, column)), [])
            take = pa.array(row)
            out = [_whole(batch, k).take(take) for k in keys] + [pc.struct_field(flat, f.name) for f in _TOPIC]
            yield pa.RecordBatch.from_arrays(out, names=[*keys, "pos_0", *(f.name for f in list(_TOPIC)[1:])])

    return taken.mapInArrow(emit, schema)


def bare_id(column, letter: str):
    """The bare upper-case identifier (``letter`` and digits) at the end of ``column`` in any notation; null where there is none."""
    found = F.regexp_extract(F.upper(F.trim(column)), rf"(?:^|[/:\s])({letter}\d+)/*$", 1)
    return F.when(found != "", found)


def nested_keys(records: DataFrame, key: str = "rec_id") -> DataFrame:
    """All identified nested elements of paper records: (key, entity, parent_pos, child_key), distinct.

    ``institution`` is linked to the place of its author, ``topic`` and ``s2_field`` to their own place. Elements without an identifier
    or category give no row. Null arrays, documents and elements are passed over without moving the places of the others.
    """
    inst = flatten_child(records, [key], "authors", ["institutions"], {"id": "string"})
    inst = inst.select(key, F.lit("institution").alias("entity"), F.col("pos_0").alias("parent_pos"), bare_id(F.col("id"), "I").alias("child_key"))
    topic = flatten_topics(records, [key]).select(key, F.lit("topic").alias("entity"), F.col("pos_0").alias("parent_pos"), bare_id(F.col("id"), "T").alias("child_key"))
    field = flatten_child(records, [key], "s2_fields_of_study", [], {"category": "string"})
    field = field.select(key, F.lit("s2_field").alias("entity"), F.col("pos_0").alias("parent_pos"), F.when(F.trim("category") != "", F.col("category")).alias("child_key"))
    # ``key`` and places repeat only within a row, except where a row itself repeats: the distinct below runs on the key's partition.
    return inst.unionByName(topic).unionByName(field).where("child_key is not null").distinct()
