"""Records out of nested JSON payloads, by one walk over a payload's tree for each row."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Nodes that are walked at most in one payload; more are reported as cut.
BUDGET = 200_000

NODES = "path string, kind string, node string, cut boolean, at int"


def walk(payload: str | None, budget: int = BUDGET) -> Iterator[tuple[str, str, dict, bool]]:
    """(path, type name, object, cut) of all objects of a payload, outer ones first; cut marks the last if the budget ended the walk."""
    return (found[:4] for found in _walk(payload, budget))


def _walk(payload: str | None, budget: int, ids: tuple[str, ...] = ()) -> Iterator[tuple[str, str, dict, bool, object]]:
    """What walk gives, and the first of ids in the closest object above that has one."""
    try:
        top = json.loads(payload or "null")
    except ValueError:
        return
    stack, seen = [("", top, None)], 0
    while stack:
        path, node, above = stack.pop()
        seen += 1
        if isinstance(node, dict):
            yield path, str(node.get("__typename") or node.get("type") or ""), node, seen >= budget, above
            above = next((node[k] for k in ids if node.get(k) is not None), above)
            stack += [(f"{path}.{k}" if path else k, v, above) for k, v in reversed(node.items()) if isinstance(v, (dict, list))]
        elif isinstance(node, list):
            stack += [(f"{path}.{i}", node[i], above) for i in range(len(node) - 1, -1, -1) if isinstance(node[i], (dict, list))]
        if seen >= budget:
            return


#: Levels of an object that are kept in its node: deeper ones have nodes of their own.
DEPTH = 3


def shallow(node: object, depth: int = DEPTH) -> object:
    """A node without what lies deeper, so that a payload's nodes together grow with the payload, not with its depth too."""
    if isinstance(node, dict):
        return {k: shallow(v, depth - 1) if isinstance(v, (dict, list)) else v for k, v in node.items()} if depth else {}
    if isinstance(node, list):
        return [shallow(v, depth - 1) if isinstance(v, (dict, list)) else v for v in node] if depth else []
    return node


#: Payloads taken out of a batch at once, and characters of nodes that are given on together.
PAYLOADS, CHARS = 500, 4_000_000

_json = json.JSONEncoder(sort_keys=True).encode
_plain = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode


def _text(value: object) -> str | None:
    """A JSON value as get_json_object gives it, in text that UTF-8 can hold."""
    if value is None:
        return None
    text = value if isinstance(value, str) else _plain(value)
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def nodes(rows: DataFrame, column: str, budget: int = BUDGET, fields: tuple[str, ...] | None = None, ids: tuple[str, ...] = ()) -> DataFrame:
    """rows with one row for each object in a payload: path, kind, node (its JSON), cut, and at, its place in the walk.

    With fields, only objects that have one of them are given, with these fields
    alone. With ids there is a column above too: the first of these fields in the
    closest object above that has one.
    """
    kept = [f for f in rows.schema.fields if f.name != column]
    extra = T.StructType.fromDDL(NODES + (", above string" if ids else ""))
    arrow = to_arrow_schema(extra)
    wanted = None if fields is None else frozenset(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            payloads = batch.column(batch.schema.get_field_index(column))
            out, of, size = [], [], 0

            def given() -> pa.RecordBatch:
                place = pa.array(of, pa.int32())
                made = [pa.array(values, f.type) for values, f in zip(zip(*out, strict=True), arrow, strict=True)]
                return pa.RecordBatch.from_arrays([*[c.take(place) for c in own], *made], names=[*[f.name for f in kept], *arrow.names])

            for start in range(0, len(payloads), PAYLOADS):
                for row, payload in enumerate(payloads.slice(start, PAYLOADS).to_pylist(), start):
                    for at, (path, kind, node, cut, above) in enumerate(_walk(payload, budget, ids)):
                        if wanted is not None:
                            node = {k: node[k] for k in node if k in wanted}
                            if not node:
                                continue
                        text = _json(shallow(node))
                        out.append((_text(path), _text(kind), text, cut, at, _text(above)) if ids else (_text(path), _text(kind), text, cut, at))
                        of.append(row)
                        size += len(text) + len(path)
                        if size >= CHARS:
                            yield given()
                            out, of, size = [], [], 0
            if out:
                yield given()

    return rows.mapInArrow(run, T.StructType(kept + extra.fields))


def posts(found: DataFrame) -> DataFrame:
    """Posts among nodes: objects with an id and a text, the fullest of each id first."""
    n = F.col("node")
    get = lambda *names: F.coalesce(*[F.get_json_object(n, f"$.{x}") for x in names])
    rows = found.select(
        get("rest_id", "id_str", "post_id", "id").alias("post_id"), get("legacy.full_text", "full_text", "text", "message.text").alias("text"),
        get("legacy.created_at", "created_at", "created_time").alias("created"), F.coalesce(get("legacy.favorite_count", "like_count").try_cast("long"), F.lit(0)).alias("likes"), "path", F.length(n).alias("size"),
    ).where("post_id IS NOT NULL AND text IS NOT NULL")
    best = rows.groupBy("post_id").agg(F.max_by(F.struct("text", "created", "likes"), F.struct("size", F.col("path"))).alias("b"))
    return best.select("post_id", "b.*")


def continuation_tokens(found: DataFrame) -> DataFrame:
    """Distinct tokens by which more pages are asked for."""
    token = F.coalesce(F.get_json_object("node", "$.continuation"), F.get_json_object("node", "$.token"), F.get_json_object("node", "$.end_cursor"))
    return found.select(token.alias("token")).where("token IS NOT NULL").distinct()
