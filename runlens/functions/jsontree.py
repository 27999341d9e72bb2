"""Open JSON as rows: one row for each object of a document, however deep it lies."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of an object. at: the last key above it; above: the last key above the object that holds it; direct: it is
#: the value of a key, not an item of a list. Numbers count objects and entries of a document together, in its order.
OBJECT = "no int, parent int, at string, above string, direct boolean, fields map<string,struct<type:string,value:string,no:int>>"
_FIELDS = pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string()), ("no", pa.int32())]))


def plain(text: str) -> str:
    """A text without halves of surrogate pairs, which JSON may hold but UTF-8 may not."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def scalar(value: object) -> tuple[str, str | None]:
    """Type and text of a value; containers other than lists of strings have no text."""
    if isinstance(value, bool):
        return "bool", str(value).lower()
    if isinstance(value, str):
        return "string", plain(value)
    if isinstance(value, (int, float)):
        return ("int" if isinstance(value, int) else "float"), str(value)
    if isinstance(value, list):
        return ("strings", json.dumps(value)) if value and all(isinstance(v, str) for v in value) else ("array", None)
    return ("object" if isinstance(value, dict) else "null"), None


def _objects(text: str | None) -> list[dict]:
    """All objects of a document in its order; none if it is null or no JSON."""
    try:
        root = json.loads(text or "")
    except (ValueError, RecursionError):
        return []
    found, clock = [], 0
    todo: list[tuple] = [(root, None, "", False)]  # value, the object around it, the key above it, is it a key's value
    while todo:
        value, around, at, direct = todo.pop()
        if isinstance(value, tuple):  # an entry of an object
            key, inner = value
            kind, shown = scalar(inner)
            around["fields"].append((plain(key), {"type": kind, "value": shown, "no": clock}))
            clock += 1
            if isinstance(inner, (dict, list)):
                todo.append((inner, around, plain(key), isinstance(inner, dict)))
        elif isinstance(value, list):
            todo.extend((v, around, at, False) for v in reversed(value) if isinstance(v, (dict, list)))
        elif isinstance(value, dict):
            one = {"no": clock, "parent": around["no"] if around else None, "at": at, "above": around["at"] if around else "", "direct": direct, "fields": []}
            clock += 1
            found.append(one)
            todo.extend((entry, one, at, True) for entry in reversed(value.items()))
    return found


def nested(text: str | None) -> Iterator[tuple[dict, dict | None, str, bool]]:
    """Each object of a document in its order, with the object around it, the last key above it and whether it is that key's value; none if it is null or no JSON."""
    try:
        root = json.loads(text or "")
    except (ValueError, RecursionError):
        return
    todo: list[tuple] = [(root, None, "", False)]
    while todo:
        value, around, at, direct = todo.pop()
        if isinstance(value, dict):
            yield value, around, at, direct
            todo.extend([(v, value, plain(k), True) for k, v in reversed(value.items()) if isinstance(v, (dict, list))])
        elif isinstance(value, list):
            todo.extend([(v, around, at, False) for v in reversed(value) if isinstance(v, (dict, list))])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text last -> the other columns, repeated, and the objects."""
    for batch in batches:
        rows = [(i, o) for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()) for o in _objects(text)]
        owner = pa.array([i for i, _ in rows], pa.int32())
        column = lambda name, kind: pa.array([o[name] for _, o in rows], kind)  # noqa: E731, B023
        columns = [c.take(owner) for c in batch.columns[:-1]]
        columns += [column("no", pa.int32()), column("parent", pa.int32()), column("at", pa.string()), column("above", pa.string()), column("direct", pa.bool_()), column("fields", _FIELDS)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "no", "parent", "at", "above", "direct", "fields"])


def json_objects(df: DataFrame, column: str) -> DataFrame:
    """The other columns and those of ``OBJECT``, a row per object. Null texts, texts that are no JSON and bare values have none."""
    kept = df.drop(column)
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(OBJECT).fields])
    return df.select(*kept.columns, F.col(column).cast("string")).mapInArrow(_batches, schema)


def _without(text: str, private) -> str | None:
    try:
        kept = json.loads(text, object_pairs_hook=lambda pairs: {k: v for k, v in pairs if not private(k)})
        return plain(json.dumps(kept, ensure_ascii=False, separators=(",", ":")))
    except (ValueError, RecursionError):
        return None


def without_keys(record: Column, pattern: str) -> Column:
    """JSON without the entries, at any depth, in whose lower-cased key the pattern occurs; null if it is no JSON."""
    found = re.compile(pattern)

    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        one = partial(_without, private=lambda k: found.search(k.lower()))
        return texts.map(one, na_action="ignore")

    return strip(record)


def _strings(text: str) -> list[str]:
    """All texts in a JSON document, and those in texts that are JSON objects or lists themselves."""
    try:
        todo, found = [json.loads(text)], []
        while todo:
            value = todo.pop()
            if isinstance(value, dict):
                todo.extend(reversed(value.values()))
            elif isinstance(value, list):
                todo.extend(reversed(value))
            elif isinstance(value, str):
                found.append(plain(value))
                if value.lstrip().startswith(("{", "[")):
                    try:
                        todo.append(json.loads(value))
                    except (ValueError, RecursionError):
                        pass
        return found
    except (ValueError, RecursionError):
        return []


def json_strings(record: Column) -> Column:
    """The texts in a JSON document, at any depth; none if it is no JSON."""

    @F.pandas_udf("array<string>")
    def strings(texts: pd.Series) -> pd.Series:
        return texts.map(_strings, na_action="ignore")

    return strings(record)
