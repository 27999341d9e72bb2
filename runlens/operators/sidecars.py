"""A, B: sidecar records, private keys, and what results return, from open JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from runlens.functions import rules
from runlens.functions.jsontree import nested, plain, scalar, without_keys

#: Keys of which an object has to have one to be named by its id.
_SIGNS = {"artifacts": {"body"}, "people": {"display_name", "username", "expertise"}, "chat": {"text", "body"}}


def strip_private(record: Column) -> Column:
    """JSON without the keys, at any depth, that name outcomes or credentials; null if it is no JSON."""
    return without_keys(record, f"{rules.OUTCOME_KEYS}|{rules.CREDENTIAL_KEYS}")


def scan_sidecar(lines: DataFrame, by: list[str]) -> DataFrame:
    """The sidecar records of each run, numbered along path and line, with their kind.

    lines: by, path, line, text. A line that is no JSON is left out of the
    numbers and comes back with ``parsed`` false. The kind is the first of
    event, type and kind that is neither empty nor null, else unknown.
    """
    value = F.try_parse_json("text")
    text = lambda k: F.try_variant_get(value, f"$.{k}", "string")
    # zero and false name no kind, but the strings "0" and "false" do
    bare = lambda k: F.get_json_object("text", f"$.{k}").isin("0", "0.0", "false", "[]", "{}") & ~F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")).eqNullSafe("STRING")
    kinds = [F.when((text(k) != "") & ~bare(k), text(k)) for k in ("event", "type", "kind")]
    read = lines.withColumn("parsed", value.isNotNull()).withColumn("kind", F.when(F.col("parsed"), F.coalesce(*kinds, F.lit("unknown"))))
    along = Window.partitionBy(*by, "parsed").orderBy("path", "line")
    number = F.when(F.col("parsed"), F.row_number().over(along).cast("bigint"))
    return read.withColumn("number", number).withColumn("record", strip_private(F.col("text"))).select(*by, "path", "line", "parsed", "number", "kind", "record")


def sidecar_counts(records: DataFrame, by: list[str]) -> DataFrame:
    """Records of each kind."""
    return records.where("parsed").groupBy(*by, "kind").agg(F.count("*").alias("n"))


def _is_entity(family: str, one: dict, ident: str) -> bool:
    if family == "reviews":
        return ident.startswith("MR-")
    return family in rules.KEYED_FAMILIES or not _SIGNS[family].isdisjoint(one)


def _entities(family: str, text: str | None) -> set[tuple[str, str, str | None]]:
    """(kind, key, version) of all that one result returns, in one walk of its objects."""
    found, named_by, first = set(), "key" if family in rules.KEYED_FAMILIES else "id", None
    for one, around, at, direct in nested(text):
        first = one if first is None else first
        if direct and at == "conversation" and around is first:
            kind, named = scalar(one.get("id"))
            if kind in ("string", "int", "float", "bool") and named not in ("", "0", "false"):
                found.add(("conversation", named, None))
        if isinstance(talk := one.get("conversation_id"), str):
            found.add(("conversation", plain(talk), None))
        ident = one.get(named_by)
        if not isinstance(ident, str) or not _is_entity(family, one, plain(ident)):
            continue
        key, chosen = plain(ident), one.get("selected_version")
        picked = isinstance(chosen, dict) and "body" in chosen
        found.add(("id", key, None))
        if picked or "body" in one:
            found.add(("body", key, None))
        if picked and family == "docs":
            version = scalar(chosen.get("version"))[1]
            found.add(("version", key, "None" if version is None else version))
    return found


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Family and payload last -> the other columns, repeated, and the entities."""
    for batch in batches:
        *others, families, texts = batch.columns
        rows = [(i, *e) for i, (f, t) in enumerate(zip(families.to_pylist(), texts.to_pylist(), strict=True)) for e in _entities(f, t)]
        owner, *entity = zip(*rows, strict=True) if rows else ((),) * 4
        owner = pa.array(owner, pa.int32())
        yield pa.RecordBatch.from_arrays([*[c.take(owner) for c in others], *[pa.array(e, pa.string()) for e in entity]], names=[*batch.schema.names[:-2], "kind", "key", "version"])


def returned_entities(results: DataFrame, by: list[str], result: str, family: str, payload: str) -> DataFrame:
    """Distinct (by, kind, key, version) of what results return; kind is id, body, version or conversation.

    results: by, result, family and payload (JSON), each read by itself. Docs and boards are named by
    ``key``, the others by ``id``, if the family's rule holds; an object
    and its selected version count as one.
    """
    given = results.where(F.col(family).isin(*rules.FAMILIES)).select(*by, F.col(family).alias("family"), F.col(payload).cast("string").alias("payload"))
    schema = T.StructType([*given.select(*by).schema.fields, *T.StructType.fromDDL("kind string, key string, version string").fields])
    return given.mapInArrow(_batches, schema).distinct()
