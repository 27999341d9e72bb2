"""D: node records from open verifier JSON, further evidence by rule, and what a chosen candidate says of each node."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions import rules
from runlens.functions.jsontree import plain

_RECORD = "no int, style int, ids array<string>, status string, label string, message string, hint string"
_TYPES = (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string())
# the end of a text as Spark's patterns know it: before one last line break of any kind too
_LABEL, _LISTS = (re.compile(p.removesuffix("$") + r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)") for p in (rules.LABEL, rules.STATUS_LISTS))
_FAILED = re.compile("|".join(rules.FAILED_PARTS))
_TOLD, _NAMED, _OTHER = frozenset(rules.STATUS_KEYS), frozenset(rules.NAMED_BY), frozenset((*rules.STATUS_KEYS, *rules.ID_KEYS, *rules.CLASS_KEYS, "reason"))
_IDS, _WHY, _SAYS, _HINTS = map(frozenset, (rules.ID_KEYS, _REASONS := (*rules.CLASS_KEYS, *rules.REASON_KEYS), rules.MESSAGE_KEYS, rules.HINT_KEYS))
_NOTHING = ("", "0", "0.0", "false")


def _cached(of: Callable) -> Callable:
    """Keeps what short words give; long texts, which hardly come twice, are not held."""
    known = lru_cache(4096)(of)
    return lambda word: known(word) if len(word) < 100 else of(word)


@_cached
def _status(word: str) -> str | None:
    """norm_status of one word."""
    s = word.strip(" ").lower()
    return "passed" if s in rules.PASSED_WORDS else "failed" if s in rules.FAILED_WORDS or _FAILED.search(s) else None


@_cached
def _label(word: str) -> bool:
    return bool(_LABEL.match(word)) and word.lower() not in rules.GENERIC_WORDS


@_cached
def _lists(key: str) -> bool:
    return bool(_LISTS.match(key))


def _hint(one: dict, at: str) -> str:
    """The first of these keys that holds something; what is no text gives way to the key above."""
    for k in rules.HINT_KEYS:
        v = one.get(k)
        if isinstance(v, str):
            if v not in _NOTHING:
                return plain(v)
        elif isinstance(v, (list, dict)) or v is not None and str(v).lower() not in _NOTHING:
            return at
    return at


def _of_object(one: dict, no: int, at: str, above: str, direct: bool) -> list[tuple]:
    """Records 0 and 1 of an object that has a key of a status."""
    status = word = None
    for k in rules.STATUS_KEYS:
        if k in one:
            v = one[k]
            if isinstance(v, str):
                status, word = _status(v), v
            elif isinstance(v, bool):
                status, word = ("passed" if v else "failed"), None
            if status:
                break
    else:
        return []
    # most objects have few of these keys
    some = lambda names, keys: [] if keys.isdisjoint(one) else [one[k] for k in names if k in one]
    ids = [plain(v) if isinstance(v, str) else str(v) for v in some(rules.ID_KEYS, _IDS) if isinstance(v, (str, int)) and not isinstance(v, bool)]
    keyed = direct and _NAMED.isdisjoint(one)
    if not ids and not keyed:
        return []
    label = ""
    for v in (*some(_REASONS, _WHY), word):
        if isinstance(v, str) and _label(v):
            label = v
            break
    message = "\n".join([plain(v[-rules.MESSAGE_TAIL :]) for v in some(rules.MESSAGE_KEYS, _SAYS) if isinstance(v, str)])
    found = [(no, 0, [at], status, label, message, above)] if keyed else []
    if ids:
        found.append((no, 1, ids, status, label, message, at if _HINTS.isdisjoint(one) else _hint(one, at)))
    return found


def _records(text: str | None) -> list[tuple]:
    """All records of a document in its order; none if it is null or no JSON."""
    try:
        root = json.loads(text or "")
    except (ValueError, RecursionError):
        return []
    found, clock = [], 0
    todo = [(iter([root]), None, "", "")]  # items of a list or entries of an object, is it an object, the keys above the items and above their object
    while todo:
        inside, of_object, at, above = todo[-1]
        for value in inside:
            direct = False
            if of_object:
                key, value = value
                no, clock = clock, clock + 1
                kind = type(value)
                if kind is str or kind is bool:
                    status = _status(value if kind is str else "true" if value else "false")
                    if status and key not in _OTHER:
                        named = kind is str and value.lower() not in rules.GENERIC_WORDS
                        found.append((no, 2, [plain(key)], status, plain(value) if named else "", "", at))
                    continue
                if kind is list:
                    name = plain(key).lower()
                    if set(map(type, value)) == {str}:
                        if _lists(name):
                            passed = "pass" in name
                            found += [(no, 3, [plain(v)], "passed" if passed else "failed", "" if passed else name, "", at) for v in value]
                        continue
                elif kind is not dict:
                    continue
                key, over, direct = plain(key), at, kind is dict
            else:
                key, over = at, above
            if isinstance(value, dict):
                no, clock = clock, clock + 1
                if not _TOLD.isdisjoint(value):
                    found += _of_object(value, no, key, over, direct)
                todo.append((iter(value.items()), True, key, over))
                break
            if isinstance(value, list):
                todo.append((iter(value), False, key, over))
                break
        else:
            todo.pop()
    return found


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text last -> the other columns, repeated, and the records."""
    for batch in batches:
        rows = [_records(text) for text in batch.column(batch.num_columns - 1).to_pylist()]
        owner = pa.array([i for i, of in enumerate(rows) for _ in of], pa.int32())
        found = list(zip(*chain.from_iterable(rows), strict=True)) or [()] * len(_TYPES)
        columns = [*(c.take(owner) for c in batch.columns[:-1]), *map(pa.array, found, _TYPES)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "no", "style", "ids", "status", "label", "message", "hint"])


def walk_verifier(files: DataFrame, by: list[str], payload: str) -> DataFrame:
    """(by, no, style, ids, status, label, message, hint) of each node that a verifier's JSON tells of, in its order by no and style.

    Three styles: objects with an id and a status (1), entries whose key is
    the id (an object with a status and no name of its own: 0; a flag or a
    status word: 2), and lists of ids under a key such as f2p_passed (3). Label and
    message are those of the object itself. Files that are no JSON have no rows.
    """
    schema = T.StructType([*files.select(*by).schema.fields, *T.StructType.fromDDL(_RECORD).fields])
    return files.select(*by, F.col(payload).cast("string")).mapInArrow(_batches, schema)


def supplemental_rules(files: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, path, status, label) of nodes whose evidence is a whole file.

    files: by, path, text. table: by, node, path and rule: ``phases`` (an exit
    code of 0 and phases that all passed), ``exit`` (a p2p_exit of 0) or
    ``tap`` (the last totals tell no failure and some success). A file that
    can't be read so counts as failed; a rule without its file has no row.
    """
    phases = F.from_json("text", "exit double, phases array<struct<outcome:string>>")
    all_passed = (phases["exit"] == 0) & (F.size(phases["phases"]) > 0) & F.forall(phases["phases"], lambda p: p["outcome"].eqNullSafe("passed"))
    total = lambda word: F.try_element_at(F.regexp_extract_all("text", F.lit(rf"(?m)^# {word} (\d+)"), F.lit(1)), F.lit(-1)).cast("decimal(38,0)")
    fits = F.when(F.col("rule") == "phases", all_passed).when(F.col("rule") == "exit", F.get_json_object("text", "$.p2p_exit") == "0").when(F.col("rule") == "tap", (total("fail") == 0) & (total("pass") > 0))
    names = F.when(F.col("rule") == "phases", "pytest_failed").when(F.col("rule") == "exit", "suite_failed").otherwise("tap_failed")
    ok = F.coalesce(fits, F.lit(False))
    found = table.join(files.select(*by, "path", "text"), [*by, "path"])
    return found.select(*by, "node", "path", F.when(ok, "passed").otherwise("failed").alias("status"), F.when(ok, "").otherwise(names).alias("label"))


def reconciled_nodes(nodes: DataFrame, candidates: DataFrame, chosen: DataFrame, by: list[str], node: str = "node") -> DataFrame:
    """Every node's status by its run's chosen candidate: one that it leaves out failed as not_reported; without a candidate it is unresolved.

    nodes: by, node. candidates: by, candidate, node, status. chosen: by, candidate, resolved.
    """
    pick = chosen.select(*by, "candidate", F.coalesce("resolved", F.lit(False)).alias("resolved"))
    said = candidates.select(*by, "candidate", node, F.col("status").alias("__status"))
    j = nodes.select(*by, node).join(pick, by, "left").join(said, [*by, "candidate", node], "left")
    missing = F.col("resolved") & F.col("__status").isNull()
    status = F.when(F.col("resolved"), F.coalesce("__status", F.lit("failed"))).otherwise("unresolved")
    return j.select(*by, node, status.alias("status"), F.when(missing, "not_reported").otherwise("").alias("label"))
