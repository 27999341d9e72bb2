"""K: what graders' files say of a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.functions import rules
from runlens.functions.jsontree import json_objects
from runlens.operators.relational import dealt

#: Lines at the end of a node's own log and of another one that are shown, records of a file, and characters in all.
OWN_LINES, OTHER_LINES, RECORDS, LIMIT = 20, 12, 4, 2000
#: Set by a caller, logs of more bytes are searched for their own nodes alone. No query sets it: every log is searched for all nodes.
LARGEST_LOG: int | None = None


def clip(text: Column, limit: int) -> Column:
    """The head (2/3) and the tail (1/3) of a longer text, with the number of characters between them."""
    head = limit * 2 // 3
    gap = F.format_string("\n… [%d chars omitted] …\n", F.length(text) - limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), gap, F.right(text, F.lit(limit - head))))


def node_names(node: Column) -> Column:
    """Spellings of a node's id: itself, what stands in brackets at its end, and the number of a pull request."""
    inner = F.regexp_extract(node, r"\[([^\]]+)\]$", 1)
    number = F.regexp_extract(node, r"(?i)^pr[-_ ]?(\d+)$", 1)
    return F.filter(F.array_distinct(F.array(node, inner, number)), lambda x: x != "")


def _longest_word(name: Column) -> Column:
    """The longest run of letters, digits, _ and - in a name; the empty text if there is none."""
    runs = F.regexp_extract_all(name, F.lit(r"(?U)[\w-]+"), F.lit(0))
    return F.coalesce(F.try_element_at(F.filter(runs, lambda r: F.length(r) == F.array_max(F.transform(runs, F.length))), F.lit(1)), F.lit(""))


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def log_lines(nodes: DataFrame, files: DataFrame, by: list[str], node: str) -> DataFrame:
    """(by, node, own, far, file, line, text) of the last lines that name a node, in its own log, the logs of that folder and of the one above.

    A name counts only between characters that are none of letters, digits, _
    and -. Such a name's runs of these characters stand in the line as whole
    runs too, so lines and names meet by the name's longest run and are
    compared only then. Nodes and files are moved once, to the task of their
    ``by``, and become names, lines and words only there.
    """
    nodes, files = dealt(nodes, by), dealt(files, by)
    other = ~F.col("path").rlike(r"\.jsonl?$") & ~F.col("path").endswith(".log")
    scopes = F.array(
        F.struct(F.lit(0).alias("far"), F.when(other, F.concat(F.lit("="), "path")).alias("scope")),
        F.struct(F.lit(1).alias("far"), F.concat(F.lit("/"), _folder(F.col("path"))).alias("scope")),
        F.struct(F.lit(2).alias("far"), F.concat(F.lit("/"), _folder(_folder(F.col("path")))).alias("scope")),
    )
    # outer: else Spark looks for names and folders before it moves a node, too
    named = nodes.select(*by, node, F.col("path").alias("__own"), F.explode_outer(node_names(F.col(node))).alias("__name"), scopes.alias("__scopes")).where("__name is not null")
    named = named.withColumn("__word", _longest_word(F.col("__name"))).select("*", F.inline_outer("__scopes")).drop("__scopes").where("scope is not null")

    # the lines of a log are met by its folder, from its own nodes too; those of another file by its path
    place = F.when(F.col("path").endswith(".log"), F.concat(F.lit("/"), _folder(F.col("path")))).when(other, F.concat(F.lit("="), "path"))
    large = F.lit(False) if LARGEST_LOG is None else F.octet_length("text") > LARGEST_LOG
    lines = files.select(*by, F.col("path").alias("file"), place.alias("scope"), large.alias("__large"), F.posexplode(F.split("text", "\n")).alias("line", "text")).where("scope is not null")
    lines = lines.withColumn("__id", F.xxhash64(*by, "file", "line"))
    words = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(r"(?U)[\w-]+"), F.lit(0)), F.array(F.lit(""))))
    # words and lines meet as numbers, so that a line's text is not held with each word; equal numbers of other words fall away with the text
    named = named.withColumn("__key", F.xxhash64(*by, "__word")).drop("__word")
    known = named.select(*by, "__key").distinct().hint("shuffle_hash")
    keys = lines.select(*by, "__id", F.explode(F.transform(words, lambda w: F.xxhash64(*by, w))).alias("__key")).join(known, [*by, "__key"], "left_semi")
    found = lines.join(keys.hint("shuffle_hash"), [*by, "__id"]).drop("__id")
    said = F.expr(r"text rlike concat('(?U)(?<![\\w-])\\Q', replace(__name, '\\E', '\\E\\\\E\\Q'), '\\E(?![\\w-])')")
    # a file's own nodes do not meet it as one of the folder above
    own = F.col("file") == F.col("__own")
    hits = found.hint("merge").join(named, [*by, "scope", "__key"]).where(F.when(own, F.col("far") < 2).otherwise(~F.col("__large"))).where(said).withColumn("far", F.when(own, 0).otherwise(F.col("far")))
    # a log may be met by several names, and from the folder and from above it; all that follows is of a node
    hits = hits.groupBy(*by, node, "file", "line").agg(F.min("far").alias("far"), F.first("text").alias("text"))
    last = Window.partitionBy(*by, node, "file").orderBy(F.desc("line"))
    shown = F.when(F.col("far") == 0, OWN_LINES).otherwise(OTHER_LINES)
    return hits.withColumn("__rn", F.row_number().over(last)).where((F.col("__rn") <= OWN_LINES) & (F.col("__rn") <= shown)).drop("__rn")


def _quoted(text: Column) -> Column:
    """A text as JSON has it."""
    inner = F.to_json(F.array(text))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def _summary(fields: Column) -> Column:
    """The texts of an object that tell of a failure, with their keys; else its scalars as JSON."""
    entries = F.map_entries(fields)
    tells = F.filter(entries, lambda e: (e["value"]["type"] == "string") & (F.trim(e["value"]["value"]) != "") & e["key"].rlike(rules.MESSAGE_KEY))
    plain = F.filter(entries, lambda e: e["value"]["type"].isin("string", "int", "float", "bool", "null"))
    ordered = lambda a: F.array_sort(a, lambda x, y: x["value"]["no"] - y["value"]["no"])
    value = lambda v: F.when(v["type"] == "string", _quoted(v["value"])).otherwise(F.coalesce(v["value"], F.lit("null")))
    scalars = F.transform(ordered(plain), lambda e: F.concat(_quoted(e["key"]), F.lit(": "), value(e["value"])))
    told = F.transform(ordered(tells), lambda e: F.concat(e["key"], F.lit(": "), F.trim(e["value"]["value"])))
    return F.when(F.size(tells) > 0, F.array_join(told, "\n")).otherwise(F.concat(F.lit("{"), F.array_join(scalars, ", "), F.lit("}")))


def json_records(nodes: DataFrame, files: DataFrame, by: list[str], node: str) -> DataFrame:
    """(by, node, no, text) of the first objects in a node's own JSON file, of one or of many lines, that name it by a value or are kept under its name."""
    kept = files.where(F.col("path").rlike(r"\.jsonl?$"))
    many = F.col("path").endswith(".jsonl")
    texts = kept.select(*by, "path", F.posexplode(F.when(many, F.split("text", "\n")).otherwise(F.array("text"))).alias("part", "text"))
    objects = json_objects(texts, "text")
    values = F.transform(F.filter(F.map_values("fields"), lambda v: v["type"].isin("string", "int")), lambda v: v["value"])
    told = F.array_distinct(F.concat(values, F.when(F.col("direct"), F.array("at")).otherwise(F.array().cast("array<string>"))))
    said = objects.select(*by, "path", "part", "no", _summary(F.col("fields")).alias("text"), F.explode(told).alias("__name"))
    plain = node_names(F.col(node))
    names = F.concat(plain, F.transform(plain, lambda n: F.concat(F.lit("[f2p] "), n)), F.transform(plain, lambda n: F.concat(F.lit("[p2p] "), n)))
    # the others have no such file
    named = nodes.where(F.col("path").rlike(r"\.jsonl?$")).select(*by, node, "path", F.explode(names).alias("__name"))
    hits = said.hint("merge").join(named, [*by, "path", "__name"]).groupBy(*by, node, "part", "no").agg(F.first("text").alias("text"))
    first = Window.partitionBy(*by, node).orderBy("part", "no")
    return hits.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= RECORDS).select(*by, node, F.col("__rn").alias("no"), "text")


def grader_output(nodes: DataFrame, files: DataFrame, by: list[str], node: str, limit: int = LIMIT) -> DataFrame:
    """(by, node, output): what a node's own evidence and the logs beside and above it say of it, clipped.

    nodes: by, node (its id) and path, the file its status was read from.
    files: by, path, text. A node that no file names has an empty output.
    """
    lines = log_lines(nodes, files, by, node)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    logs = lines.groupBy(*by, node, "far", "file").agg(body.alias("text"))
    head = F.when(F.col("far") == 0, "").otherwise(F.concat(F.lit("["), F.regexp_extract("file", "[^/]*$", 0), F.lit("]\n")))
    piece = lambda far, file, no, text: F.struct(far.alias("far"), file.alias("file"), no.cast("int").alias("no"), text.alias("text"))
    parts = logs.select(*by, node, piece(F.col("far"), F.col("file"), F.lit(0), F.concat(head, F.col("text"))).alias("p"))
    records = json_records(nodes, files, by, node).select(*by, node, piece(F.lit(0), F.lit(""), F.col("no"), F.col("text")).alias("p"))
    # the logs' texts stay where they are, so the few records go there
    said, told = parts.groupBy(*by, node).agg(F.collect_list("p").alias("__said")), dealt(records, by).groupBy(*by, node).agg(F.collect_list("p").alias("__told"))
    both = F.array_sort(F.concat(*[F.coalesce(c, F.array().cast(said.schema["__said"].dataType)) for c in ("__said", "__told")]))
    whole = F.array_join(F.filter(F.transform(both, lambda p: p["text"]), lambda t: t != ""), "\n")
    out = dealt(nodes.select(*by, node), by).distinct().hint("merge").join(said, [*by, node], "left").hint("merge").join(told, [*by, node], "left")
    return out.select(*by, node, F.coalesce(clip(whole, limit), F.lit("")).alias("output"))
