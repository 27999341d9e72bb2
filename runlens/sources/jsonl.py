"""Files to tables and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """Path, line (from 1, as in the file) and value of every physical line of many files.

    Lines are numbered within the splits that files are read by, and the
    numbers of lines of the splits before are added, so that no task holds a
    whole file.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    sizes = raw.groupBy("path", "block").agg(F.count("*").alias("n"))
    # one row for each split
    before = sizes.select("path", "block", (F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")).alias("before"))
    inside = raw.withColumn("at", F.row_number().over(Window.partitionBy("path", "block").orderBy("id")))
    return inside.hint("merge").join(before, ["path", "block"]).select("path", (F.col("before") + F.col("at")).alias("line"), "value")


def parse_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that hold one JSON object, as variants, and the others with the reason."""
    parsed = lines.withColumn("record", F.try_parse_json("value"))
    is_object = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    good = parsed.where(is_object).drop("value")
    bad = parsed.where(~is_object).select("path", "line", F.when(F.col("record").isNull(), "not JSON").otherwise("not an object").alias("error"))
    return good, bad


def pick_artifact(files: DataFrame, by: list[str], marker: str = "/capture/") -> DataFrame:
    """Per base name the file whose path has the marker, else the first by path."""
    base = F.element_at(F.split("path", "/"), -1)
    return files.groupBy(*by, base.alias("name")).agg(F.min_by("path", F.struct(~F.col("path").contains(marker), F.col("path"))).alias("path"))


def verify_hashes(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Manifest rows (name, sha256) whose file is missing or has another digest."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("got"))
    state = F.when(F.col("got").isNull(), "missing").when(F.col("got") != F.col("sha256"), "differs")
    return manifest.join(files, "name", "left").withColumn("problem", state).where("problem is not null").select("name", "problem")


def corpus_digest(manifest: DataFrame, by: list[str]) -> DataFrame:
    """One SHA-256 over the ordered files and digests of each run, then over the runs."""
    runs = manifest.groupBy(*by).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("name", "sha256")))), 256).alias("digest"))
    return runs.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*by, "digest")))), 256).alias("digest"))


def write_tables(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Parquet, csv or json; nested columns become JSON text in csv."""
    if fmt == "csv":
        df = df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema])
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)
