"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything in ASCII that is neither a digit nor a letter separates words.
WORD_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

_own_dir: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a temporary one only where that is unset in local mode (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-runlens-"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(schema: T.StructType, **added: T.DataType) -> T.StructType:
    """``schema`` and further nullable fields."""
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in added.items())])


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """Lower-cased words (digits, letters and all non-ASCII characters); null and empty texts have none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


#: Rows that a Python worker holds at once.
SLICE = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most SLICE rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


#: Words of a stretch of a text.
STRETCH = 64


def word_places(keyed: DataFrame, reach: int) -> DataFrame:
    """A row for each word of the column ``words``: the other columns, its place ``pos``, the ``word``, ``near`` and ``at``.

    near holds at least ``reach`` words on either side of it, fewer at the
    text's ends only; the word stands in it at ``at`` (from 0). A text is cut
    into stretches first: were its words handed on with each of its words, a
    long text would be copied that often.
    """
    others = [c for c in keyed.columns if c != "words"]
    ahead = f"least(c * {STRETCH}, {reach})"
    stretches = f"transform(sequence(0, (size(words) - 1) div {STRETCH}), c -> struct(c * {STRETCH} as first, {ahead} as ahead, slice(words, c * {STRETCH} - {ahead} + 1, {ahead} + {STRETCH} + {reach}) as near))"
    cut = keyed.where("size(words) > 0").select(*others, F.explode(F.expr(stretches)).alias("__s")).select(*others, "__s.*")
    placed = cut.select(*others, "first", "ahead", "near", F.posexplode(F.slice("near", F.col("ahead") + 1, F.lit(STRETCH))).alias("i", "word"))
    return placed.select(*others, (F.col("first") + F.col("i")).cast("int").alias("pos"), "word", "near", (F.col("ahead") + F.col("i")).cast("int").alias("at"))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text, which is held out."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5) == 0


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
