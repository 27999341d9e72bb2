"""A training corpus from ``documents``: language, near duplicates, benchmarks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. The first four return the columns of documents, the last one tokens. All
of them take further columns of any name, and empty tables, which stay empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import bpe, decontaminate, language_id, ngram_jaccard, pii
from runlens.llm.common import held_out, scratch_dir, table

#: A text whose likeliest language gets less than this share is rejected, as is one without letters.
MIN_LANGUAGE_SCORE = 0.3
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; a language that is null becomes the recognised one.

    Null and empty texts, and texts without letters, go. Without any row that
    has a language nothing can be recognised, and all documents go.
    """
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    names = "__language", "__language_score"
    found = language_id.predict(docs, model, docs.columns, names=names)
    kept = found.where((F.col(names[0]) != language_id.UNKNOWN) & (F.col(names[1]) >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", names[0])).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows with a null id, and texts without words, stay. Repeated rows share
    their id and stay or go together.
    """
    return ngram_jaccard.keep_one(docs, NEAR_WORDS, NEAR_SIMILARITY)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Null and empty texts stay; repeated rows are judged alike."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms in their texts. Null and empty texts, and texts without such data, stay as they are."""
    return pii.pseudonymise_documents(docs).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers) and the digest of the decoded text.

    A null text has no tokens, as an empty one. Every row gets a row.
    """
    out = bpe.round_trip(docs, ["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("pii", replace_personal_data),
    ("byte_bpe", encode_tokens),
]

#: Naive Bayes, Feistel permutations and BPE are not SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
