"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line) is hashed to a wide vector: 16 lanes of 32 bits, which are
the line's SHA-512 cut into lanes, and 62 lanes that count, over the line's pairs of
neighbouring words, how often each bit of the pair's hash is set. A document's
vector is the sum of its paragraphs' vectors modulo powers of two, so it does
not depend on their order, and a paragraph is inserted or deleted by adding or
subtracting its vector (``combined``, ``inserted``, ``deleted``). The first lanes tell equality; the cosine of the
centred counts of two documents is their likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXACT_LANES = 16
#: Each long holds two counters of 32 bits; bits 0 and 32 of a pair's hash are left out.
PACKED = 31
LOW = 0xFFFFFFFF
PAIR_OF_BITS = (1 << 32) | 1
#: Rows that follow one another by id are looked at together in runs of about so many.
RUN_ROWS = 1000
MAX_RUNS = 4096
_FIRST = -(1 << 63)


def paragraph_codes(line: Column) -> Column:
    """(code, digest) for the line itself, with its digest alone, and for its word pairs (the last word alone), with their hash alone."""
    hashes = F.transform(F.filter(F.split(line, " "), lambda w: w != ""), lambda w: F.xxhash64(w))
    no_digest, no_code = F.lit(None).cast("string"), F.lit(None).cast("long")
    pairs = F.zip_with(hashes, F.slice(hashes, F.lit(2), F.size(hashes)), lambda a, b: F.struct(F.xxhash64(a, b).alias("code"), no_digest.alias("digest")))
    return F.concat(F.array(F.struct(no_code.alias("code"), F.sha2(line, 512).alias("digest"))), pairs)


def vector_sums(code: Column, digest: Column) -> list[Column]:
    """Aggregates that add up the vectors of all codes: exact lanes, number of pairs, packed counters."""
    lane = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    exact = [F.coalesce(F.sum(F.when(digest.isNotNull(), lane(i))), F.lit(0)).bitwiseAND(F.lit(LOW)).alias(f"e{i}") for i in range(EXACT_LANES)]
    packed = [F.coalesce(F.sum(F.shiftrightunsigned(code, k).bitwiseAND(F.lit(PAIR_OF_BITS))), F.lit(0)).alias(f"p{k}") for k in range(1, PACKED + 1)]
    return [*exact, F.count(code).alias("n"), *packed]


#: The columns that make up a fingerprint.
VECTOR = [*(f"e{i}" for i in range(EXACT_LANES)), "n", *(f"p{k}" for k in range(1, PACKED + 1))]


def combined(left: DataFrame, right: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    """The vectors of ``left`` with those of the same keys of ``right`` added (sign 1) or taken away (sign -1).

    Keys that ``right`` lacks keep their vector. ``right`` has each key once at
    most; a null key meets none. What is taken away must have been added before.
    """
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__{c}") for c in VECTOR])
    both = left.join(other.hint("merge"), [F.col(k) == F.col(f"__{k}") for k in keys], "left")
    total = lambda c: F.col(c) + sign * F.coalesce(F.col(f"__{c}"), F.lit(0))
    return both.select(*[c for c in left.columns if c not in VECTOR], *[(total(c).bitwiseAND(F.lit(LOW)) if c.startswith("e") else total(c)).alias(c) for c in VECTOR])


def inserted(vectors: DataFrame, paragraphs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The vectors after the paragraphs of ``paragraphs`` (rows of keys and text) were put into their documents."""
    return combined(vectors, fingerprints(paragraphs, keys, text_col), keys)


def deleted(vectors: DataFrame, paragraphs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The vectors after the paragraphs of ``paragraphs`` (rows of keys and text) were taken out of their documents."""
    return combined(vectors, fingerprints(paragraphs, keys, text_col), keys, -1)


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), digits, "0")


def fingerprint_string() -> Column:
    """The sums of ``vector_sums`` modulo 2**32 (exact lanes, number of pairs) and as they are packed, in hex."""
    parts = [_hex(F.col(f"e{i}").bitwiseAND(F.lit(LOW)), 8) for i in range(EXACT_LANES)]
    return F.concat(*parts, _hex(F.col("n").bitwiseAND(F.lit(LOW)), 8), *[_hex(F.col(f"p{k}"), 16) for k in range(1, PACKED + 1)])


def centred_counts() -> Column:
    packed = F.array(*[F.col(f"p{k}") for k in range(1, PACKED + 1)])
    lanes = F.flatten(F.transform(packed, lambda x: F.array(x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 32))))
    return F.transform(lanes, lambda x: (2 * x - F.col("n")).cast("double"))


def likeness(fa: Column, a: Column, fb: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the cosine of the counts, not below 0; 0 if only one has counts."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(total(F.transform(a, lambda x: x * x)) * total(F.transform(b, lambda x: x * x)))
    cosine = F.when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norms))).otherwise(F.lit(0.0))
    return F.when(fa == fb, F.lit(1.0)).otherwise(cosine)


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and the vector's sums of the texts of each key. Null texts count as empty."""
    lines = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line"))
    codes = lines.select(*keys, F.explode(paragraph_codes(F.col("line"))).alias("__c"))
    return codes.groupBy(*keys).agg(*vector_sums(F.col("__c.code"), F.col("__c.digest")))


def _run_of(order: Column, starts: list[int]) -> Column:
    """Number of the run that an id falls into: runs start at ``starts`` (ascending), the first below all ids."""
    rows = [starts[i : i + 64] for i in range(0, len(starts), 64)]
    row = F.greatest(F.lit(1), F.size(F.filter(F.lit([r[0] for r in rows]), lambda s: s <= order)))
    within = F.size(F.filter(F.element_at(F.lit([r + [(1 << 63) - 1] * (64 - len(r)) for r in rows]), row), lambda s: s <= order))
    return (row - 1) * 64 + F.greatest(F.lit(1), within) - 1


def with_next_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> run, pos, guard, doc_id, text, next_text, following ascending ids; after the last comes the first.

    Ids are dealt into runs between approximate quantiles, whose number is
    bounded; each run ends with a guard, a copy of the next run's first row.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(_FIRST))
    docs = docs.withColumn("order", order)
    rows = docs.count()
    runs = min(MAX_RUNS, -(-rows // RUN_ROWS))
    starts = [_FIRST]
    if runs > 1:
        least, cuts = docs.agg(F.min("order"), F.percentile_approx("order", [i / runs for i in range(1, runs)], 20 * MAX_RUNS)).first()
        starts = [least, *sorted({c for c in cuts if c > least})]
    elif rows:
        starts = [docs.agg(F.min("order")).first()[0]]
    run = _run_of(F.col("order"), starts)
    placed = docs.withColumn("run", run)
    before = F.when(F.col("run") == 0, F.lit(len(starts) - 1)).otherwise(F.col("run") - 1)
    own = F.struct(F.col("run").alias("run"), F.lit(False).alias("guard"))
    is_first = F.col("order") == F.element_at(F.lit(starts), F.col("run") + 1)
    copies = F.when(is_first, F.array(own, F.struct(before.alias("run"), F.lit(True).alias("guard")))).otherwise(F.array(own))
    rows = placed.withColumn("at", F.explode(copies)).select("at.run", "at.guard", "order", "doc_id", "text")
    within = Window.partitionBy("run").orderBy("guard", "order", "text")
    return rows.select("run", F.row_number().over(within).alias("pos"), "guard", "doc_id", "text", F.lead("text").over(within).alias("next_text"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next text by ascending id (null ids come
    first, equal ids follow their texts' order). Null texts count as empty; two
    empty texts are alike (1). A lone document is its own next. An empty table
    gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = with_next_text(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    placed = placed.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["run", "pos", "guard", "doc_id", "n_chars", "edited_sha256", "version"]
    own, other = F.struct(F.lit(0).alias("version"), F.col("text").alias("text")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("text"))
    versions = F.when(F.col("guard"), F.array(own)).otherwise(F.array(own, other))
    both = placed.withColumn("v", F.explode(versions)).select(*keys[:-1], "v.version", "v.text")
    summed = fingerprints(both, keys).select(*keys, fingerprint_string().alias("f"), centred_counts().alias("c"))
    follow = Window.partitionBy("run").orderBy("pos", "version")  # text, edited text, next text, ...
    ahead = lambda name, n: F.lead(name, n).over(follow)
    near = summed.select("*", ahead("f", 1).alias("fe"), ahead("c", 1).alias("ce"), ahead("f", 2).alias("fn"), ahead("c", 2).alias("cn"))
    return near.where((F.col("version") == 0) & ~F.col("guard")).select(
        "doc_id", "n_chars", "edited_sha256", F.col("f").alias("fingerprint"), F.col("fe").alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("c"), F.col("fe"), F.col("ce")).alias("near_edited"),
        likeness(F.col("f"), F.col("c"), F.col("fn"), F.col("cn")).alias("near_next"),
    )
