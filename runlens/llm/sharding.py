"""Minimax contiguous partition of documents into shards.

Equal texts form an atomic group, and groups are ordered by the hash of their
text. The smallest feasible shard capacity is searched in halves over ordered
sizes, each candidate checked greedily, and the run is cut there.

The driver never sees all groups: it starts with the sizes of the ranges that
the first bits of the hash make. A range that may hold a cut of a capacity that
is still possible is split by further bits, again and again, until each of them
is one group, so the cuts are those of the groups themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.llm.common import materialize

#: Bits of the hash that make the first ranges, and by which a range is split.
FIRST_BITS, SPLIT_BITS = 14, 8
#: Rows of a part that is numbered by itself.
PART_ROWS = 50_000


def greedy_cut(sizes: np.ndarray, shards: int, capacity: int) -> np.ndarray | None:
    """The start of each shard after the first if every shard holds at most ``capacity``; else None."""
    total, cuts, at = np.concatenate([[0], np.cumsum(sizes)]), [], 0
    for _ in range(shards):
        end = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        if end == len(sizes):
            return np.array(cuts, np.int64)
        cuts.append(end)
        at = end
    return None


def minimax_cut(sizes: np.ndarray, shards: int) -> tuple[int, np.ndarray]:
    """The smallest capacity for which ordered atomic sizes fit ``shards`` shards, and the cuts."""
    if not len(sizes):
        return 0, np.array([], np.int64)
    low, high = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while low < high:
        mid = (low + high) // 2
        if greedy_cut(sizes, shards, mid) is None:
            low = mid + 1
        else:
            high = mid
    return low, greedy_cut(sizes, shards, low)


def open_ranges(sizes: np.ndarray, single: np.ndarray, shards: int, largest: int) -> np.ndarray:
    """Which ranges of several groups may hold a cut. ``single``: ranges of one group; ``largest``: size of the largest group."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    high, _ = minimax_cut(sizes, shards)  # cuts between ranges are possible, so no more is needed
    low = min(high, max(largest, -(-int(total[-1]) // shards)))
    least = most = 0
    found = np.zeros(len(sizes), bool)
    for _ in range(shards - 1):
        # a shard of capacity low ends not before the range in which it would be full, one of capacity high not after that
        least = int(total[np.searchsorted(total, least + low, side="right") - 1])
        most = min(most + high, int(total[-1]))
        found |= (total[1:] > least) & (total[:-1] < most)
    return found & ~single


def cut_hashes(sizes: DataFrame, shards: int) -> list[int]:
    """The hashes at which each shard after the first begins, of (hash, size) rows: hashes from 0 to 2 ** 62."""
    groups = materialize(sizes.groupBy("hash").agg(F.sum("size").alias("size")), "groups")
    largest = groups.agg(F.max("size")).first()[0]
    if largest is None:
        return []

    def ranges(of: DataFrame, bits: int) -> pd.DataFrame:
        start = F.shiftleft(F.shiftright("hash", 62 - bits), 62 - bits)
        return of.groupBy(start.alias("start")).agg(F.sum("size").alias("size"), F.count("*").alias("groups")).toPandas()

    bits = FIRST_BITS
    known = ranges(groups, bits).assign(bits=bits)  # at most 2 ** FIRST_BITS rows
    while True:
        known = known.sort_values("start", ignore_index=True)
        split = known[open_ranges(known["size"].to_numpy(np.int64), known["groups"].to_numpy() == 1, shards, largest)]
        if split.empty:
            break
        parts = [known.drop(split.index)]
        for before, some in split.groupby("bits"):  # ranges around the at most shards - 1 cuts
            start = F.shiftleft(F.shiftright("hash", 62 - int(before)), 62 - int(before))
            after = min(62, int(before) + SPLIT_BITS)
            chosen = F.broadcast(groups.sparkSession.createDataFrame(some[["start"]].astype("int64"), "begin long"))
            parts.append(ranges(groups.join(chosen, start == F.col("begin"), "left_semi"), after).assign(bits=after))
        known = pd.concat(parts)
    _, cuts = minimax_cut(known["size"].to_numpy(np.int64), shards)
    starts = known["start"].tolist()
    return [starts[c] if c < len(starts) else 1 << 62 for c in cuts]


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``. Size is the text's UTF-8 bytes plus 1; a null text
    has size 1, counts as empty and shares the empty texts' group. Slots run
    from 0 without a gap in each shard; repeated rows each get a slot. Texts of
    the same 62-bit hash count as one group. An empty table gives an empty
    result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("hash"),
    )
    narrow = materialize(narrow, "sizes")
    cuts = cut_hashes(narrow, shards)
    shard = sum((F.when(F.col("hash") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    # rows are dealt into parts by all that they hold, so a group of any size is numbered by many tasks
    parts = max(1, -(-narrow.count() // (shards * PART_ROWS)))
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "hash", "size"), F.lit(parts)).cast("int")
    placed = narrow.withColumn("shard", shard).withColumn("part", part)
    counts = materialize(placed.groupBy("shard", "part").agg(F.count("*").alias("rows")), "part-counts")
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    # a row for PART_ROWS rows
    numbered = placed.join(F.broadcast(offsets), ["shard", "part"])
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "hash", "size")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.row_number().over(within) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
