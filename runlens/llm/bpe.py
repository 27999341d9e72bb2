"""Byte-level BPE as a monoid tree reduction.

A text is halved down to leaves of about a line, which are encoded alone. Two
neighbours are joined by encoding a window around their boundary anew. The
window grows on either side until it ends where a letter or digit meets a space
or a punctuation mark: no match of the splitting pattern goes on after a letter
or digit with anything but its own kind, so such a place lies between two
matches whatever stands elsewhere, and the tokens beyond it are those of the
whole text. If there is no such place, the window is the whole node. The tokens
that the window replaces are told by their bytes. Decoding concatenates bytes
up the same kind of tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import extended, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of a leaf.
LEAF = 128
#: First reach of the search for a place where the tokens are stable; doubled as long as none is found.
WINDOW = 16
#: Spaces and punctuation of ASCII, of general use and of East Asian texts, after a letter or digit.
_STABLE = re.compile("(?<=[^\\W_])[\x00-/:-@\\[-`{-\x7f\u2010-\u2027\u3000-\u3004\u3008-\u301b\uff01-\uff0f\uff1a-\uff1f]")

Ids = np.ndarray


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    with open(path, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}


def left_edge(text: str, start: int, at: int) -> int:
    """The last stable place in text[start:at]; start if there is none."""
    reach = WINDOW
    while True:
        low = max(start, at - reach)
        place = start
        for m in _STABLE.finditer(text, low, at):
            place = m.start()
        if place > start or low == start:
            return place
        reach *= 2


def right_edge(text: str, at: int, end: int) -> int:
    """The first stable place after ``at``, the letter before it included; end if there is none."""
    reach, low = WINDOW, at + 1
    while True:
        high = min(end, at + 1 + reach)
        m = _STABLE.search(text, low, high)
        if m or high == end:
            return m.start() if m else end
        low, reach = high, reach * 2


def n_tokens(ids: list[int], lengths: list[int], size: int, back: bool) -> int:
    """How many tokens at the end (``back``) or the beginning of a node make up ``size`` bytes."""
    n = 0
    while size > 0:
        n += 1
        size -= lengths[ids[-n] if back else ids[n - 1]]
    return n


def join(text: str, start: int, at: int, end: int, left: list[int], right: list[int], encode, lengths: list[int]) -> list[int]:
    """Tokens of text[start:end] from those of text[start:at] and of text[at:end]."""
    p, q = left_edge(text, start, at), right_edge(text, at, end)
    keep = len(left) - n_tokens(left, lengths, len(text[p:at].encode()), True)
    skip = n_tokens(right, lengths, len(text[at:q].encode()), False)
    return left[:keep] + encode(text[p:q]) + right[skip:]


def encode_tree(text: str, encode, lengths: list[int], leaf: int = LEAF, start: int = 0, end: int | None = None) -> list[int]:
    end = len(text) if end is None else end
    if end - start <= leaf:
        return encode(text[start:end])
    at = (start + end) // 2
    left, right = encode_tree(text, encode, lengths, leaf, start, at), encode_tree(text, encode, lengths, leaf, at, end)
    return join(text, start, at, end, left, right, encode, lengths)


def decode_tree(ids: list[int], table: dict[int, bytes], leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return b"".join(map(table.__getitem__, ids))
    at = len(ids) // 2
    return decode_tree(ids[:at], table, leaf) + decode_tree(ids[at:], table, leaf)


@lru_cache(maxsize=4)
def token_lengths(path: str) -> list[int]:
    table = token_bytes(path)
    return [len(table.get(i, b"")) for i in range(max(table) + 1)]


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode, lengths = encoding(path).encode_ordinary, token_lengths(path)
    for batch in slices(batches):
        counts, packed = [], []
        for text in batch.column(batch.num_columns - 1):
            ids = encode_tree(text.as_py() or "", encode, lengths)
            counts.append(len(ids))
            packed.append(np.array(ids, "<u4").tobytes())
        columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_tokens", "ids"])


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = token_bytes(path)
    for batch in batches:
        texts = [decode_tree(np.frombuffer(ids.as_py() or b"", "<u4").tolist(), table) for ids in batch.column(batch.num_columns - 1)]
        columns = [*batch.columns, pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "decoded"])


def encode_documents(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` columns, n_tokens and ids (little-endian unsigned 32-bit integers) of every row.

    A null text counts as the empty text and has no tokens. ``path`` names the
    file of ranks, which every executor can read (it belongs to an installed
    package). Repeated rows each get a row; an empty table gives an empty result.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    schema = extended(docs.select(*keep).schema, n_tokens=T.LongType(), ids=T.BinaryType())
    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(partial(_encode_batches, path=str(path)), schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` and the bytes that its last column, ids, stands for."""
    path = path or public_tokenizers.path(VOCABULARY)
    return encoded.mapInArrow(partial(_decode_batches, path=str(path)), extended(encoded.schema, decoded=T.BinaryType()))


def _round_trip_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    return _decode_batches(_encode_batches(batches, path), path)


def round_trip(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """``encode_documents``, then ``decode_documents``, by one Python worker for each task."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = extended(docs.select(*keep).schema, n_tokens=T.LongType(), ids=T.BinaryType(), decoded=T.BinaryType())
    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(partial(_round_trip_batches, path=str(path)), schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, after encoding and decoding it."""
    out = round_trip(docs, [id_col], text_col)
    return out.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
