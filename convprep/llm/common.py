"""Shared parts of the text operators: text buffers, words, hashes, stored tables.

Python stages see a batch as one byte buffer with offsets, so that words and
hashes of many documents are found by a few array operations.  Batches are cut
into pieces of about ``PIECE`` bytes; a longer text is a piece of its own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the array operations.
PIECE = 1 << 20
#: A word is a run of other bytes than these.
SPACES = b" \t\n\v\f\r"
#: The words of a text, as a pattern for SQL.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed whole, one by one.
_LONG = 256


# ---------------------------------------------------------------- tables


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to the folder of ``spark.checkpoint.dir`` and read them back.

    This cuts the lineage with files that survive the loss of executors.  The
    folder has to be set except in local mode, where one machine holds all.
    """
    spark = rows.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="llm-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of a query when it has ended, instead of at some garbage collection."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once, in rows and in bytes; one longer row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes empty.

    ``lower`` equals that where all characters are ASCII, and is much faster.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder by 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


# ---------------------------------------------------------------- buffers


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if big else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(data: np.ndarray, offs: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of pieces of at most ``limit`` bytes, or of one row."""
    first, n = 0, len(offs) - 1
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


# ---------------------------------------------------------------- words and hashes


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, in place where it can be."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit factors that depend on nothing but the arguments."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) | np.uint64(1)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and at which word each text begins (one more entry than texts)."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    space = _SPACE[data]
    word = ~space
    begin, end = word.copy(), word.copy()
    begin[1:] &= space[:-1]
    end[:-1] &= space[1:]
    filled = offs[:-1] < offs[1:]
    firsts, lasts = offs[:-1][filled], offs[1:][filled] - 1
    begin[firsts] = word[firsts]
    end[lasts] = word[lasts]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of the buffer, eight bytes at a time."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.uint64, buf, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = mix(h ^ (eight[starts] & _MASKS[np.minimum(size, 8)]))
    left = np.flatnonzero((size > 8) & (size <= _LONG))
    k = 8
    while left.size:
        part = eight[starts[left] + k] & _MASKS[np.minimum(size[left] - k, 8)]
        h[left] = mix(h[left] * np.uint64(0xC2B2AE3D27D4EB4F) ^ part)
        k += 8
        left = left[size[left] > k]
    for i in np.flatnonzero(size > _LONG):
        whole = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        h[i] = int.from_bytes(whole, "little")
    return h


def grams(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of every n consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j, factor in enumerate(multipliers(n, seed)):
        total += words[j : j + m] * factor
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def offsets_of(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in the flattened values; for columns without null lists."""
    limits = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return limits - limits[0]
