"""Document fingerprints by winnowing.

Hashes of all runs of ``GRAM`` characters are rolled by doubling; in every
window of ``WINDOW`` of them the smallest is chosen, of equal ones the
rightmost, and kept with its position.  Two texts that share a run of
``GRAM + WINDOW - 1`` characters share at least one fingerprint.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convprep.llm.common import bounded_batches, mix, multipliers, table

#: Characters of a gram and grams of a window; both are powers of two.
GRAM = 8
WINDOW = 8
#: Bits of a position inside a block, and grams of a block; a hash has the other bits.
PLACE_BITS = 24
BLOCK = 1 << 20
#: Characters of the texts whose results are passed on together.
HELD_CHARS = 1 << 20
#: Bytes of texts in a range of neighbours, about, and the most ranges; a range is streamed, so it may grow.
RANGE_BYTES = 32 << 20
RANGES = 65_536

_PLACES = np.uint64((1 << PLACE_BITS) - 1)


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """Hash of every run of ``GRAM`` characters; a shorter text is one run."""
    h = mix(points.astype(np.uint64) + np.uint64(1))
    if len(h) < GRAM:
        return mix(np.array([(h * multipliers(len(h), 5)).sum(dtype=np.uint64)], np.uint64)) if len(h) else h
    span = 1
    for factor in multipliers(GRAM.bit_length() - 1, 3):
        h = h[:-span] * factor + h[span:]
        span *= 2
    return mix(h)


def winnow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (of 40 bits) and their positions, by position; a text with fewer grams is one window."""
    chosen = []
    # Blocks overlap by what a window and a gram reach over, so that the result does not depend on them.
    for first in range(0, max(1, len(points) - GRAM - WINDOW + 2), BLOCK):
        part = points[first : first + BLOCK + WINDOW + GRAM - 2]
        h = gram_hashes(part)
        if not len(h):
            break
        place = np.arange(len(h), dtype=np.uint64)
        # The smallest key has the smallest hash and of equal ones the largest position.
        key = (h & ~_PLACES) | (_PLACES - place)
        width = min(WINDOW, len(key))
        low, span = key, 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(key) - width + 1], low[width - span :])
        low = low[np.concatenate([[True], low[1:] != low[:-1]])]
        places = (_PLACES - (low & _PLACES)).astype(np.int64) + first
        chosen.append(np.stack([(low >> np.uint64(PLACE_BITS)).astype(np.int64), places]))
    if not chosen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, places = np.concatenate(chosen, axis=1)
    fresh = np.concatenate([[True], places[1:] != places[:-1]])
    return hashes[fresh], places[fresh]


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def as_text(hashes: np.ndarray, places: np.ndarray) -> str:
    """Position and hash of each choice, like ``12:00ab34cd56``."""
    return " ".join([f"{p}:{h:010x}" for p, h in zip(places.tolist(), hashes.tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with arrays ``hashes`` and ``places``.

    A null or empty text has none.  Texts shorter than a gram have the hash of
    the whole.  Texts of any length are read whole, in blocks.  Columns with
    the added names are replaced; repeated rows get equal values.
    """
    names = [c for c in docs.columns if c not in ("hashes", "places")]
    chosen = docs.select(*[F.col(f"`{c}`") for c in names])
    place = names.index(text)
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("hashes", "places")]
    schema = T.StructType([*chosen.schema.fields, *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(points_of(t.as_py() or "")) for t in batch.column(place)]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*names, "hashes", "places"])

    return chosen.mapInArrow(run, schema)


# ---------------------------------------------------------------- a document and the next


def ranges_of(docs: DataFrame) -> int:
    """Number of ranges: enough for all cores, and for the bytes of the texts."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    busy = 2 * docs.sparkSession.sparkContext.defaultParallelism
    return max(1, min(max(busy, -(-size // RANGE_BYTES)), rows, RANGES))


def buckets_with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(bucket, own, doc_id, text): ``parts`` ranges of ids at most, each with the first document of the next range.

    Splitters come from the ids' quantiles, and a row finds its range in two
    steps.  After the last range comes the first one.  All rows with a range's
    smallest id are lent to the range before, which takes the first of them.
    """
    ids = docs.select("doc_id")
    steps = [k / parts for k in range(1, parts)]
    cuts = sorted(set(ids.approxQuantile("doc_id", steps, 0.1 / parts))) if steps else []
    bucket = F.lit(0)
    if cuts:
        cuts = [int(c) for c in cuts]
        width = math.isqrt(len(cuts)) + 1
        coarse = F.lit(cuts[width - 1 :: width])
        fine = F.array(*[F.lit(cuts[k : k + width] or [2**63 - 1]) for k in range(0, len(cuts) + width, width)])
        below = lambda c: c <= F.col("doc_id")
        step = F.size(F.filter(coarse, below))
        bucket = step * width + F.size(F.filter(F.get(fine, step), below))
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(bucket)
    placed = docs.withColumn("bucket", bucket)
    # One row for each range.
    least = placed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("least"))
    firsts = sorted((r["bucket"], r["least"]) for r in least.collect())
    lenders = {}
    for (_, least_id), (before, _) in zip(firsts, firsts[-1:] + firsts[:-1]):
        lenders[least_id] = before
    own = placed.withColumn("own", F.lit(True))
    if not lenders:
        return own.select("bucket", "own", "doc_id", "text")
    known = [k for k in lenders if k is not None]
    lent_to = F.lit(None).cast("int")
    if known:
        pairs = F.create_map(*[F.lit(x) for k in known for x in (k, lenders[k])])
        lent_to = F.element_at(pairs, F.col("doc_id"))
        docs_lent = docs.filter(F.col("doc_id").isin(known) | F.col("doc_id").isNull())
    else:
        docs_lent = docs
    if None in lenders:
        lent_to = F.when(F.col("doc_id").isNull(), lenders[None]).otherwise(lent_to)
    lent = docs_lent.withColumn("bucket", lent_to).filter("bucket is not null").withColumn("own", F.lit(False))
    return own.select("bucket", "own", "doc_id", "text").unionByName(lent.select("bucket", "own", "doc_id", "text"))


EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next one's, compared.

    ``docs`` has doc_id and text.  The next document is that with the next id,
    null ids first and equal ids by text; after the last comes the first.  The
    texts move once, to ranges of ids.
    """
    bounded_batches(docs.sparkSession)
    parts = ranges_of(docs)
    # One partition a range.
    sorted_rows = (
        buckets_with_next(docs, parts)
        .repartitionById(parts, "bucket")
        .sortWithinPartitions("bucket", F.desc("own"), F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        for batch in batches:
            rows, held = [], 0
            for bucket, own, doc_id, text in zip(*[batch.column(k) for k in range(4)]):
                bucket, own, doc_id, text = bucket.as_py(), own.as_py(), doc_id.as_py(), text.as_py() or ""
                points = points_of(text)
                now = (bucket, doc_id, text, points, winnow(points))
                if before is not None and before[0] == bucket:
                    rows.append(pair(before, now))
                    held += len(before[3])
                before = now if own else None
                if held >= HELD_CHARS:
                    yield columns_of(rows)
                    rows, held = [], 0
            if rows:
                yield columns_of(rows)

    def pair(one: tuple, two: tuple) -> tuple:
        _, doc_id, text, points, (hashes, places) = one
        half = len(points) // 2
        edited = text[: len(text) - half] + two[2][:half]
        edited_points = np.concatenate([points[: len(points) - half], two[3][:half]])
        edited_hashes, edited_places = winnow(edited_points)
        mine, changed, other = np.unique(hashes), np.unique(edited_hashes), np.unique(two[4][0])
        return (
            doc_id,
            len(points),
            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            as_text(hashes, places),
            as_text(edited_hashes, edited_places),
            likeness(mine, changed),
            likeness(mine, other),
        )

    def columns_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [part.split()[0] for part in EDITED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return sorted_rows.mapInArrow(run, EDITED)


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compared_with_next(table(spark, folder, "documents").select("doc_id", "text"))
