"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``PLACES`` places; every shard owns ``VIRTUAL`` of them, drawn by
hash.  A row belongs to the next owned place clockwise from its own.  Rows are
taken in ring order, and a row that finds a shard full goes on clockwise to the
next one that is not.  Only the counts of the places, a table whose size is a
parameter, decide who overflows; rows get their rank inside a place, so no
task sees more than one place's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convprep.llm.common import table

PLACES = 1 << 16
VIRTUAL = 128
SHARDS = 8


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, by place; of two on one place the later one moves on."""
    nodes = (
        spark.range(shards * virtual)
        .select(
            (F.col("id") / virtual).cast("int").alias("shard"),
            F.pmod(F.xxhash64(F.lit("node"), "id"), F.lit(PLACES)).cast("int").alias("place"),
        )
        .orderBy("shard", "place")
    )
    owner: dict[int, int] = {}
    for row in nodes.collect():
        place = row["place"]
        while place in owner:
            place = (place + 1) % PLACES
        owner[place] = row["shard"]
    return sorted(owner.items())


def assignment(
    counts: dict[int, int], nodes: list[tuple[int, int]], shards: int, room: list[int]
) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, rank after the last, shard, slot of the first) for all rows of all places.

    Rows go clockwise in ring order; ``room`` is how many each shard takes.
    Its sum must be at least the number of rows.
    """
    left, used = list(room), [0] * shards
    out = []
    at = 0
    for place in sorted(counts):
        while at < len(nodes) and nodes[at][0] < place:
            at += 1
        rank, waiting, node = 0, counts[place], at
        while waiting:
            shard = nodes[node % len(nodes)][1]
            taken = min(waiting, left[shard])
            if taken:
                out.append((place, rank, rank + taken, shard, used[shard]))
                used[shard] += taken
                left[shard] -= taken
                rank += taken
                waiting -= taken
            node += 1
    return out


def even_room(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard takes: sizes at most one apart, or ``1 + slack`` times the mean."""
    if slack:
        return [int(rows * (1 + slack) / shards) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", slack: float = 0.0) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    With ``slack`` 0 the numbers of rows differ by at most one; with more, a
    shard takes up to ``1 + slack`` times the mean and fewer rows move when the
    number of shards changes.  Rows are ordered by the hash of the key, the key
    and a hash of the other columns; rows with the same key share a place, null
    is a key like another.  An empty table gives an empty table.  Columns with the added
    names are replaced.
    """
    spark = docs.sparkSession
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    placed = docs.select(
        F.struct(*columns).alias("row"), F.xxhash64(F.lit("row"), F.col(key)).alias("hash")
    ).withColumn("place", F.pmod("hash", F.lit(PLACES)).cast("int"))
    counted = placed.groupBy("place").count().collect()
    counts = {r["place"]: r["count"] for r in counted}
    plan = assignment(counts, ring(spark, shards), shards, even_room(sum(counts.values()), shards, slack))
    fields = "place int, low bigint, high bigint, shard int, base bigint"
    # At most PLACES + shards * PLACES rows, whatever the data.
    parts = F.broadcast(spark.createDataFrame(plan, fields))
    others = [c for c, kind in sorted(docs.dtypes) if c not in (key, "shard", "slot") and "map<" not in kind]
    tie = F.xxhash64(F.lit("tie"), *[F.col(f"row.`{c}`") for c in others])
    order = [F.col("hash"), F.col(f"row.`{key}`"), tie]
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order)) - 1)
    held = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(parts, "place").filter(held).select(
        "row.*", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot")
    )


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus one) and text_crc32 (0 if there is no text) of each document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard(sized(table(spark, folder, "documents")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
