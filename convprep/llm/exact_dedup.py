"""Exact deduplication by content sort.

Sampled splitters range-partition the texts, an external sort puts equal texts
next to each other, and neighbours are compared in full.  The order is by the
first characters, then a digest, then the whole normalised text, so that what
is sampled for the splitters stays short whatever the texts.

A text that holds more than one row in ``HOT_SHARE`` is hot: there are at most
``HOT_SHARE`` of them.  Its rows are dealt over ``BLOCKS`` blocks by their id,
and the summaries of the blocks, a few rows, are put together at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convprep.llm.common import ascii_lower, table

#: Texts with more than one row in so many are hot.
HOT_SHARE = 200
#: Parts that a hot text is sorted in.
BLOCKS = 256
#: Characters that lead the order.
LEAD = 24


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with keep_id, group_size, kept and text_sha256 added.

    Texts are equal when the same after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest id stays; of rows that repeat that
    id, one.  A null id is smaller than any other.  An empty table gives an
    empty table; other columns pass through, those with the added names are
    replaced.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    base = docs.select(
        others.alias("row"), F.col(doc_id).alias("id"), ascii_lower(F.col(text)).alias("norm")
    )
    # Equal texts stay equal under this cheaper form, so no hot text is missed.
    proxy = docs.select(F.xxhash64(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("proxy"))
    counts = proxy.groupBy("proxy").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*")).scalar()
    hot = F.broadcast(counts.filter(F.col("n") * HOT_SHARE > total).select("proxy", F.lit(True).alias("hot")))
    keyed = (
        base.withColumn("proxy", F.xxhash64(F.lower(F.coalesce(F.col(f"row.{text}"), F.lit("")))))
        .join(hot, "proxy", "left")
        .withColumn("block", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(BLOCKS))).otherwise(F.lit(0)))
        .withColumn("lead", F.substring("norm", 1, LEAD))
        .withColumn("sha", F.sha2(F.col("norm"), 256))
        .select("row", "id", "norm", "hot", "block", "lead", "sha")
    )
    ranged = keyed.repartitionByRange("lead", "sha", "block")
    equal = Window.partitionBy("lead", "sha", "block", "norm").orderBy(F.col("id").desc_nulls_last())
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = ranged.select(
        "row",
        "hot",
        "sha",
        "block",
        F.row_number().over(equal).alias("nth"),
        F.first("id").over(whole).alias("best"),
        F.count("*").over(whole).alias("n"),
    )
    hot_rows = (
        seen_of_blocks(docs, hot, doc_id, text)
        .groupBy("sha")
        .agg(
            F.max("best").alias("hot_best"),
            F.sum("n").alias("hot_n"),
            F.max(F.struct("best", "block"))["block"].alias("hot_block"),
        )
    )
    out = seen.join(F.broadcast(hot_rows), "sha", "left")
    first_block = F.coalesce(F.col("block") == F.col("hot_block"), F.lit(True))
    return out.select(
        "row.*",
        F.coalesce("hot_best", "best").alias("keep_id"),
        F.coalesce("hot_n", "n").alias("group_size"),
        ((F.col("nth") == 1) & first_block).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def seen_of_blocks(docs: DataFrame, hot: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Largest id and number of rows for each block of each hot text; at most ``HOT_SHARE * BLOCKS`` rows."""
    return (
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        .withColumn("proxy", F.xxhash64(F.lower(F.coalesce("text", F.lit("")))))
        .join(hot, "proxy")
        .select(
            F.sha2(ascii_lower(F.col("text")), 256).alias("sha"),
            F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).alias("block"),
            "id",
        )
        .groupBy("sha", "block")
        .agg(F.max("id").alias("best"), F.count("*").alias("n"))
    )


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
