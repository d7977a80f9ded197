"""Counts of what was kept and dropped on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from convprep.operators.turns import FINGERPRINT


def _long(counts: DataFrame, stages: list[str]) -> DataFrame:
    return counts.unpivot([], stages, "stage", "n")


def funnel(facts: DataFrame) -> DataFrame:
    """``stage, n`` for chats: loaded, valid, invalid, unique, duplicate; one pass over the facts."""
    groups = facts.groupBy("valid", "n_messages", *FINGERPRINT).agg(F.count(F.lit(1)).alias("copies"))
    copies = F.col("copies")
    counts = groups.agg(
        F.coalesce(F.sum(copies), F.lit(0)).alias("loaded"),
        F.coalesce(F.sum(F.when(F.col("valid"), copies)), F.lit(0)).alias("valid"),
        F.coalesce(F.sum(F.when(~F.col("valid"), copies)), F.lit(0)).alias("invalid"),
        F.count_if("valid").alias("unique"),
        F.coalesce(F.sum(F.when(F.col("valid"), copies - 1)), F.lit(0)).alias("duplicate"),
    )
    return _long(counts, ["loaded", "valid", "invalid", "unique", "duplicate"])


class Funnel:
    """Counts from files to distinct rows, gathered by the passes that do the work.

    A plan watches its rows where it reads them and where it has found the
    distinct ones; the counts are there when the plan has stored these rows.
    """

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def watch(self, rows: DataFrame, *counts: Column) -> DataFrame:
        """The same rows; what runs over them also counts."""
        self._seen.append(Observation())
        return rows.observe(self._seen[-1], *counts)

    def read(self, rows: DataFrame, valid: Column | None = None) -> DataFrame:
        """Rows of a reader: all, those it could not decode, and those that are not ``valid``."""
        decoded = F.col("problem").isNull()
        invalid = F.lit(False) if valid is None else ~F.coalesce(valid, F.lit(False))
        return self.watch(
            rows,
            F.count(F.lit(1)).alias("loaded"),
            F.count_if(~decoded).alias("undecodable"),
            F.count_if(decoded & invalid).alias("invalid"),
        )

    def unique(self, rows: DataFrame) -> DataFrame:
        return self.watch(rows, F.count(F.lit(1)).alias("unique"))

    def report(self, spark: SparkSession) -> DataFrame:
        """``stage, n``: loaded, undecodable, invalid, duplicate, unique, over all watched sides."""
        n = dict.fromkeys(("loaded", "undecodable", "invalid", "unique"), 0)
        for seen in self._seen:
            for stage, count in seen.get.items():
                n[stage] += count
        n["duplicate"] = n["loaded"] - n["undecodable"] - n["invalid"] - n["unique"]
        return spark.createDataFrame(list(n.items()), "stage string, n bigint")


def split_sizes(rows: DataFrame) -> DataFrame:
    """``stage, n`` with the size of each side of a split."""
    return rows.groupBy(F.col("split").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def require_rows(rows: DataFrame, message: str) -> DataFrame:
    """The same rows; raises on the driver when there are none."""
    if rows.isEmpty():
        raise ValueError(message)
    return rows


def preview(samples: DataFrame, by: tuple[str, ...] = ("chat_id", "turn")) -> DataFrame:
    """The first sample, for a log line."""
    return samples.orderBy(*by).limit(1)
