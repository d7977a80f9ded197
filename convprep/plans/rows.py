"""From prepared CSV files to the rows that training reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convprep.functions.rendering import training_text
from convprep.operators.report import Funnel, require_rows
from convprep.operators.split import EVAL, TRAIN, split_ordered
from convprep.plans.session import stored
from convprep.sources.readers import accepted, problem_counts, read_prepared_csv

DECLARED = ("prompt", "completion")


def clean_rows(read: DataFrame, funnel: Funnel | None = None) -> DataFrame:
    """Stored ``source, prompt, completion`` of the readable records, the first of equal ones.

    The records are stored before copies are looked for, so the shuffle files
    of the reader are gone when those of the search are written.
    """
    funnel = funnel or Funnel()
    records = stored(accepted(funnel.read(read)), "records")
    return stored(funnel.unique(records.groupBy(*DECLARED).agg(F.min("source").alias("source"))), "rows")


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``place``, an integer in the order of files and of records in them.

    Each input split gets a range of its own, as wide as its row numbers; one
    row for each split goes through the window that puts them in order.  As
    many rows as the scan had splits are broadcast, so the text stays in place.
    """
    split = [F.col("source.file").alias("_file"), F.col("source.start").alias("_start")]
    widths = rows.groupBy(*split).agg(
        F.min("source.row").alias("_low"), (F.max("source.row") - F.min("source.row") + 1).alias("_wide")
    )
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("_wide").over(before), F.lit(0))
    shifts = widths.select("_file", "_start", (at - F.col("_low")).alias("_shift"))
    same = (F.col("source.file") == F.col("_file")) & (F.col("source.start") == F.col("_start"))
    placed = rows.join(F.broadcast(stored(shifts, "shifts")), same)
    return placed.withColumn("place", F.col("source.row") + F.col("_shift")).drop("_file", "_start", "_shift")


def training_rows(
    spark: SparkSession,
    train_path: str,
    eval_path: str | None = None,
    train_ratio: float = 0.8,
    funnel: Funnel | None = None,
) -> DataFrame:
    """``prompt, completion, text, split`` of prepared CSV files.

    Records that are not UTF-8 go (see ``dropped_rows``), copies on a side
    become one, ``text`` is prompt and completion without the spaces at the
    seam.  Without evaluation files the first ``train_ratio`` of the rows in
    file order are ``train``.  An empty side is an error.  A ``funnel`` counts
    what was kept and dropped on both sides, without a scan of its own.
    """
    train = clean_rows(read_prepared_csv(spark, train_path, DECLARED), funnel)
    if eval_path is None:
        require_rows(train, "no rows to train on")
        rows = split_ordered(numbered(train), train_ratio, "place")
    else:
        evaluation = clean_rows(read_prepared_csv(spark, eval_path, DECLARED), funnel)
        sides = ((TRAIN, train), (EVAL, evaluation))
        for name, side in sides:
            require_rows(side, f"no rows on the {name} side")
        rows = train.withColumn("split", F.lit(TRAIN)).unionByName(evaluation.withColumn("split", F.lit(EVAL)))
    return rows.select(*DECLARED, training_text(F.col("prompt"), F.col("completion")).alias("text"), "split")


def dropped_rows(spark: SparkSession, path: str) -> DataFrame:
    """``problem, n`` of prepared CSV files, NULL for the records that are kept."""
    return problem_counts(read_prepared_csv(spark, path, DECLARED))
