"""How long the samples are, and which sequence length holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convprep.functions.rendering import training_text
from convprep.functions.tokens import CANDIDATE_LENGTHS, length_bucket, rendered_tokens


def sample_tokens(prompt: Column, completion: Column, counter=None) -> Column:
    """Tokens of a sample with the begin and end tokens that training adds."""
    return rendered_tokens(training_text(prompt, completion), counter)


def longest(samples: DataFrame, counter=None) -> DataFrame:
    """``max_tokens`` per side (0 for an empty side) and overall, one row."""
    sized = samples.select("split", sample_tokens(F.col("prompt"), F.col("completion"), counter).alias("n"))
    side = lambda name: F.coalesce(F.max(F.when(F.col("split") == name, F.col("n"))), F.lit(0))
    return sized.agg(side("train").alias("train_tokens"), side("eval").alias("eval_tokens")).withColumn(
        "max_tokens", F.greatest("train_tokens", "eval_tokens")
    )


def choose_length(samples: DataFrame, counter=None, candidates: list[int] | None = None) -> DataFrame:
    """Add ``sequence_length``, the smallest candidate strictly above the longest sample.

    Fails with the offending count when no candidate is large enough.
    """
    found = length_bucket(F.col("max_tokens"), candidates or CANDIDATE_LENGTHS)
    too_long = F.raise_error(
        F.concat(F.lit("no sequence length above "), F.col("max_tokens").cast("string"), F.lit(" tokens"))
    ).cast("int")
    return longest(samples, counter).withColumn("sequence_length", F.coalesce(found, too_long))
