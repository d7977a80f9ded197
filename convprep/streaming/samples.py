"""Samples of chat files as they arrive.

Parsing, validity, turns, budget and rendering work on one chat at a time, so
the batch operators run unchanged on a stream, without state.  Removing copies
and splitting by exact size need the whole set and stay batch steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convprep.functions.messages import fingerprint
from convprep.operators.samples import EXACT, chat_samples
from convprep.profiles import SECTIONED, Profile
from convprep.sources.readers import accepted, parse_chat_lines


def stream_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Chats of JSON lines files that appear in a folder; the chat id is its fingerprint."""
    lines = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("source"), "value")
    chats = accepted(parse_chat_lines(lines))
    return chats.select(fingerprint(F.col("messages")).alias("chat_id"), "messages")


def write_samples(
    chats: DataFrame,
    out: str,
    checkpoint: str,
    profile: Profile = SECTIONED,
    budget: int | None = None,
    mode: str = EXACT,
) -> StreamingQuery:
    """Write the samples of all files present, exactly once, and stop."""
    samples = chat_samples(chats, profile, budget if budget is not None else profile.max_length, mode)
    sink = samples.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return sink.trigger(availableNow=True).start(out)
