"""Prompts for batches of requests, and the replies that come back."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convprep.functions.messages import (
    MESSAGES_DDL,
    SYSTEM,
    USER,
    body_of,
    message,
    no_messages,
    normalize_messages,
    preamble_of,
)
from convprep.functions.rendering import render_messages, reply_between
from convprep.functions.validity import is_valid_inference
from convprep.profiles import TURN_END, Profile, profile_columns


def request_messages(preamble: Column, history: Column, text: Column) -> Column:
    """Preamble, history and message, each optional, as one message list."""
    lead = F.when(F.coalesce(preamble, F.lit("")) != "", F.array(message(SYSTEM, preamble)))
    last = F.when(F.coalesce(text, F.lit("")) != "", F.array(message(USER, text)))
    none = no_messages()
    return F.concat(
        F.coalesce(lead.cast(MESSAGES_DDL), none), F.coalesce(history, none), F.coalesce(last.cast(MESSAGES_DDL), none)
    )


def request_prompts(requests: DataFrame, profile: Profile | Column) -> DataFrame:
    """Add ``prompt`` and ``problem`` to requests.

    ``requests`` has ``preamble``, ``chat_history`` and ``message``.  Validity
    is checked on the roles as given, before they become canonical.
    """
    p = profile_columns(profile)
    raw = requests.withColumn(
        "_raw", request_messages(F.col("preamble"), F.col("chat_history"), F.col("message"))
    ).withColumn("_valid", is_valid_inference(F.col("_raw")))
    ready = raw.withColumn("_messages", normalize_messages(F.col("_raw")))
    rendered = render_messages(p, preamble_of(F.col("_messages")), body_of(F.col("_messages")))
    return ready.select(
        *requests.columns,
        F.when(F.col("_valid"), rendered).alias("prompt"),
        F.when(~F.col("_valid"), "invalid_input").alias("problem"),
    )


def batch_generate(
    prompts: DataFrame, generator: Callable[[list[str]], list[str]], id_col: str = "req_id"
) -> DataFrame:
    """Run a user's generator over Arrow batches: ``id, prompt, decoded, latency``.

    The generator returns, for each prompt, the decoded text with the prompt
    in front and the end token behind.  Latency is that of the batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            began = time.perf_counter()
            decoded = generator(list(batch["prompt"]))
            spent = f"{(time.perf_counter() - began) * 1000:.0f}ms"
            yield batch.assign(decoded=decoded, latency=spent)

    rows = prompts.select(id_col, "prompt")
    key = rows.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"{id_col} {key}, prompt string, decoded string, latency string")


def extract_replies(generated: DataFrame, end_token: str = TURN_END) -> DataFrame:
    """Add ``text`` and ``problem``; a generation cut short has no reply."""
    text = reply_between(F.col("decoded"), F.col("prompt"), end_token)
    return generated.withColumn("text", text).withColumn(
        "problem", F.when(F.col("text").isNull(), "truncated_generation")
    )
