"""Exact removal of repeated chats and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convprep.functions.messages import fingerprint
from convprep.operators.chats import dense_positions, has_long_chats
from convprep.operators.running import WIDTH
from convprep.operators.turns import (
    FINGERPRINT,
    chat_validity,
    message_digests,
    message_turns,
    turn_facts,
)


def chat_facts(messages: DataFrame, long_chats: bool | None = None) -> DataFrame:
    """``chat_id, n_messages, valid`` and fingerprint of every chat, without its text.

    One shuffle of numbers; the later steps decide on this narrow table which
    chats to keep before any text is moved.  ``long_chats`` tells whether to
    spread chats over blocks, where the caller knows; else it is looked up.
    """
    if long_chats is None:
        messages = dense_positions(messages)
        long_chats = has_long_chats(messages, WIDTH)
    width = WIDTH if long_chats else None
    numbered = message_turns(messages.select("*", *message_digests()), width)
    return chat_validity(turn_facts(numbered, ["chat_id", "turn"]))


def first_chats(facts: DataFrame) -> DataFrame:
    """``chat_id, n_messages`` of the first of each set of equal valid chats.

    First means smallest ``chat_id``.  A group of copies shrinks to one row per
    map task before the shuffle, however large it is.
    """
    return (
        facts.filter("valid")
        .groupBy("n_messages", *FINGERPRINT)
        .agg(F.min("chat_id").alias("chat_id"))
        .select("chat_id", "n_messages")
    )


def dedupe_chats(chats: DataFrame, order: str = "chat_id") -> DataFrame:
    """First occurrence of each chat of a chat table, by the unique column ``order``.

    The copies are counted on fingerprints; the text is joined on the unique
    order column, so a large group of copies never shares a key.
    """
    winners = (
        chats.select(fingerprint(F.col("messages")).alias("_fp"), F.col(order))
        .groupBy("_fp")
        .agg(F.min(order).alias(order))
        .select(order)
    )
    return chats.join(winners, order, "left_semi")


def dedupe_rows(rows: DataFrame, columns: list[str] | tuple[str, ...] = ("prompt", "completion")) -> DataFrame:
    """Distinct rows over ``columns``; copies combine map-side."""
    return rows.select(*columns).distinct()


def cast_declared(rows: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Project the declared columns that exist, each cast to its declared type."""
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in declared.items() if c in rows.columns])

