"""Message tables and chats.

Two shapes are used.  A *message table* has one row per message
(``chat_id, pos, role, content``) with ``pos`` running 0, 1, 2, ... inside each
chat; it puts no limit on the length of a chat.  A *chat table* has one row per
chat (``chat_id, messages``).  A chat in the second shape is bounded by
``BLOCK`` messages here, or by one input record when it was read from a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convprep.functions.messages import normalize_role, pair_messages
from convprep.operators.running import block_of, running_total

BLOCK = 1024
#: Rows of a chat that share one copy of its facts.
SPREAD = 4096


def message_table(
    table: DataFrame,
    chat_id: str = "conv_id",
    pos: str = "turn",
    role: str = "role",
    content: str = "text",
    normalize: bool = True,
) -> DataFrame:
    """A message table from any flat table; roles become canonical by default."""
    named = F.col(role)
    return table.select(
        F.col(chat_id).alias("chat_id"),
        F.col(pos).alias("pos"),
        (normalize_role(named) if normalize else named).alias("role"),
        F.col(content).alias("content"),
    )


def dense_positions(messages: DataFrame) -> DataFrame:
    """The same messages with positions 0, 1, 2, ... in each chat.

    Operators count on such positions.  One aggregation of numbers tells
    whether they hold already, as they do in tables made for it; if not, for
    instance where positions begin at 1 or have gaps, messages are renumbered
    in their order.
    """
    seen = messages.groupBy("chat_id").agg(
        F.min("pos").alias("_low"), F.max("pos").alias("_high"), F.count(F.lit(1)).alias("_n")
    )
    if seen.filter((F.col("_low") != 0) | (F.col("_high") != F.col("_n") - 1)).isEmpty():
        return messages
    ones = messages.withColumn("_one", F.lit(1).cast("long"))
    numbered = running_total(ones, ["chat_id"], "pos", "_one", "_pos")
    return numbered.withColumn("pos", F.col("_pos")).select(*messages.columns)


def has_long_chats(messages: DataFrame, block: int = BLOCK) -> bool:
    """Whether any chat exceeds ``block`` messages.

    Reads the position column only, with the comparison pushed to the scan, so
    row groups without such positions are skipped by their statistics.
    """
    return not messages.filter(F.col("pos") >= block).select("pos").limit(1).isEmpty()


def long_blocks(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block of every chat that exceeds ``block`` messages."""
    last = messages.filter(F.col("pos") >= block).groupBy("chat_id").agg(F.max("pos").alias("pos"))
    return last.select(
        "chat_id", F.explode(F.sequence(F.lit(0).cast("long"), block_of("pos", block))).alias("block")
    )


def split_by_length(messages: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """Messages of ordinary chats, and of long chats (None when there are none).

    Both joins use (chat_id, block), so no key holds more than ``block`` rows.
    """
    blocked = messages.withColumn("block", block_of("pos", block))
    if not has_long_chats(messages, block):
        return blocked, None
    longs = long_blocks(messages, block)
    keys = ["chat_id", "block"]
    return blocked.join(longs, keys, "left_anti"), blocked.join(longs, keys, "left_semi")


def assemble(blocked: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Chat table from the messages of ordinary chats, in one shuffle."""
    kept = ["chat_id", "block", *(extra or [])]
    ordered = F.array_sort(F.collect_list(F.struct("pos", "role", "content")))
    return blocked.groupBy(*kept).agg(ordered.alias("_rows")).select(
        "chat_id",
        *(extra or []),
        F.transform("_rows", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias(
            "messages"
        ),
    )


def chat_table(messages: DataFrame) -> DataFrame:
    """One row per chat, for operators whose result holds the whole chat in a row anyway."""
    return assemble(messages.withColumn("block", F.lit(0)))


def messages_of(chats: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Message table from a chat table."""
    kept = ["chat_id", *(extra or [])]
    return chats.select(*kept, F.posexplode("messages").alias("pos", "m")).select(
        *kept, F.col("pos").cast("long").alias("pos"), "m.role", "m.content"
    )


def pairs_to_chats(pairs: DataFrame, chat_id: str | Column = "chat_id") -> DataFrame:
    """Prompt-completion rows as two-message chats."""
    key = F.col(chat_id) if isinstance(chat_id, str) else chat_id
    return pairs.select(
        key.alias("chat_id"), pair_messages(F.col("prompt"), F.col("completion")).alias("messages")
    )


def with_chat_facts(rows: DataFrame, facts: DataFrame, place: str, long_chats: bool = True) -> DataFrame:
    """Join one-row-per-chat facts to rows that have an integer ``place`` in their chat.

    A long chat's facts are repeated once for each ``SPREAD`` of its places,
    so that its rows spread over as many keys; without long chats the join is
    by chat alone.
    """
    if not long_chats:
        return rows.join(facts, "chat_id")
    part = F.expr(f"`{place}` div {SPREAD}")
    parts = rows.select("chat_id", part.alias("_part")).distinct()
    return rows.withColumn("_part", part).join(parts.join(facts, "chat_id"), ["chat_id", "_part"]).drop("_part")
