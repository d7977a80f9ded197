"""Which chats can be trained on, and which can be sent for a reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convprep.functions.messages import CHATBOT, SYSTEM, USER, message


def is_valid_training(messages: Column) -> Column:
    """True when every reply answers something in its own turn and there is a reply.

    A reply needs a User message in its turn, or a System message that is not
    just the opening one.  The fold carries the per-turn counts.
    """
    start = F.struct(
        F.lit(0).alias("i"),
        F.lit(0).alias("systems"),
        F.lit(0).alias("users"),
        F.lit(0).alias("replies"),
        F.lit(True).alias("ok"),
    )

    def step(a: Column, m: Column) -> Column:
        role = m["role"]
        is_reply = role == CHATBOT
        answered = (a["users"] > 0) | ((a["systems"] > 0) & (a["i"] > 1))
        known = F.coalesce(role.isin(SYSTEM, USER, CHATBOT), F.lit(False))
        return F.struct(
            (a["i"] + 1).alias("i"),
            F.when(is_reply, 0).when(role == SYSTEM, a["systems"] + 1).otherwise(a["systems"]).alias("systems"),
            F.when(is_reply, 0).when(role == USER, a["users"] + 1).otherwise(a["users"]).alias("users"),
            F.when(is_reply, a["replies"] + 1).otherwise(a["replies"]).alias("replies"),
            (a["ok"] & known & m["content"].isNotNull() & (~is_reply | answered)).alias("ok"),
        )

    folded = F.aggregate(messages, start, step, lambda a: a["ok"] & (a["replies"] > 0))
    return F.coalesce(folded, F.lit(False))


def is_valid_inference(messages: Column) -> Column:
    """True when appending an empty reply would make a valid training chat."""
    return is_valid_training(F.concat(messages, F.array(message(CHATBOT, F.lit("")))))
