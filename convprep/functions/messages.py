"""Expressions over ``messages ARRAY<STRUCT<role STRING, content STRING>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGES_DDL = "array<struct<role:string,content:string>>"

SYSTEM, USER, CHATBOT = "System", "User", "Chatbot"


def message(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def no_messages() -> Column:
    return F.array().cast(MESSAGES_DDL)


def normalize_role(role: Column) -> Column:
    """Canonical role name for any letter case; unknown roles pass unchanged."""
    low = F.lower(role)
    return (
        F.when(low == "system", SYSTEM)
        .when(low == "user", USER)
        .when(low.isin("assistant", "chatbot"), CHATBOT)
        .otherwise(role)
    )


def normalize_messages(messages: Column, text_field: str = "content") -> Column:
    """Canonical roles; ``text_field="message"`` also renames the text field."""
    return F.transform(
        messages,
        lambda m: F.struct(
            normalize_role(m["role"]).alias("role"), m["content"].alias(text_field)
        ),
    )


def pair_messages(prompt: Column, completion: Column) -> Column:
    """A prompt-completion pair as a two-message chat without preamble."""
    return F.array(message(USER, prompt), message(CHATBOT, completion))


def has_preamble(messages: Column) -> Column:
    return F.coalesce(F.get(messages, F.lit(0))["role"] == SYSTEM, F.lit(False))


def preamble_of(messages: Column) -> Column:
    """Text of a leading System message, or the empty string."""
    return F.when(has_preamble(messages), F.get(messages, F.lit(0))["content"]).otherwise("")


def body_of(messages: Column) -> Column:
    """The messages after a leading System message."""
    return F.slice(
        messages, F.when(has_preamble(messages), 2).otherwise(1), F.greatest(F.size(messages), F.lit(0))
    )


def fingerprint(messages: Column) -> Column:
    """Key-order-free identity of a chat; the struct type fixes the key order."""
    return F.sha2(F.to_json(F.struct(messages.alias("messages"))), 256)
