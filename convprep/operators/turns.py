"""Turns: the messages up to and including a reply, with their token cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convprep.functions.messages import CHATBOT, SYSTEM, USER, body_of, preamble_of
from convprep.functions.rendering import base_cost, counted_text, message_cost, message_text
from convprep.functions.tokens import WordCounter
from convprep.operators.chats import dense_positions, has_long_chats, with_chat_facts
from convprep.operators.running import WIDTH, running_total
from convprep.profiles import Profile, profile_columns

TURN_FIELDS = "turn, ask, reply, completion, cost"


def array_turns(chats: DataFrame, profile: Profile | Column, counter=None) -> DataFrame:
    """Add ``preamble``, ``base`` and ``turns`` to a chat table.

    Every message is rendered and counted once, whatever number of prompts it
    appears in later.  Messages after the last reply belong to no turn.
    """
    counter = counter or WordCounter()
    p = profile_columns(profile)
    body = chats.withColumn("preamble", preamble_of(F.col("messages"))).withColumn(
        "_body", body_of(F.col("messages"))
    )
    counted = body.withColumn(
        "_words", counter.count_all(F.transform("_body", lambda m: counted_text(p, counter, m)))
    ).withColumn("base", base_cost(p, counter, F.col("preamble")))
    parts = counted.withColumn(
        "_parts",
        F.zip_with(
            "_body",
            "_words",
            lambda m, w: F.struct(
                m["content"].alias("content"),
                message_text(p, m).alias("text"),
                message_cost(p, counter, m, w).alias("cost"),
            ),
        ),
    ).withColumn(
        "_ends",
        F.filter(
            F.transform("_body", lambda m, i: F.when(m["role"] == CHATBOT, i)), lambda i: i.isNotNull()
        ),
    )

    def turn(end: Column, k: Column) -> Column:
        first = F.coalesce(F.get(F.col("_ends"), k - 1) + 1, F.lit(0))
        asks = F.slice("_parts", first + 1, end - first)
        last = F.get(F.col("_parts"), end)
        return F.struct(
            k.cast("long").alias("turn"),
            F.array_join(F.transform(asks, lambda x: x["text"]), "").alias("ask"),
            last["text"].alias("reply"),
            last["content"].alias("completion"),
            (F.aggregate(asks, F.lit(0), lambda a, x: a + x["cost"]) + last["cost"]).alias("cost"),
        )

    return parts.withColumn("turns", F.transform("_ends", turn)).drop("_body", "_words", "_parts", "_ends")


def message_turns(messages: DataFrame, width: int | None = WIDTH) -> DataFrame:
    """Add ``turn`` to a message table: how many replies came before.

    A leading System message is the preamble and gets turn -1.
    """
    marked = messages.withColumn("_reply", (F.col("role") == CHATBOT).cast("long"))
    numbered = running_total(marked, ["chat_id"], "pos", "_reply", "turn", width).drop("_reply")
    lead = (F.col("pos") == 0) & (F.col("role") == SYSTEM)
    return numbered.withColumn("turn", F.when(lead, F.lit(-1).cast("long")).otherwise(F.col("turn")))


def message_digests() -> list[Column]:
    """Four 60-bit numbers that identify a message and its place.

    Their exclusive-or over a chat identifies the chat.  It combines map-side
    in constant space, so neither a long chat nor a large group of copies is
    ever gathered.
    """
    digest = F.sha2(F.concat_ws("\u0001", F.col("pos").cast("string"), F.col("role"), F.col("content")), 256)
    return [
        F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long").alias(f"fp{i}") for i in range(4)
    ]


FINGERPRINT = ["fp0", "fp1", "fp2", "fp3"]

# How each per-turn number is combined further.
_COMBINE = {
    "cost": F.sum,
    "users": F.sum,
    "systems": F.sum,
    "n_messages": F.sum,
    "first_pos": F.min,
    "end_pos": F.max,
    "known": F.bool_and,
    **{name: F.bit_xor for name in FINGERPRINT},
}


def turn_facts(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per turn that decide validity, plus cost and fingerprint where present.

    ``numbered`` has ``chat_id, pos, role, content, turn`` and optionally
    ``cost`` and the digests; ``keys`` may add a block to (chat_id, turn) for a
    first step of partial sums.
    """
    role = F.col("role")
    known = F.coalesce(role.isin(SYSTEM, USER, CHATBOT) & F.col("content").isNotNull(), F.lit(False))
    lead = F.col("turn") < 0
    aggs = [
        F.count_if(role == USER).alias("users"),
        F.count_if((role == SYSTEM) & ~lead).alias("systems"),
        F.count(F.lit(1)).alias("n_messages"),
        F.min("pos").alias("first_pos"),
        F.max(F.when(role == CHATBOT, F.col("pos"))).alias("end_pos"),
        F.bool_and(known).alias("known"),
    ]
    if "cost" in numbered.columns:
        aggs.append(F.sum(F.when(lead, 0).otherwise(F.col("cost"))).alias("cost"))
    aggs += [F.bit_xor(c).alias(c) for c in FINGERPRINT if c in numbered.columns]
    return numbered.groupBy(*keys).agg(*aggs)


def combine_turn_facts(pieces: DataFrame) -> DataFrame:
    aggs = [how(c).alias(c) for c, how in _COMBINE.items() if c in pieces.columns]
    return pieces.groupBy("chat_id", "turn").agg(*aggs)


def chat_validity(facts: DataFrame) -> DataFrame:
    """``chat_id, n_messages, valid, valid_request`` (and the fingerprint) from turn facts.

    A reply must have another message than the opening System message in its
    turn.  A request is a chat in want of a reply: it ends in an open turn that
    one could be given to.
    """
    ended = F.col("end_pos").isNotNull()
    answers = F.col("users") + F.col("systems") > 0
    sound = F.bool_and("known") & F.bool_and(~ended | answers)
    return facts.groupBy("chat_id").agg(
        F.sum("n_messages").alias("n_messages"),
        (sound & (F.count("end_pos") > 0)).alias("valid"),
        (sound & (F.count_if((F.col("turn") >= 0) & ~ended & answers) > 0)).alias("valid_request"),
        *[F.bit_xor(c).alias(c) for c in FINGERPRINT if c in facts.columns],
    )


def message_costs(messages: DataFrame, profile: Profile, counter=None) -> DataFrame:
    """Add ``cost`` to a message table."""
    counter = counter or WordCounter()
    p = profile_columns(profile)
    row = {"role": F.col("role"), "content": F.col("content")}
    counted = counter.count(counted_text(p, counter, row))
    return messages.withColumn("cost", message_cost(p, counter, row, counted).cast("long"))


def preamble_rows(messages: DataFrame) -> DataFrame:
    """The first message of each chat; its text where it is the preamble, else empty."""
    return messages.filter(F.col("pos") == 0).withColumn(
        "preamble", F.when(F.col("role") == SYSTEM, F.col("content")).otherwise("")
    )


def turn_verdicts(messages: DataFrame, profile: Profile, budget: int, counter=None) -> DataFrame:
    """``chat_id, turn, cost, reason`` of every turn of a message table.

    ``reason`` is NULL for a turn that makes a sample, else why it does not:
    ``empty_turn`` or ``over_budget``.
    """
    counter = counter or WordCounter()
    messages = dense_positions(messages)
    long_chats = has_long_chats(messages, WIDTH)
    width = WIDTH if long_chats else None
    numbered = message_turns(message_costs(messages, profile, counter), width)
    facts = turn_facts(numbered, ["chat_id", "turn"])
    turns = facts.filter((F.col("turn") >= 0) & F.col("end_pos").isNotNull())
    base = base_cost(profile_columns(profile), counter, F.col("preamble"))
    bases = preamble_rows(messages).select("chat_id", base.alias("_base"))
    reason = F.when(F.col("cost") == 0, "empty_turn").when(F.col("_base") + F.col("cost") > budget, "over_budget")
    return with_chat_facts(turns, bases, "turn", long_chats).select("chat_id", "turn", "cost", reason.alias("reason"))
