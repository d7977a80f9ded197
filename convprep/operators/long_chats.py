"""Samples of chats too long for one row.

A long chat is cut by tokens, not by messages: the context of a turn spans at
most ``window`` tokens, so with segments of that many tokens each sample needs
its own segment and the one before, nothing else.  Every group and join key
below is bounded by a block of messages, one turn that fits the budget, or two
segments.  Only numbers go through the running totals; text is moved once the
place of each kept turn is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convprep.functions.messages import CHATBOT
from convprep.functions.rendering import base_cost, message_text
from convprep.functions.tokens import WordCounter
from convprep.operators.carried_starts import carried_starts
from convprep.operators.chats import BLOCK, with_chat_facts
from convprep.operators.running import running_total
from convprep.operators.samples import EXACT, segment_samples
from convprep.operators.turns import (
    chat_validity,
    combine_turn_facts,
    message_costs,
    message_turns,
    preamble_rows,
    turn_facts,
)
from convprep.plans.session import stored
from convprep.profiles import Profile, profile_columns

def context_window(budget: int, profile: Profile, mode: str, base_tokens: int) -> int:
    """Upper bound on the tokens of any context.

    The stateful rule may end over the budget by ``D``.  Dropping ``m`` turns
    credits ``m * B`` tokens too many and stops as soon as enough is credited,
    so ``(m - 1) * (least + B) < D + budget`` where ``least`` is the smallest
    turn, and ``D <= m * B``.
    """
    if mode == EXACT:
        return budget
    b, least = base_tokens, max(profile.frame_tokens, 1)
    return budget + -(-b * (least + b + budget) // least)


def long_samples(
    blocked: DataFrame,
    profile: Profile,
    budget: int,
    mode: str = EXACT,
    counter=None,
    extra: list[str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Samples of long chats, given as messages with their ``block``.

    ``extra`` names chat-level columns of ``blocked`` to carry along.
    """
    counter, extra = counter or WordCounter(), extra or []
    empty = empty_base(blocked, profile, counter)
    window = context_window(budget, profile, mode, empty)
    numbered, pieces = numbered_turns(blocked, profile, counter, block)
    facts = combine_turn_facts(pieces)
    heads = chat_heads(facts, blocked, profile, counter, extra)
    kept = kept_turns(facts, heads, budget, window, block)
    placed = kept.select("chat_id", "turn", "rank", "segment", F.col("cost").alias("turn_cost"))
    turns = turn_texts(numbered, pieces, placed, profile).select(
        "chat_id",
        "segment",
        "rank",
        F.struct("turn", "ask", "reply", "completion", F.col("turn_cost").cast("int").alias("cost")).alias("_turn"),
    )
    segments = with_carried(turn_segments(turns), kept, budget, empty, mode)
    full = with_chat_facts(segments, heads, "_into")
    return segment_samples(full, profile, budget, mode, counter, extra)


def empty_base(messages: DataFrame, profile: Profile, counter) -> int:
    """Tokens of a prompt without preamble and turns."""
    base = base_cost(profile_columns(profile), counter, F.lit(""))
    return messages.sparkSession.range(1).select(base).first()[0]


def numbered_turns(blocked: DataFrame, profile: Profile, counter, block: int) -> tuple[DataFrame, DataFrame]:
    """Messages with their turn and cost, and the stored facts of each part of a turn that lies in a block."""
    numbered = message_turns(message_costs(blocked, profile, counter), block)
    return numbered, stored(turn_facts(numbered, ["chat_id", "turn", "block"]), "turn-facts")


def chat_heads(facts: DataFrame, messages: DataFrame, profile: Profile, counter, extra: list[str]) -> DataFrame:
    """``chat_id, preamble, base`` of the valid chats."""
    firsts = preamble_rows(messages).select("chat_id", *extra, "preamble")
    base = base_cost(profile_columns(profile), counter, F.col("preamble"))
    valid = chat_validity(facts).filter("valid")
    return valid.join(firsts, "chat_id").select("chat_id", *extra, "preamble", base.alias("base"))


def kept_turns(facts: DataFrame, heads: DataFrame, budget: int, window: int, block: int) -> DataFrame:
    """The turns that make a sample, with the tokens and turns before them and their segment; a stored table of numbers."""
    ended = facts.filter(F.col("end_pos").isNotNull() & (F.col("cost") > 0))
    kept = with_chat_facts(ended.select("chat_id", "turn", "cost"), heads.select("chat_id", "base"), "turn")
    kept = kept.filter(F.col("base") + F.col("cost") <= budget).withColumn("_one", F.lit(1).cast("long"))
    kept = stored(kept, "fitting-turns")
    kept = running_total(kept, ["chat_id"], "turn", "cost", "pre", block)
    kept = running_total(kept, ["chat_id"], "turn", "_one", "rank", block)
    kept = kept.withColumn("segment", F.expr(f"(pre + cost - 1) div {window}")).drop("_one")
    # Each running total reads its rows twice, and the callers read these several times.
    return stored(kept, "kept-turns")


def turn_texts(numbered: DataFrame, pieces: DataFrame, placed: DataFrame, profile: Profile) -> DataFrame:
    """The columns of ``placed``, turns by ``chat_id, turn``, with their texts ``ask, reply, completion``."""
    p = profile_columns(profile)
    routes = pieces.select("chat_id", "turn", "block").join(placed, ["chat_id", "turn"])
    reply = F.col("role") == CHATBOT
    shown = numbered.filter((F.col("content") != "") | reply).join(routes, ["chat_id", "turn", "block"])
    row = {"role": F.col("role"), "content": F.col("content")}
    texts = F.array_sort(
        F.collect_list(
            F.struct("pos", message_text(p, row).alias("text"), F.when(reply, F.col("content")).alias("content"))
        )
    )
    last = F.element_at("_texts", -1)
    return (
        shown.groupBy(*placed.columns)
        .agg(texts.alias("_texts"))
        .select(
            *placed.columns,
            F.array_join(F.transform(F.slice("_texts", 1, F.size("_texts") - 1), lambda x: x["text"]), "").alias("ask"),
            last["text"].alias("reply"),
            last["content"].alias("completion"),
        )
    )


def turn_segments(turns: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``_turn`` structs gathered by segment, each with the turns of the segment before as context.

    ``extra`` names chat-level columns of ``turns`` to carry along.
    """
    copies = turns.withColumn("_into", F.explode(F.array(F.col("segment"), F.col("segment") + 1)))
    own = F.col("segment") == F.col("_into")
    return (
        copies.groupBy("chat_id", "_into", *(extra or []))
        .agg(
            F.array_sort(F.collect_list("_turn")).alias("turns"),
            F.count_if(~own).cast("int").alias("own_from"),
            F.count_if(own).alias("_own"),
            F.min("rank").alias("_first"),
        )
        .filter(F.col("_own") > 0)
    )


def with_carried(segments: DataFrame, kept: DataFrame, budget: int, empty: int, mode: str) -> DataFrame:
    """Add ``carried``, the start that the stateful rule carries into each segment."""
    if mode == EXACT:
        return segments.withColumn("carried", F.lit(0))
    entries = carried_starts(kept, budget, empty).withColumnRenamed("segment", "_into")
    return segments.join(entries, ["chat_id", "_into"]).withColumn(
        "carried", (F.col("entry") - F.col("_first")).cast("int")
    )
