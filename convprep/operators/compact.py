"""Samples as intervals of turns, and their texts only when they are written.

The prompts of a chat repeat its turns, so their text grows with the square of
a long chat; as intervals the samples of a chat take one row for each turn.
Everything up to there works on numbers.  To render them, the turns of a chat
are gathered by segment, with those of the segment before, and meet the
intervals of their segment; prompts are put together there and not moved again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convprep.functions.rendering import open_prompt, strip_begin, tail_text
from convprep.functions.tokens import WordCounter
from convprep.operators.chats import BLOCK, dense_positions, with_chat_facts
from convprep.operators.long_chats import (
    chat_heads,
    context_window,
    empty_base,
    kept_turns,
    numbered_turns,
    turn_segments,
    turn_texts,
    with_carried,
)
from convprep.operators.running import block_of
from convprep.operators.samples import EXACT, SAMPLE_COLUMNS, local_sums, prefix_sums, start_pointers
from convprep.operators.turns import combine_turn_facts, preamble_rows
from convprep.profiles import BEGIN, Profile, profile_columns

#: A sample of turn ``turn``, whose context begins at ``first_turn``; ranks count the turns that make samples.
COMPACT_COLUMNS = ["chat_id", "turn", "first_turn", "n_tokens", "rank", "first_rank", "segment"]


def compact_samples(
    messages: DataFrame, profile: Profile, budget: int, mode: str = EXACT, counter=None, block: int = BLOCK
) -> DataFrame:
    """The samples of every valid chat of a message table, without texts; one row for each turn that fits."""
    counter = counter or WordCounter()
    blocked = dense_positions(messages).withColumn("block", block_of("pos", block))
    empty = empty_base(blocked, profile, counter)
    facts = combine_turn_facts(numbered_turns(blocked, profile, counter, block)[1])
    heads = chat_heads(facts, blocked, profile, counter, [])
    kept = kept_turns(facts, heads, budget, context_window(budget, profile, mode, empty), block)
    turn = F.struct("rank", "turn", F.col("cost").cast("int").alias("cost"))
    turns = kept.select("chat_id", "base", "segment", "rank", turn.alias("_turn"))
    # Nothing is carried where every chat is one segment.
    carried = EXACT if mode == EXACT or kept.filter("segment > 0").isEmpty() else mode
    full = with_carried(turn_segments(turns, ["base"]), kept, budget, empty, carried)
    credit = F.lit(0) if mode == EXACT else F.lit(empty)
    # Separate projections, as in the rendering of whole segments.
    folded = (
        full.withColumn("_costs", F.transform("turns", lambda t: t["cost"]))
        .withColumn("_local", local_sums(F.col("_costs")))
        .withColumn("_pre", prefix_sums(F.col("_local")))
        .withColumn(
            "_starts",
            start_pointers(F.col("_pre"), F.col("base"), budget, credit, F.col("own_from"), F.col("carried")),
        )
    )

    def interval(start: Column, i: Column) -> Column:
        k = i + F.col("own_from")
        own, first = F.get(F.col("turns"), k), F.get(F.col("turns"), start)
        size = F.col("base") + F.get(F.col("_pre"), k + 1) - F.get(F.col("_pre"), start)
        return F.struct(
            own["turn"].alias("turn"),
            first["turn"].alias("first_turn"),
            size.cast("long").alias("n_tokens"),
            own["rank"].alias("rank"),
            first["rank"].alias("first_rank"),
        )

    rows = folded.select("chat_id", F.col("_into").alias("segment"), F.inline(F.transform("_starts", interval)))
    return rows.select(*COMPACT_COLUMNS)


def rendered(
    messages: DataFrame, samples: DataFrame, profile: Profile, counter=None, block: int = BLOCK
) -> DataFrame:
    """The samples with ``prompt`` and ``completion``, from a stored table of compact ones."""
    counter, p = counter or WordCounter(), profile_columns(profile)
    blocked = dense_positions(messages).withColumn("block", block_of("pos", block))
    numbered, pieces = numbered_turns(blocked, profile, counter, block)
    placed = samples.select("chat_id", "turn", "rank", "segment")
    texts = turn_texts(numbered, pieces, placed, profile)
    turns = texts.select("chat_id", "segment", "rank", F.struct("rank", "turn", "ask", "reply", "completion").alias("_turn"))
    interval = F.struct("turn", "first_turn", "n_tokens", "rank", "first_rank")
    wanted = samples.groupBy("chat_id", F.col("segment").alias("_into")).agg(F.collect_list(interval).alias("_wanted"))
    gathered = turn_segments(turns).join(wanted, ["chat_id", "_into"])
    preambles = preamble_rows(blocked).select("chat_id", "preamble")
    open_text = open_prompt(p, F.col("preamble"))
    full = with_chat_facts(gathered, preambles, "_into").withColumn("_open", open_text)

    def sample(w: Column) -> Column:
        at = lambda rank: (rank - F.col("_first")).cast("int")
        own = F.get(F.col("turns"), at(w["rank"]))
        context = F.slice("turns", at(w["first_rank"]) + 1, (w["rank"] - w["first_rank"]).cast("int"))
        before = F.array_join(F.transform(context, lambda t: F.concat(t["ask"], t["reply"])), "")
        prompt = F.concat(F.col("_open"), before, own["ask"], tail_text(p))
        return F.struct(
            w["turn"].alias("turn"),
            w["first_turn"].alias("first_turn"),
            w["n_tokens"].alias("n_tokens"),
            prompt.alias("prompt"),
            own["completion"].alias("completion"),
        )

    rows = full.select("chat_id", F.inline(F.transform("_wanted", sample)))
    return rows.withColumn("prompt", strip_begin(F.col("prompt"), BEGIN)).select(*SAMPLE_COLUMNS)
