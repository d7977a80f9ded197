"""From conversations to training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convprep.operators.chats import BLOCK, assemble, dense_positions, has_long_chats, split_by_length
from convprep.operators.dedupe import chat_facts, first_chats
from convprep.operators.long_chats import long_samples
from convprep.operators.report import require_rows
from convprep.operators.running import block_of
from convprep.operators.samples import EXACT, chat_samples
from convprep.operators.split import EVAL, TRAIN, split_exact
from convprep.plans.session import stored
from convprep.profiles import SECTIONED, Profile


def training_samples(
    messages: DataFrame,
    profile: Profile = SECTIONED,
    budget: int | None = None,
    mode: str = EXACT,
    counter=None,
    extra: list[str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Samples of every valid chat of a message table.

    Ordinary chats are gathered into rows by one shuffle and never shuffled
    again; chats longer than ``block`` messages, if any, go the segmented way.
    """
    budget = budget if budget is not None else profile.max_length
    messages = dense_positions(messages)
    ordinary, long = split_by_length(messages, block)
    samples = chat_samples(assemble(ordinary, extra), profile, budget, mode, counter, extra)
    if long is None:
        return samples
    return samples.unionByName(long_samples(long, profile, budget, mode, counter, extra, block))


def select_messages(messages: DataFrame, kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """Messages of the kept chats with their ``split`` and ``block``.

    A kept chat becomes one row per block of its messages, so the join has no
    hot key and leaves the text placed for the assembly that follows.
    """
    last = F.expr(f"(n_messages - 1) div {block}")
    wanted = kept.select("chat_id", "split", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    return messages.withColumn("block", block_of("pos", block)).join(wanted, ["chat_id", "block"])


def training_set(
    messages: DataFrame,
    eval_fraction: float | None = 0.2,
    profile: Profile = SECTIONED,
    budget: int | None = None,
    mode: str = EXACT,
    counter=None,
    seed: int = 42,
    block: int = BLOCK,
) -> DataFrame:
    """Validated, deduplicated, split and rendered samples of a message table.

    Facts first, text later: which chats to keep is settled on a narrow stored
    table, which the split reads several times; then the text is shuffled once.
    Without a valid chat there is nothing to train on, which is an error.
    """
    budget = budget if budget is not None else profile.max_length
    messages = dense_positions(messages)
    any_long = has_long_chats(messages, block)
    facts = stored(first_chats(chat_facts(messages, any_long)), "chats")
    require_rows(facts, "no chat can be trained on")
    kept = facts.withColumn("split", F.lit(TRAIN))
    if eval_fraction is not None:
        kept = split_exact(facts, eval_fraction, seed=seed)
    ordinary = select_messages(messages, kept.filter(F.col("n_messages") <= block), block)
    samples = chat_samples(
        assemble(ordinary, ["split"]), profile, budget, mode, counter, ["split"], validate=False
    )
    if not any_long:
        return samples
    long = select_messages(messages, kept.filter(F.col("n_messages") > block), block)
    return samples.unionByName(long_samples(long, profile, budget, mode, counter, ["split"], block))


def training_sets(train: DataFrame, evaluation: DataFrame, **options) -> DataFrame:
    """Samples of a train and a separate evaluation table, each deduplicated alone.

    The two sides are not compared, so chats present in both stay in both.
    """
    return training_set(train, None, **options).unionByName(
        training_set(evaluation, None, **options).withColumn("split", F.lit(EVAL))
    )
