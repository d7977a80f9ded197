"""One (prompt, completion) row per turn that fits the token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convprep.functions.messages import MESSAGES_DDL
from convprep.functions.rendering import base_cost, open_prompt, strip_begin, tail_text
from convprep.functions.tokens import WordCounter
from convprep.functions.validity import is_valid_training
from convprep.operators.turns import array_turns
from convprep.profiles import BEGIN, Profile, profile_columns

SAMPLE_COLUMNS = ["chat_id", "turn", "first_turn", "n_tokens", "prompt", "completion"]

EXACT, REFERENCE = "exact", "reference"


def fits(turn: Column, base: Column, budget: int) -> Column:
    """Turns without text and turns too long on their own make no sample."""
    return (turn["cost"] > 0) & (base + turn["cost"] <= budget)


def rejected_turns(turned: DataFrame, budget: int) -> DataFrame:
    """Quarantine: the turns that make no sample, each with its reason."""
    bad = F.filter("turns", lambda t: ~fits(t, F.col("base"), budget))
    return turned.select("chat_id", F.explode(bad).alias("t")).select(
        "chat_id",
        F.col("t.turn").alias("turn"),
        F.col("t.cost").alias("cost"),
        F.when(F.col("t.cost") == 0, "empty_turn").otherwise("over_budget").alias("reason"),
    )


#: Turns that are folded together; folds over arrays copy what they have, so longer ones go in two levels.
FOLDED = 64


def local_sums(costs: Column) -> Column:
    """Prefix sums of every ``FOLDED`` costs, each beginning at 0."""
    parts = F.sequence(F.lit(0), F.greatest(F.size(costs) - 1, F.lit(0)).bitwiseAND(F.lit(-FOLDED)), F.lit(FOLDED))
    return F.transform(
        parts,
        lambda at: F.aggregate(
            F.slice(costs, at + 1, F.lit(FOLDED)),
            F.array(F.lit(0)),
            lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c)),
        ),
    )


def prefix_sums(local: Column) -> Column:
    """0 and the sums of the first 1, 2, ... costs, from their ``local_sums``; linear in the turns but for few copies."""
    before = F.aggregate(
        local, F.array(F.lit(0)), lambda a, part: F.concat(a, F.array(F.element_at(a, -1) + F.element_at(part, -1)))
    )
    whole = F.zip_with(
        local,
        F.slice(before, F.lit(1), F.size(local)),
        lambda part, at: F.transform(F.slice(part, F.lit(2), F.size(part)), lambda v: v + at),
    )
    return F.concat(F.array(F.lit(0)), F.flatten(whole))


def start_pointers(
    pre: Column, base: Column, budget: int, credit: Column, own_from: Column, carried: Column
) -> Column:
    """For each turn from ``own_from`` on, the first turn of its context.

    ``pre`` are prefix sums of the turn costs.  The start never moves back, so
    one fold carries it, beginning at ``carried`` (negative when that turn lies
    before the segment), and finds the next by halving, as the sums rise.
    ``credit`` is what the stateful rule counts off per dropped turn on top of
    its cost; 0 gives contexts that never exceed the budget.
    """
    n = F.size(pre) - 1
    halvings = F.sequence(F.lit(1), F.ceil(F.log2(n + 2)).cast("int"))

    def halved(span: Column, wanted: Column) -> Column:
        middle = F.shiftright(span["low"] + span["high"], 1)
        enough = F.get(pre, middle) + middle * credit >= wanted
        return F.struct(
            F.when(enough, span["low"]).otherwise(F.least(middle + 1, span["high"])).alias("low"),
            F.when(enough, middle).otherwise(span["high"]).alias("high"),
        )

    def next_start(starts: Column, k: Column) -> Column:
        held = F.element_at(starts, -1)
        wanted = base + F.get(pre, k + 1) + held * credit - budget
        span = F.struct(F.greatest(held, F.lit(0)).alias("low"), k.alias("high"))
        found = F.aggregate(halvings, span, lambda s, _: halved(s, wanted), lambda s: s["low"])
        return F.concat(starts, F.array(found))

    def next_part(parts: Column, first: Column) -> Column:
        own = F.sequence(first, F.least(first + (FOLDED - 1), n - 1))
        last = F.slice(F.element_at(parts, -1), -1, 1)
        return F.concat(parts, F.array(F.aggregate(own, last, next_start)))

    parts = F.aggregate(F.sequence(own_from, n - 1, F.lit(FOLDED)), F.array(F.array(carried)), next_part)
    # Each part begins with the start that it was carried.
    starts = F.transform(F.slice(parts, F.lit(2), F.size(pre)), lambda p: F.slice(p, F.lit(2), F.size(p)))
    return F.when(n > own_from, F.flatten(starts)).otherwise(F.array().cast("array<int>"))


def segment_samples(
    segments: DataFrame,
    profile: Profile | Column,
    budget: int,
    mode: str = EXACT,
    counter=None,
    extra: list[str] | None = None,
) -> DataFrame:
    """Samples of turn segments; a narrow step.

    A segment is ``chat_id, preamble, base, turns, own_from, carried``: the
    kept turns of a chat in order, of which those before ``own_from`` only
    serve as context, and the start carried into the first own turn.
    """
    counter = counter or WordCounter()
    p = profile_columns(profile)
    base = F.col("base")
    credit = F.lit(0) if mode == EXACT else base_cost(p, counter, F.lit(""))
    # Each column below is used at least twice above it, so Catalyst keeps the
    # projections apart instead of inlining them into the lambdas.
    folded = (
        segments.withColumn("_costs", F.transform("turns", lambda t: t["cost"].cast("int")))
        .withColumn("_local", local_sums(F.col("_costs")))
        .withColumn("_pre", prefix_sums(F.col("_local")))
        .withColumn("_credit", credit)
        .withColumn(
            "_starts",
            start_pointers(F.col("_pre"), base, budget, F.col("_credit"), F.col("own_from"), F.col("carried")),
        )
        .withColumn("_open", open_prompt(p, F.col("preamble")))
    )
    turns, starts = F.col("turns"), F.col("_starts")

    def sample(k: Column) -> Column:
        own, s = F.get(turns, k), F.get(starts, k - F.col("own_from"))
        context = F.transform(F.slice(turns, s + 1, k - s), lambda t: F.concat(t["ask"], t["reply"]))
        prompt = F.concat(F.col("_open"), F.array_join(context, ""), own["ask"], tail_text(p))
        return F.struct(
            own["turn"].alias("turn"),
            F.get(turns, s)["turn"].alias("first_turn"),
            (base + F.get(F.col("_pre"), k + 1) - F.get(F.col("_pre"), s)).cast("long").alias("n_tokens"),
            prompt.alias("prompt"),
            own["completion"].alias("completion"),
        )

    last = F.size("turns") - 1
    rows = F.when(
        last >= F.col("own_from"), F.transform(F.sequence(F.col("own_from"), last), sample)
    )
    out = folded.select("chat_id", *(extra or []), F.inline_outer(rows)).filter(F.col("turn").isNotNull())
    return out.withColumn("prompt", strip_begin(F.col("prompt"), BEGIN))


def chat_samples(
    chats: DataFrame,
    profile: Profile | Column,
    budget: int,
    mode: str = EXACT,
    counter=None,
    extra: list[str] | None = None,
    validate: bool = True,
) -> DataFrame:
    """Samples of a chat table; no shuffle.  Invalid chats are left out by default."""
    rows = chats.filter(is_valid_training(F.col("messages").cast(MESSAGES_DDL))) if validate else chats
    turned = array_turns(rows, profile, counter)
    kept = turned.select(
        "chat_id",
        *(extra or []),
        "preamble",
        "base",
        F.filter("turns", lambda t: fits(t, F.col("base"), budget)).alias("turns"),
        F.lit(0).alias("own_from"),
        F.lit(0).alias("carried"),
    )
    return segment_samples(kept, profile, budget, mode, counter, extra)
