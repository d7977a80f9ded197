"""Where the context of a long chat stands when a segment begins.

Under the stateful rule the start of a context depends on the one before, back
to the first turn.  To follow it through a long chat in parallel, each segment
is first turned into a step function from the start carried in to the start
carried out; step functions of consecutive segments are composed in groups, the
compositions in groups again, and the actual starts are then handed down.  Only
chats of several segments go this way.  No group is larger than three segments of turns or ``FANOUT`` functions (the last
step: one row per ``FANOUT`` squared segments of a chat), and only numbers are
moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convprep.operators.chats import with_chat_facts
from convprep.plans.session import stored

FANOUT = 256
#: Turns that meet in one call of a Python function, on average.
GATHERED = 4096

_FUNCTION = ["chat_id", "segment", "entries", "exits"]


def _steps(entries: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keep the first entry of each run of equal exits."""
    new = np.r_[True, exits[1:] != exits[:-1]]
    return entries[new], exits[new]


def _apply(entries: np.ndarray, exits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.asarray(exits)[np.searchsorted(entries, at, side="right") - 1]


def _runs(rows: pd.DataFrame, keys: list[str], order: str) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each key, in order, as arrays."""
    rows = rows.sort_values([*keys, order])
    begins = np.flatnonzero((rows[keys] != rows[keys].shift()).any(axis=1).to_numpy())
    columns = {name: rows[name].to_numpy() for name in rows.columns}
    for low, high in zip(begins, [*begins[1:], len(rows)]):
        yield {name: values[low:high] for name, values in columns.items()}


def _segment_functions(budget: int, credit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def step_function(rows: dict[str, np.ndarray]) -> tuple | None:
        own = rows["segment"] == rows["into"]
        if not own.any():
            return None
        first = int(rows["rank"][0])
        place = np.arange(len(own))
        credited = rows["pre"] + credit * place
        needed = rows["base"] + rows["pre"] + rows["cost"] - budget
        state = place[: max(int((~own).sum()), 1)]
        entries = state
        label = np.arange(len(state))
        for k in place[own]:
            # A start moves to the first turn whose cost and credit cover the excess.
            state = np.maximum(state, np.searchsorted(credited, needed[k] + credit * state))
            state, merged = np.unique(state, return_inverse=True)
            label = merged[label]
        entries, exits = _steps(entries, state[label])
        return rows["chat_id"][0], rows["into"][0], entries + first, exits + first

    def step_functions(rows: pd.DataFrame) -> pd.DataFrame:
        made = [step_function(run) for run in _runs(rows, ["chat_id", "into"], "rank")]
        return pd.DataFrame([m for m in made if m is not None], columns=_FUNCTION)

    return step_functions


def _compose(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for run in _runs(rows, ["chat_id", "part"], "segment"):
        entries, exits = run["entries"][0], run["exits"][0]
        for e, x in zip(run["entries"][1:], run["exits"][1:]):
            entries, exits = _steps(entries, _apply(e, x, exits))
        out.append((run["chat_id"][0], run["part"][0], entries, exits))
    return pd.DataFrame(out, columns=_FUNCTION)


def _hand_down(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for run in _runs(rows, ["chat_id", "part"], "segment"):
        at = int(run["entry"][0])
        for chat_id, segment, e, x in zip(run["chat_id"], run["segment"], run["entries"], run["exits"]):
            out.append((chat_id, segment, at))
            at = int(_apply(e, x, np.asarray([at]))[0])
    return pd.DataFrame(out, columns=["chat_id", "segment", "entry"])


def carried_starts(kept: DataFrame, budget: int, credit: int, fanout: int = FANOUT) -> DataFrame:
    """``chat_id, segment, entry``: rank of the start carried into each segment.

    ``kept`` has ``chat_id, base, rank, pre, cost, segment`` for each kept turn.
    A start carried in lies in one of the two segments before.
    """
    chats = kept.groupBy("chat_id").agg(F.max("segment").alias("_last"))
    # A chat of one segment carries nothing; most are.
    alone = chats.filter("_last = 0").select(
        "chat_id", F.lit(0).cast("long").alias("segment"), F.lit(0).cast("long").alias("entry")
    )
    several = stored(
        with_chat_facts(kept, chats.filter("_last > 0").select("chat_id"), "rank").select(
            "chat_id", "base", "rank", "pre", "cost", "segment"
        ),
        "several",
    )
    n = several.count()
    if n == 0:
        return alone
    buckets = n // GATHERED + 1
    key = f"chat_id {kept.schema['chat_id'].dataType.simpleString()}"
    function = f"{key}, segment bigint, entries array<bigint>, exits array<bigint>"
    placed = f"{key}, segment bigint, entry bigint"
    into = F.explode(F.array(*[F.col("segment") + i for i in range(3)]))
    copies = several.withColumn("into", into)
    # A call for each group would cost more than its work, so groups are dealt out to buckets of about equal size.
    together = lambda rows, by: rows.groupBy(
        F.pmod(F.xxhash64("chat_id", by), F.lit(buckets)).alias("bucket")
    )
    in_parts = lambda rows: rows.withColumn("part", F.expr(f"segment div {fanout}"))
    composed = lambda rows: in_parts(together(rows, "part").applyInPandas(_compose, function))
    steps = stored(in_parts(together(copies, "into").applyInPandas(_segment_functions(budget, credit), function)), "steps")
    parts = stored(composed(steps), "parts")
    whole = composed(parts).withColumn("entry", F.lit(0).cast("long")).withColumn("part", F.lit(0).cast("long"))
    begun = together(whole, "part").applyInPandas(_hand_down, placed)
    for level in (parts, steps):
        entered = level.join(begun.withColumnRenamed("segment", "part"), ["chat_id", "part"])
        begun = together(entered, "part").applyInPandas(_hand_down, placed)
    return alone.unionByName(begun)
