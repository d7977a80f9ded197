"""Train and evaluation splits of exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from convprep.operators.running import rank_cutoff
from convprep.plans.session import stored

TRAIN, EVAL = "train", "eval"


def score_of(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _both_sides(k: Column) -> Column:
    message = "There must be at least one row on each side of the split"
    return F.when((k < 1) | (k >= F.col("n")), F.raise_error(F.lit(message)).cast("long")).otherwise(k)


def split_exact(chats: DataFrame, eval_fraction: float, key: str = "chat_id", seed: int = 42) -> DataFrame:
    """Add ``split``: exactly ``floor(n * eval_fraction)`` rows are ``eval``.

    ``key`` is unique.  The rows with the smallest hashed keys are taken; the
    cut-off comes from counts per hash prefix, and the rows themselves are only
    compared with it, without a shuffle.
    """
    score = score_of(F.col(key), seed)
    size = _both_sides(F.floor(F.col("n") * F.lit(float(eval_fraction))))
    order = F.concat(score, F.lit(":"), F.col(key).cast("string"))
    cutoff = rank_cutoff(chats, [F.substring(score, 1, 4)], order, size)
    return chats.withColumn("split", F.when(order <= cutoff.scalar(), EVAL).otherwise(TRAIN))


#: Relative error of the quantile sketch is one over this.
ACCURACY = 10_000


def split_ordered(rows: DataFrame, train_ratio: float, order: str) -> DataFrame:
    """Add ``split``: the first ``floor(n * train_ratio)`` rows are ``train``, the rest ``eval``.

    ``order`` is a unique integer column of any distribution.  Two scans of it
    give the cut-off: a quantile sketch brackets it, then the rows below the
    bracket are counted while the few inside it are written; their ranks are
    exact.  Should the sketch miss, all rows are ranked.
    """
    value = F.col(order).cast("long")
    size = _both_sides(F.floor(F.col("n") * F.lit(float(train_ratio))))
    margin = 4 / ACCURACY
    shares = [max(train_ratio - margin, 0.0), min(train_ratio + margin, 1.0)]
    sketch = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, shares, ACCURACY).alias("q"))
    found = sketch.select(size.alias("k"), "q").first()
    low, high = found["q"]
    below = Observation()
    counted = rows.select(value.alias("_value")).observe(below, F.count_if(F.col("_value") < low).alias("n"))
    inside = stored(counted.filter(F.col("_value").between(low, high)), "bracket")
    rank = found["k"] - below.get["n"]
    value_inside = F.col("_value")
    if 1 <= rank <= inside.count():
        cutoff = rank_cutoff(inside, _digits(value_inside), value_inside, F.lit(rank))
    else:
        cutoff = rank_cutoff(rows, _digits(value), value, size)
    return rows.withColumn("split", F.when(value <= cutoff.scalar(), TRAIN).otherwise(EVAL))


def _digits(value: Column) -> list[Column]:
    """The four 16-bit parts of a long."""
    lower = [F.shiftright(value, bits).bitwiseAND(F.lit(65535)) for bits in (32, 16, 0)]
    return [F.shiftright(value, 48), *lower]
