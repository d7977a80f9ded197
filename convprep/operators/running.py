"""Running totals and rank cut-offs that never put a whole key into one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 65536


def block_of(order: str, width: int) -> Column:
    return F.expr(f"`{order}` div {width}")


def running_total(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int | None = WIDTH
) -> DataFrame:
    """Add ``out``, the sum of ``value`` over the earlier rows of the same key.

    ``order`` is an integer, unique within a key.  Rows are cut into blocks of
    ``width`` positions, so a hot key is spread over many tasks: each block is
    summed locally, and only one row per block goes through the per-key window.
    ``width=None`` is the plain window, for keys known to be short.
    """
    before = (Window.unboundedPreceding, -1)
    if width is None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(*before)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    cut = [*keys, "_block"]
    blocked = df.withColumn("_block", block_of(order, width))
    totals = blocked.groupBy(*cut).agg(F.sum(value).alias("_total"))
    per_key = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*before)
    offsets = totals.select(*cut, F.coalesce(F.sum("_total").over(per_key), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*cut).orderBy(order).rowsBetween(*before)
    return (
        blocked.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
        .join(offsets, cut)
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_block", "_local", "_offset")
    )


def rank_cutoff(df: DataFrame, digits: list[Column], order: Column, size: Column) -> DataFrame:
    """The ``size(n)``-th smallest ``order`` value, as a table of at most one row.

    ``digits`` are leading parts of ``order``, most significant first, each of
    at most 65,536 values.  One pass per digit counts rows per digit value and
    keeps the one that holds the wanted rank; only the rows that share every
    digit are ranked at the end.  The count tables are bounded by the digit
    range and the boundary is a single row, so both may sit on one task or be
    broadcast whatever the data size.  ``size`` is an expression over ``n``.
    """
    keys = df.select(*[d.alias(f"_d{i}") for i, d in enumerate(digits)], order.alias("_order"))
    found: DataFrame | None = None
    for i in range(len(digits)):
        fixed = [f"_d{j}" for j in range(i)]
        rows = keys if found is None else keys.join(F.broadcast(found), fixed)
        carried = [] if found is None else ["_k"]
        counts = rows.groupBy(*fixed, *carried, f"_d{i}").agg(F.count(F.lit(1)).alias("_n"))
        every = Window.partitionBy(*fixed) if fixed else Window.partitionBy(F.lit(0))
        upto = every.orderBy(f"_d{i}").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("_upto", F.sum("_n").over(upto))
        if found is None:
            ranked = ranked.withColumn("n", F.sum("_n").over(every)).withColumn("_k", size)
        hit = (F.col("_k") > F.col("_upto") - F.col("_n")) & (F.col("_k") <= F.col("_upto"))
        found = ranked.filter(hit).select(
            *fixed, f"_d{i}", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_k")
        )
    names = [f"_d{j}" for j in range(len(digits))]
    last = Window.partitionBy(*names).orderBy("_order")
    return (
        keys.join(F.broadcast(found), names)
        .withColumn("_rank", F.row_number().over(last))
        .filter(F.col("_rank") == F.col("_k"))
        .select(F.col("_order").alias("cutoff"))
    )
