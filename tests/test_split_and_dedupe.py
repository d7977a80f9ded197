import math
import random

import pytest
from pyspark.sql import functions as F

from convprep.operators.chats import messages_of
from convprep.operators.dedupe import chat_facts, first_chats
from convprep.operators.report import funnel, preview, require_rows, split_sizes
from convprep.operators.running import running_total
from convprep.operators.split import split_exact, split_ordered


@pytest.mark.parametrize("n, p", [(100, 0.29), (7, 0.5), (1000, 0.05), (3, 0.34)])
def test_exact_split(spark, n, p):
    rows = spark.range(n).withColumnRenamed("id", "chat_id")
    split = split_exact(rows, p)
    sizes = {r.stage: r.n for r in split_sizes(split).collect()}
    assert sizes == {"eval": int(n * p), "train": n - int(n * p)}
    again = split_exact(rows.repartition(5), p)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, split.collect()))
    other = split_exact(rows, p, seed=1)
    if n >= 100:
        assert sorted(map(tuple, other.collect())) != sorted(map(tuple, split.collect()))


def test_split_needs_both_sides(spark):
    rows = spark.range(4).withColumnRenamed("id", "chat_id")
    with pytest.raises(Exception, match="each side"):
        split_exact(rows, 0.2).collect()


def test_ordered_split_on_any_spread_of_keys(spark):
    rng = random.Random(5)
    keys = [-(2**62), -5, -1, 0, 1, 2**20, 2**62] + [rng.randrange(-(2**40), 2**40) for _ in range(300)]
    rows = spark.createDataFrame([(k,) for k in set(keys)], "k long")
    for ratio in (0.1, 0.8):
        train = {r.k for r in split_ordered(rows, ratio, "k").filter("split = 'train'").collect()}
        assert train == set(sorted(set(keys))[: math.floor(len(set(keys)) * ratio)])


def test_running_total_with_a_hot_key(spark):
    """One key holds most rows; blocks and plain windows agree."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(7).alias("k"),
        F.col("id").alias("pos"),
        (F.col("id") % 11).alias("x"),
    )
    plain = running_total(rows, ["k"], "pos", "x", "before", None)
    cut = running_total(rows, ["k"], "pos", "x", "before", 64)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.select(*plain.columns).collect()))


def test_copies(spark, chats):
    a, b = [("User", "hi"), ("Chatbot", "yo")], [("User", "hi"), ("Chatbot", "ho")]
    swapped = [("User", "yo"), ("Chatbot", "hi")]
    bad = [("Chatbot", "yo")]
    table = chats(b, a, *[a] * 40, swapped, bad, bad)
    facts = chat_facts(messages_of(table))
    assert sorted(r.chat_id for r in first_chats(facts).collect()) == [0, 1, 42]
    assert {r.stage: r.n for r in funnel(facts).collect()} == {
        "loaded": 45,
        "valid": 43,
        "invalid": 2,
        "unique": 3,
        "duplicate": 40,
    }


def test_copies_shrink_before_the_shuffle(spark, chats):
    facts = chat_facts(messages_of(chats([("User", "hi"), ("Chatbot", "yo")])))
    plan = first_chats(facts)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(chat_id" in plan


def test_guards(spark, chats):
    table = chats([("User", "hi"), ("Chatbot", "yo")])
    with pytest.raises(ValueError, match="no chat can be trained on"):
        require_rows(table.filter("chat_id < 0"), "no chat can be trained on")
    assert require_rows(table, "x") is table
    assert preview(table, ("chat_id",)).count() == 1


def test_the_cutoff_takes_two_scans(spark):
    rows = spark.range(20_000)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = rows.mapInArrow(count, "id long")
    split = split_ordered(watched, 0.8, "id")
    assert seen.value == 2 * 20_000
    assert split.filter("split = 'train'").count() == 16_000


def test_a_cutoff_outside_the_bracket_is_found(spark, monkeypatch):
    monkeypatch.setattr("convprep.operators.split.ACCURACY", 2)
    rows = spark.createDataFrame([(k**3 - 500,) for k in range(200)], "k long")
    train = {r.k for r in split_ordered(rows, 0.3, "k").filter("split = 'train'").collect()}
    assert train == {k**3 - 500 for k in range(60)}
