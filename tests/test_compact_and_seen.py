import random
import re

import pytest
from pyspark.sql import functions as F

from convprep.operators.chats import messages_of
from convprep.operators.compact import compact_samples, rendered
from convprep.operators.dedupe import chat_facts, first_chats
from convprep.operators.samples import EXACT, REFERENCE
from convprep.operators.seen import SeenChats
from convprep.plans.session import stored
from convprep.plans.training import training_samples
from convprep.profiles import MARKED
from model import contexts, random_chat, valid


@pytest.mark.parametrize("mode, block", [(EXACT, 1024), (EXACT, 4), (REFERENCE, 4)])
def test_compact_samples_render_to_the_same_rows(spark, chats, mode, block):
    rng = random.Random(3)
    lists = [random_chat(rng, 60) for _ in range(25)]
    messages = messages_of(chats(*lists))
    compact = stored(compact_samples(messages, MARKED, 60, mode, block=block), "compact")
    got = sorted((r.chat_id, r.turn, r.first_turn, r.n_tokens) for r in compact.collect())
    assert got == sorted((i, *x) for i, m in enumerate(lists) if valid(m) for x in contexts("marked", m, 60, mode))
    whole = sorted(map(tuple, training_samples(messages, MARKED, 60, mode).collect()))
    assert sorted(map(tuple, rendered(messages, compact, MARKED, block=block).collect())) == whole


def test_compact_size_is_linear(spark, chats):
    """The text of the prompts grows with the square of the turns, the intervals do not."""
    sizes = []
    for n in (50, 200):
        messages = messages_of(chats([("User", "a b c"), ("Chatbot", "d")] * n))
        compact = stored(compact_samples(messages, MARKED, 100_000), "compact")
        assert "prompt" not in compact.columns
        text = rendered(messages, compact, MARKED).agg(F.sum(F.length("prompt"))).first()[0]
        sizes.append((compact.count(), text))
    assert sizes[1][0] == 4 * sizes[0][0] and sizes[1][1] > 14 * sizes[0][1]


def batches(spark, chats):
    rng = random.Random(8)
    lists = [random_chat(rng, 8) for _ in range(60)]
    lists += rng.choices(lists, k=60) + [lists[0]] * 30
    facts = stored(chat_facts(messages_of(chats(*lists))), "facts")
    return facts, [facts.filter(F.col("chat_id").between(a, a + 49)) for a in (0, 50, 100)]


@pytest.mark.parametrize("expected", [1, 1 << 20])
def test_batches_equal_one_dedupe(spark, chats, tmp_path, expected):
    facts, parts = batches(spark, chats)
    seen, kept = SeenChats(spark, str(tmp_path / "seen"), expected, buckets=4), []
    for k, part in enumerate(parts):
        if k == 2:
            # Another run opens what is there; its own settings do not count.
            seen.close()
            seen = SeenChats(spark, str(tmp_path / "seen"), 5, buckets=9)
            assert (seen.buckets, seen.shards) == (4, 1 if expected == 1 else 512)
        new = stored(seen.unseen(part), "new")
        kept += [(r.chat_id, r.n_messages) for r in new.collect()]
        seen.add(new)
        # A batch that is added again changes nothing.
        assert seen.unseen(part).count() == 0
    assert sorted(kept) == sorted(map(tuple, first_chats(facts).collect()))
    seen.close()


def test_the_filter_speaks_for_all_that_was_seen_and_few_others(spark, tmp_path):
    made = lambda low, high: spark.range(low, high).select(
        F.col("id").alias("chat_id"), F.lit(2).cast("long").alias("n_messages"), *[F.xxhash64("id", F.lit(k)).alias(f"fp{k}") for k in range(4)]
    )
    seen = SeenChats(spark, str(tmp_path / "s"), expected=4000, buckets=2)
    seen.add(made(0, 2000))
    seen.add(made(2000, 4000))
    assert seen.likely(made(0, 4000)).count() == 4000
    assert seen.likely(made(10_000, 14_000)).count() < 80
    assert seen.merged().count() == seen.shards == 2 and seen.filter().count() == 4
    seen.close()


def test_the_corpus_is_not_shuffled(spark, chats, tmp_path):
    facts, parts = batches(spark, chats)
    seen = SeenChats(spark, str(tmp_path / "seen"), 1000, buckets=4)
    seen.add(stored(seen.unseen(parts[0]), "new"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = seen.unseen(parts[1])._jdf.queryExecution().sparkPlan().toString()
        executed = seen.unseen(parts[1])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "seen_prints" in plan and "seen_filter" in plan
    # Between a corpus scan and the join above it there is no exchange.
    deep = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    lines, checked = executed.splitlines(), 0
    for k, line in enumerate(lines):
        if re.search(r"Scan parquet .*seen_(prints|filter)", line):
            at = deep(line)
            for above in reversed(lines[:k]):
                if deep(above) < at:
                    at = deep(above)
                    assert "Exchange" not in above
                    if "Join" in above:
                        checked += 1
                        break
    assert checked == 2
    seen.close()


def test_every_step_of_compact_samples_is_planned_once(spark, chats):
    """Steps that are read several times are stored; planned anew for each reader, the plan has hundreds of scans."""
    messages = stored(messages_of(chats([("User", "a b c"), ("Chatbot", "d")] * 300, [("User", "a"), ("Chatbot", "b")])), "m")
    plan = compact_samples(messages, MARKED, 60, REFERENCE, block=16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") < 10
