import random

from convprep.operators.carried_starts import carried_starts


def test_starts_handed_through_many_segments(spark):
    """Compared with following each chat turn by turn; small groups force every level."""
    rng = random.Random(11)
    budget, credit, base, window = 40, 4, 4, 110
    rows, want = [], {}
    for chat in range(12):
        costs = [rng.choice([3, 4, 9, 20, 36]) for _ in range(rng.choice([1, 5, 300]))]
        pre = [sum(costs[:i]) for i in range(len(costs) + 1)]
        held, segment = 0, -1
        for k, c in enumerate(costs):
            seg = (pre[k + 1] - 1) // window
            if seg != segment:
                want[chat, seg] = held
                segment = seg
            counted, s = base + pre[k + 1] - pre[held], held
            while counted > budget:
                counted -= costs[s] + credit
                s += 1
            held = s
            rows.append((chat, base, k, pre[k], c, seg))
    kept = spark.createDataFrame(rows, "chat_id long, base long, rank long, pre long, cost long, segment long")
    got = {(r.chat_id, r.segment): r.entry for r in carried_starts(kept, budget, credit, fanout=4).collect()}
    assert got == want


def test_chats_of_one_segment_need_no_python(spark):
    rows = [(chat, 4, k, 10 * k, 10, 0) for chat in range(5) for k in range(3)]
    kept = spark.createDataFrame(rows, "chat_id long, base long, rank long, pre long, cost long, segment long")
    starts = carried_starts(kept, 40, 4)
    assert "InPandas" not in starts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, starts.collect())) == [(chat, 0, 0) for chat in range(5)]
