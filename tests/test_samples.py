import random

import pytest

from convprep.functions.rendering import training_text
from convprep.operators.chats import messages_of
from convprep.operators.lengths import choose_length, sample_tokens
from convprep.operators.samples import EXACT, REFERENCE, chat_samples, rejected_turns
from convprep.operators.turns import array_turns
from convprep.plans.training import training_samples, training_set
from convprep.profiles import MARKED, PLAIN, SECTIONED
from model import base, contexts, cost, random_chat, turns_of, valid
from pyspark.sql import functions as F

SOT, EOT = "<|START_OF_TURN_TOKEN|>", "<|END_OF_TURN_TOKEN|>"
USER, BOT, SYS = SOT + "<|USER_TOKEN|>", SOT + "<|CHATBOT_TOKEN|>", SOT + "<|SYSTEM_TOKEN|>"

TWO_TURNS = [
    ("User", "This is user message one"),
    ("Chatbot", "This is chatbot message one"),
    ("User", "This is user message two"),
    ("User", "This is user message three"),
    ("Chatbot", "This is chatbot message two"),
]
FIRST = f"{USER}This is user message one{EOT}{BOT}"
SECOND = f"{USER}This is user message two{EOT}{USER}This is user message three{EOT}{BOT}"
BOTH = f"{FIRST}This is chatbot message one{EOT}{SECOND}"
ONE, TWO = "This is chatbot message one", "This is chatbot message two"

BUDGETS = {
    16: [],
    17: [(FIRST, ONE)],
    24: [(FIRST, ONE)],
    25: [(FIRST, ONE), (SECOND, TWO)],
    40: [(FIRST, ONE), (SECOND, TWO)],
    41: [(FIRST, ONE), (BOTH, TWO)],
}


def pairs(samples):
    return [(r.prompt, r.completion) for r in samples.orderBy("chat_id", "turn").collect()]


@pytest.mark.parametrize("budget", BUDGETS)
@pytest.mark.parametrize("mode", [EXACT, REFERENCE])
def test_budgets(chats, budget, mode):
    assert pairs(chat_samples(chats(TWO_TURNS), SECTIONED, budget, mode)) == BUDGETS[budget]


def test_tool_style_chat(chats):
    chat = [("System", "This is system message one"), ("User", "This is user message one")]
    chat += [("Chatbot", ONE), ("System", "This is system message two"), ("Chatbot", TWO)]
    chat += [("System", "This is system message three"), ("Chatbot", "This is chatbot message three")]
    p1 = f"{SYS}# User Preamble\nThis is system message one{EOT}{FIRST}"
    p2 = f"{p1}{ONE}{EOT}{SYS}This is system message two{EOT}{BOT}"
    p3 = f"{p2}{TWO}{EOT}{SYS}This is system message three{EOT}{BOT}"
    expected = [(p1, ONE), (p2, TWO), (p3, "This is chatbot message three")]
    assert pairs(chat_samples(chats(chat), SECTIONED, 100)) == expected


def test_modes_differ_where_the_stateful_rule_overshoots(chats):
    chat = []
    for words in ("a", "a", "a a a a a"):  # turns of 8, 8 and 16 tokens
        chat += [("User", words), ("Chatbot", words)]
    table = chats(chat)
    last = lambda mode: chat_samples(table, PLAIN, 24, mode).orderBy("turn").collect()[-1]
    assert (last(REFERENCE).first_turn, last(REFERENCE).n_tokens) == (1, 25)
    assert (last(EXACT).first_turn, last(EXACT).n_tokens) == (2, 17)


@pytest.fixture(scope="module")
def random_chats():
    rng = random.Random(3)
    return [random_chat(rng) for _ in range(250)]


@pytest.mark.parametrize("profile", [PLAIN, SECTIONED, MARKED])
@pytest.mark.parametrize("mode", [EXACT, REFERENCE])
def test_random_chats(chats, random_chats, profile, mode):
    budget = 40
    rows = chat_samples(chats(*random_chats), profile, budget, mode).collect()
    got = sorted((r.chat_id, r.turn, r.first_turn, r.n_tokens) for r in rows)
    want = [
        (i, *x) for i, m in enumerate(random_chats) if valid(m) for x in contexts(profile.name, m, budget, mode)
    ]
    assert got == sorted(want)
    if mode == EXACT:
        assert max(r.n_tokens for r in rows) <= budget
    for r in rows:
        _, turns = turns_of(random_chats[r.chat_id])
        assert r.completion == turns[r.turn][-1][1]
        assert r.prompt.endswith(profile.suffix)
        assert not r.prompt.startswith("<BOS_TOKEN>")


@pytest.mark.parametrize("mode", [EXACT, REFERENCE])
def test_long_chats_give_the_same_samples(chats, random_chats, mode):
    """With blocks of three messages nearly every chat is a long one."""
    table = chats(*random_chats)
    whole = chat_samples(table, MARKED, 40, mode)
    cut = training_samples(messages_of(table), MARKED, 40, mode, block=3)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def test_one_chat_of_many_segments(spark):
    """A single chat far above the budget and the block size."""
    n = 3000
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("chat_id"),
        F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 2, "Chatbot").otherwise("User").alias("role"),
        F.array_join(F.array_repeat(F.lit("w"), (F.col("id") * 7 % 11).cast("int")), " ").alias("content"),
    )
    chat = [(r.role, r.content) for r in rows.orderBy("pos").collect()]
    for mode in (EXACT, REFERENCE):
        got = training_samples(rows, MARKED, 120, mode, block=64)
        plan = sorted((r.turn, r.first_turn, r.n_tokens) for r in got.collect())
        assert plan == contexts("marked", chat, 120, mode)


def test_rejected_turns(chats, random_chats):
    good = [m for m in random_chats if valid(m)]
    turned = array_turns(chats(*good), PLAIN)
    got = {(r.chat_id, r.turn): r.reason for r in rejected_turns(turned, 40).collect()}
    want = {}
    for i, m in enumerate(good):
        preamble, turns = turns_of(m)
        for k, t in enumerate(turns):
            c = cost("plain", t)
            if c == 0:
                want[i, k] = "empty_turn"
            elif c + base("plain", preamble) > 40:
                want[i, k] = "over_budget"
    assert got == want


def test_sample_size_matches_context_size(chats, random_chats):
    """Counting the finished text agrees with the sum of the message costs."""
    for profile, less in ((PLAIN, 0), (SECTIONED, 0), (MARKED, 1)):
        rows = chat_samples(chats(*random_chats), profile, 60)
        sized = rows.filter("completion != ''").withColumn(
            "counted", sample_tokens(F.col("prompt"), F.col("completion"))
        )
        assert sized.filter(F.col("counted") != F.col("n_tokens") - less).count() == 0


def test_training_text_strips_only_spaces(spark):
    row = spark.createDataFrame([("a \n  ", "  \tb ")], "p string, c string")
    assert row.select(training_text(F.col("p"), F.col("c"))).first()[0] == "a \n\tb "


def test_length_choice_is_strict(spark):
    text = lambda n: " ".join(["w"] * n)
    ddl = "split string, prompt string, completion string"
    rows = [("train", text(509) + " ", text(0)), ("eval", "a", " b")]
    assert choose_length(spark.createDataFrame(rows, ddl)).first().sequence_length == 512
    rows = [("train", text(510), ""), ("eval", "a", " b")]
    assert choose_length(spark.createDataFrame(rows, ddl)).first().sequence_length == 1024
    empty = choose_length(spark.createDataFrame([], ddl)).first()
    assert (empty.max_tokens, empty.sequence_length) == (0, 512)
    rows = [("train", text(16382), "")]
    with pytest.raises(Exception, match="no sequence length above 16384"):
        choose_length(spark.createDataFrame(rows, ddl)).collect()


def test_training_set_splits_chats_not_turns(chats, random_chats):
    table = messages_of(chats(*random_chats, *random_chats))
    rows = training_set(table, 0.25, PLAIN, 60).collect()
    sides = {}
    for r in rows:
        sides.setdefault(r.chat_id, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values())
    firsts = {}
    for i, m in enumerate(random_chats):
        if valid(m):
            firsts.setdefault(tuple(m), i)
    assert set(sides) <= set(firsts.values())
    long = training_set(table, 0.25, PLAIN, 60, block=4)
    assert sorted(map(tuple, long.select(*rows[0].asDict()).collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize("mode", [EXACT, REFERENCE])
@pytest.mark.parametrize("n", [1, 63, 64, 65, 700])
def test_pointers_of_many_turns(spark, mode, n):
    """The halving search over sums in two levels, against a plain walk."""
    rng = random.Random(n)
    words = [(rng.randrange(1, 12), rng.randrange(1, 12)) for _ in range(n)]
    chat = [m for a, b in words for m in (("User", "a " * a), ("Chatbot", "b " * b))]
    rows = spark.createDataFrame([(0, chat)], "chat_id long, messages array<struct<role:string,content:string>>")
    got = chat_samples(rows, PLAIN, 90, mode).select("turn", "first_turn", "n_tokens").orderBy("turn").collect()
    assert [tuple(r) for r in got] == contexts("plain", chat, 90, mode)
