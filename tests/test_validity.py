import random

from pyspark.sql import functions as F

from convprep.functions.validity import is_valid_inference, is_valid_training
from convprep.operators.chats import messages_of
from convprep.operators.dedupe import chat_facts
from model import random_chat, valid

ROLE = {"S": "System", "U": "User", "C": "Chatbot", "A": "Assistant"}

VALID = ["SUC", "UC", "SUCUUC", "UCUUC", "UCUU", "SUCSCSC", "USCSCUC", "SSC"]
INVALID = ["UA", "UCC", "S", "U", "C", "SU", "SC"]


def as_chat(letters):
    return [(ROLE[x], "") for x in letters]


def test_role_sequences(chats):
    table = chats(*[as_chat(x) for x in VALID + INVALID])
    rows = table.select("chat_id", is_valid_training(F.col("messages")).alias("v")).orderBy("chat_id").collect()
    assert [r.v for r in rows] == [True] * len(VALID) + [False] * len(INVALID)


def test_empty_and_null_content(chats, spark):
    table = chats([], [("User", None), ("Chatbot", "x")], [(None, "x"), ("Chatbot", "x")])
    assert [r[0] for r in table.select(is_valid_training(F.col("messages"))).collect()] == [False] * 3


def test_message_table_agrees_with_chat_rows(chats):
    rng = random.Random(7)
    lists = [as_chat(x) for x in VALID + INVALID] + [random_chat(rng, 8) for _ in range(400)]
    table = chats(*lists)
    rows = table.select(
        "chat_id",
        is_valid_training(F.col("messages")).alias("v"),
        is_valid_inference(F.col("messages")).alias("r"),
    ).collect()
    flat = {r.chat_id: (r.valid, r.valid_request) for r in chat_facts(messages_of(table)).collect()}
    for r in rows:
        m = lists[r.chat_id]
        assert r.v == valid(m), m
        assert r.r == valid(m + [("Chatbot", "")]), m
        assert flat[r.chat_id] == (r.v, r.r), m
