import json
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from convprep.functions.messages import normalize_messages
from convprep.functions.rendering import render_messages, reply_between, strip_begin
from convprep.functions.tokens import TokenizerCounter, rendered_tokens
from convprep.operators.inference import batch_generate, extract_replies, request_prompts
from convprep.operators.lengths import sample_tokens
from convprep.operators.samples import REFERENCE, chat_samples
from convprep.operators.tensors import IGNORED, label_mask, pack, with_special
from convprep.plans.training import training_samples
from convprep.operators.chats import messages_of
from convprep.profiles import CONTROL_TOKENS, MARKED, PLAIN, SECTIONED, Profile, profile_columns, with_profile
from model import random_chat

SOT, EOT = "<|START_OF_TURN_TOKEN|>", "<|END_OF_TURN_TOKEN|>"
BOS, BOT = "<BOS_TOKEN>", "<|CHATBOT_TOKEN|>"


def test_label_mask(spark):
    rows = spark.createDataFrame([([1, 9, 2, 9, 3, 4],), ([1, 2],), ([9],), ([],)], "ids array<int>")
    got = [r[0] for r in rows.select(label_mask(F.col("ids"), 9)).collect()]
    x = IGNORED
    assert got == [[x, x, x, x, 3, 4], [x, x], [x], []]


def test_special_tokens_and_cut(spark):
    rows = spark.createDataFrame([([5, 6, 7],)], "ids array<int>")
    assert rows.select(with_special(F.col("ids"), 1, 2)).first()[0] == [1, 5, 6, 7, 2]
    assert rows.select(with_special(F.col("ids"), 1, 2, 3)).first()[0] == [1, 5, 6]


def slot_of(chat):
    return int(hashlib.md5(str(chat).encode()).hexdigest()[:4], 16)


@pytest.mark.parametrize("width, name", [(None, int), (3, int), (None, "chat-{}".format), (None, lambda c: c * 10**15)])
def test_packing(spark, width, name):
    rng = random.Random(1)
    samples, shards, length = [], 3, 10
    for chat in range(20):
        for turn in range(rng.choice([1, 2, 40 if chat == 4 else 3])):
            samples.append((name(chat), turn, [rng.randrange(100) for _ in range(rng.choice([0, 1, 7, 33]))]))
    kind = "string" if isinstance(samples[0][0], str) else "long"
    rows = spark.createDataFrame(samples, f"chat_id {kind}, turn long, ids array<int>")
    rows = rows.withColumn("n_ids", F.size("ids"))
    got = {(r.shard, r.block): r.ids for r in pack(rows, length, shards, end=-1, width=width).collect()}
    want = {}
    for shard in range(shards):
        order = sorted(samples, key=lambda s: (slot_of(s[0]), s[0], s[1]))
        stream = [t for c, _, ids in order if slot_of(c) % shards == shard for t in [*ids, -1]]
        for at in range(0, len(stream), length):
            want[shard, at // length] = stream[at : at + length]
    assert got == want
    full = pack(rows, length, shards, end=-1, keep_tail=False, width=width).collect()
    assert {(r.shard, r.block) for r in full} == {k for k, v in want.items() if len(v) == length}


@pytest.mark.parametrize(
    "text, n",
    [
        (f"{BOS}{SOT}<|USER_TOKEN|>a b{EOT}{SOT}{BOT}", 6),
        (f"{BOS}{SOT}<|USER_TOKEN|>a b{EOT}{SOT}{BOT}<|START_RESPONSE|>", 6),
        (f"{BOS}{SOT}<|USER_TOKEN|>a b{EOT}", 6),
        (f"{SOT}<|USER_TOKEN|>a b{EOT}{SOT}{BOT}c d", 11),
        (f"{SOT}<|USER_TOKEN|>a b{EOT}{SOT}{BOT}", 9),
    ],
)
def test_rendered_string_sizes(spark, text, n):
    assert spark.range(1).select(rendered_tokens(F.lit(text))).first()[0] == n


def test_strip_begin_takes_the_first_only(spark):
    rows = spark.createDataFrame([(f"{BOS}a{BOS}",), (f"a{BOS}b",), ("a",), ("",)], "t string")
    assert [r[0] for r in rows.select(strip_begin(F.col("t"))).collect()] == [f"a{BOS}", "ab", "a", ""]


def test_optional_sections(spark, chats):
    profile = Profile("safe", preamble_title="# User Preamble\n", safety_text="Be kind.", reply_format_text="No lists.")
    table = chats([("User", "hi"), ("Chatbot", "yo")])
    text = table.select(render_messages(profile_columns(profile), F.lit(""), F.slice("messages", 1, 1))).first()[0]
    sys = f"{SOT}<|SYSTEM_TOKEN|>"
    assert text == (
        f"{BOS}{sys}# Safety Preamble\nBe kind.\n\n# User Preamble\n{EOT}{SOT}<|USER_TOKEN|>hi{EOT}"
        f"{sys}No lists.{EOT}{SOT}{BOT}"
    )
    sample = chat_samples(table, profile, 100).first()
    assert sample.n_tokens == 1 + (3 + 8) + 4 + 4 + (3 + 2)
    assert f"{BOS}{sample.prompt}" == text


def test_empty_preamble_block(chats):
    table = chats([("System", ""), ("User", "hi"), ("Chatbot", "yo")])
    prompt = lambda p: chat_samples(table, p, 100).first().prompt
    assert prompt(PLAIN) == prompt(SECTIONED) == f"{SOT}<|USER_TOKEN|>hi{EOT}{SOT}{BOT}"
    assert prompt(MARKED).startswith(f"{SOT}<|SYSTEM_TOKEN|>{EOT}{SOT}<|USER_TOKEN|>")


def test_unknown_profile_and_role(spark, chats):
    table = chats([("User", "hi"), ("Robot", "yo")]).withColumn("name", F.lit("nope"))
    with pytest.raises(Exception, match="unknown profile: nope"):
        with_profile(table, "name").collect()
    with pytest.raises(Exception, match="unknown role: Robot"):
        table.select(render_messages(profile_columns(PLAIN), F.lit(""), F.col("messages"))).collect()


def test_profile_rows_give_the_same_samples(chats):
    table = chats(*[random_chat(random.Random(i)) for i in range(30)])
    named = with_profile(table.withColumn("name", F.lit("marked")), "name")
    by_row = chat_samples(named, F.col("profile"), 60, extra=["profile"]).drop("profile")
    assert sorted(map(tuple, by_row.collect())) == sorted(map(tuple, chat_samples(table, MARKED, 60).collect()))


REQUESTS = [
    (0, "Be brief", [("User", "a"), ("Chatbot", "b")], "c"),
    (1, None, None, "c"),
    (2, "", [], ""),
    (3, "Be brief", None, None),
    (4, None, [("user", "a"), ("assistant", "b")], "c"),
    (5, None, [("User", "a")], None),
    (6, None, [("User", "a"), ("Chatbot", "b")], None),
]
REQUEST_DDL = "req_id long, preamble string, chat_history array<struct<role:string,content:string>>, message string"


def test_requests_and_replies(spark):
    rows = request_prompts(spark.createDataFrame(REQUESTS, REQUEST_DDL), PLAIN)
    got = {r.req_id: r for r in rows.collect()}
    assert [i for i, r in got.items() if r.problem is None] == [0, 1, 5]
    user = f"{SOT}<|USER_TOKEN|>"
    assert got[0].prompt == (
        f"{BOS}{SOT}<|SYSTEM_TOKEN|>Be brief{EOT}{user}a{EOT}{SOT}{BOT}b{EOT}{user}c{EOT}{SOT}{BOT}"
    )
    assert got[6].problem == "invalid_input"

    def generator(prompts):
        return [p + "reply" + (EOT if "Be brief" in p else "") for p in prompts]

    replies = extract_replies(batch_generate(rows.filter("problem is null"), generator)).collect()
    assert {r.req_id: (r.text, r.problem) for r in replies} == {
        0: ("reply", None),
        1: (None, "truncated_generation"),
        5: (None, "truncated_generation"),
    }
    assert all(r.latency.endswith("ms") for r in replies)


def test_reply_must_not_overlap_the_prompt(spark):
    rows = spark.createDataFrame([("p" + EOT, "p" + EOT), ("p" + EOT, "p" + EOT + EOT)], "prompt string, decoded string")
    got = rows.select(reply_between(F.col("decoded"), F.col("prompt"), EOT)).collect()
    assert [r[0] for r in got] == [None, ""]


def test_roles_become_canonical(spark, chats):
    table = chats([("SYSTEM", "a"), ("uSer", "b"), ("Assistant", "c"), ("chatbot", "d"), ("tool", "e")])
    out = table.select(normalize_messages(F.col("messages"), "message").alias("m")).first().m
    assert [(x.role, x.message) for x in out] == [
        ("System", "a"),
        ("User", "b"),
        ("Chatbot", "c"),
        ("Chatbot", "d"),
        ("tool", "e"),
    ]


@pytest.fixture(scope="module")
def tokenizer(spark, tmp_path_factory):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import models, pre_tokenizers

    words = {w: i for i, w in enumerate(["[UNK]", "w", "rule", "#", "User", "Preamble"])}
    made = tokenizers.Tokenizer(models.WordLevel(words, unk_token="[UNK]"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    made.add_special_tokens(CONTROL_TOKENS)
    path = tmp_path_factory.mktemp("tok") / "tokenizer.json"
    made.save(str(path))
    assert json.loads(path.read_text())["model"]["type"] == "WordLevel"
    return TokenizerCounter(spark, str(path))


@pytest.mark.parametrize("profile", [PLAIN, MARKED])
def test_own_tokenizer_agrees_with_the_word_counter(chats, tokenizer, profile):
    table = chats(*[random_chat(random.Random(i)) for i in range(40)])
    native = chat_samples(table, profile, 60, REFERENCE)
    own = chat_samples(table, profile, 60, REFERENCE, tokenizer)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, native.collect()))
    cut = training_samples(messages_of(table), profile, 60, REFERENCE, tokenizer, block=4)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, native.collect()))
    sized = own.select(
        sample_tokens(F.col("prompt"), F.col("completion"), tokenizer).alias("a"),
        sample_tokens(F.col("prompt"), F.col("completion")).alias("b"),
    )
    assert sized.filter("a <> b").count() == 0
