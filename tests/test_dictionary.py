"""Dictionary ids against a plain dictionary."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convprep.operators import dictionary
from convprep.profiles import CONTROL_TOKENS

TEXTS = [
    "a b a c",
    "",
    "the the the the " * 50 + "rare",
    f"{CONTROL_TOKENS[0]}x{CONTROL_TOKENS[3]} a <x> {CONTROL_TOKENS[3]}",
    "naïve 语 \U0001f600 a",
    " ".join(f"w{k % 97}" for k in range(500)),
]


def tokens(spark):
    rows = spark.createDataFrame([(k, 0, t) for k, t in enumerate(TEXTS)], "chat_id long, turn int, text string")
    return dictionary.tokenized(rows, F.col("text"))


def test_vocabulary_is_dense_and_shared_by_no_two_words(spark):
    table = tokens(spark)
    words = dictionary.vocabulary(table).collect()
    counts = Counter(t for r in table.collect() for t in r.tokens)
    assert {r.token: r.n for r in words} == counts
    plain = sorted((w for w in counts if w not in CONTROL_TOKENS), key=lambda w: (hashlib.md5(w.encode()).hexdigest()[:4], w.encode()))
    expected = {w: k + len(CONTROL_TOKENS) for k, w in enumerate(plain)}
    expected |= {c: CONTROL_TOKENS.index(c) for c in counts if c in CONTROL_TOKENS}
    assert {r.token: r.id for r in words} == expected
    again = dictionary.vocabulary(table.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, words))


@pytest.mark.parametrize("frequent", [1, 4096])
def test_ids_keep_the_order_of_the_tokens(spark, frequent):
    table = tokens(spark)
    words = dictionary.vocabulary(table)
    number = {r.token: r.id for r in words.collect()}
    ids = {r.chat_id: r.ids for r in dictionary.dictionary_ids(table, words, frequent=frequent).collect()}
    assert ids == {r.chat_id: [number[t] for t in r.tokens] for r in table.collect()}
    assert ids[1] == []


def test_a_token_outside_the_dictionary_is_an_error(spark):
    table = tokens(spark)
    words = dictionary.vocabulary(table.filter("chat_id <> 4"))
    with pytest.raises(Exception, match="not in the dictionary"):
        dictionary.dictionary_ids(table, words, frequent=2).collect()


def test_only_bounded_tables_are_sent_to_all(spark):
    table = tokens(spark)
    plan = dictionary.dictionary_ids(table, dictionary.vocabulary(table))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("GlobalLimit 4096") >= 1 and "CartesianProduct" not in plan
