"""Token ids from a dictionary that is built from the samples.

Every distinct word has an id of its own.  Words are numbered densely without a
global sort: a digest deals them over 65,536 shards, words are ranked inside
their shard, and the shards' sizes, a table of bounded size, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convprep.functions.tokens import split_words
from convprep.operators.running import running_total
from convprep.profiles import CONTROL_TOKENS

#: Most frequent words that are sent to all tasks; any other word has less than one in so many occurrences.
FREQUENT = 4096


def tokenized(samples: DataFrame, text, keys: list[str] | None = None) -> DataFrame:
    """``chat_id, turn, tokens``: words and control tokens of each sample in order."""
    return samples.select(*(keys or ["chat_id", "turn"]), split_words(text).alias("tokens"))


def vocabulary(samples: DataFrame) -> DataFrame:
    """``token, n, id`` of every distinct token: control tokens by their fixed numbers, then the words.

    Copies of a word combine map-side.  Ids depend only on the set of words,
    not on the samples' order or partitions: they follow the first 16 bits of
    the word's md5, then the word.
    """
    counts = samples.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    controls = F.array(*[F.lit(t) for t in CONTROL_TOKENS])
    known = F.array_position(controls, F.col("token"))
    shard = F.conv(F.substring(F.md5("token"), 1, 4), 16, 10).cast("long")
    words = counts.withColumn("_known", known).withColumn("_shard", F.when(F.col("_known") == 0, shard))
    # Controls are few and share a shard of their own, which takes no numbers.
    ranked = words.withColumn("_rank", F.row_number().over(Window.partitionBy("_shard").orderBy("token")))
    sizes = words.filter("_known = 0").groupBy("_shard").agg(F.count(F.lit(1)).alias("_size"))
    every = sizes.withColumn("_all", F.lit(0))
    offsets = running_total(every, ["_all"], "_shard", "_size", "_offset", None).select("_shard", "_offset")
    numbered = ranked.join(F.broadcast(offsets), "_shard", "left")
    word_id = F.col("_offset") + F.col("_rank") - 1 + len(CONTROL_TOKENS)
    return numbered.select(
        "token", "n", F.when(F.col("_known") > 0, F.col("_known") - 1).otherwise(word_id).cast("long").alias("id")
    )


def dictionary_ids(
    samples: DataFrame, words: DataFrame, keys: list[str] | None = None, frequent: int = FREQUENT
) -> DataFrame:
    """The key columns and ``ids``, the numbers of each sample's tokens in order.

    ``samples`` (keys and ``tokens``) and ``words`` (``token, n, id``) are read
    twice, so give stored tables.  The ``frequent`` most frequent words are
    sent to all tasks; what is left has no hot word and meets the dictionary by
    a shuffle.  Only numbers travel back to the samples.  A sample without
    tokens has no ids; a token outside the dictionary is an error.
    """
    keys = keys or ["chat_id", "turn"]
    top = words.orderBy(F.desc("n"), "token").limit(frequent).select("token", "id")
    places = samples.select(*keys, F.posexplode_outer("tokens").alias("pos", "token"))
    coded = places.join(F.broadcast(top), "token", "left")
    direct = coded.filter(F.col("id").isNotNull() | F.col("token").isNull()).select(*keys, "pos", "id")
    rest = coded.filter(F.col("id").isNull() & F.col("token").isNotNull()).drop("id")
    missing = F.raise_error(F.concat(F.lit("not in the dictionary: "), F.col("token"))).cast("long")
    looked_up = rest.join(words.select("token", "id"), "token", "left").select(
        *keys, "pos", F.coalesce("id", missing).alias("id")
    )
    numbers = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id"))))
    gathered = direct.unionByName(looked_up).groupBy(*keys).agg(numbers.alias("_numbers"))
    return gathered.select(*keys, F.transform("_numbers", lambda x: x["id"]).alias("ids"))
