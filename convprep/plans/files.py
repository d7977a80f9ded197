"""From folders of chat or pair files to training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convprep.functions.messages import fingerprint
from convprep.functions.validity import is_valid_training
from convprep.operators.chats import BLOCK, messages_of
from convprep.operators.long_chats import long_samples
from convprep.operators.report import Funnel, require_rows
from convprep.operators.running import block_of
from convprep.operators.samples import EXACT, chat_samples
from convprep.operators.split import EVAL, TRAIN, split_exact
from convprep.plans.session import stored
from convprep.profiles import SECTIONED, Profile
from convprep.sources.detect import read_train_and_eval
from convprep.sources.readers import accepted


def unique_chats(read: DataFrame, funnel: Funnel | None = None) -> DataFrame:
    """``chat_id, messages`` of the distinct valid chats of a reader.

    A chat's id is its fingerprint, so it depends neither on the folder nor on
    how the files were cut.  The files are parsed once: the valid chats are
    stored, and copies are found on the ids.  No valid chat is an error.
    """
    is_valid = is_valid_training(F.col("messages"))
    valid = accepted((funnel or Funnel()).read(read, is_valid)).filter(is_valid)
    parsed = stored(valid.select(fingerprint(F.col("messages")).alias("chat_id"), "source", "messages"), "parsed")
    require_rows(parsed, "no chat can be trained on")
    first = parsed.groupBy("chat_id").agg(F.min("source").alias("source"))
    return parsed.join(first, ["chat_id", "source"], "left_semi").select("chat_id", "messages")


def file_samples(
    chats: DataFrame, profile: Profile, budget: int, mode: str, counter, block: int = BLOCK, funnel: Funnel | None = None
) -> DataFrame:
    """Samples of ``chat_id, messages, split``; very long rows go the segmented way."""
    chats = stored((funnel or Funnel()).unique(chats), "chosen")
    size = F.size("messages")
    short = chat_samples(chats.filter(size <= block), profile, budget, mode, counter, ["split"], validate=False)
    longer = chats.filter(size > block)
    if longer.select("chat_id").limit(1).isEmpty():
        return short
    blocked = messages_of(longer, ["split"]).withColumn("block", block_of("pos", block))
    return short.unionByName(long_samples(blocked, profile, budget, mode, counter, ["split"], block))


def prepare(
    spark: SparkSession,
    train_folder: str,
    eval_folder: str | None = None,
    eval_fraction: float = 0.2,
    profile: Profile = SECTIONED,
    budget: int | None = None,
    mode: str = EXACT,
    counter=None,
    strict: bool = False,
    funnel: Funnel | None = None,
) -> DataFrame:
    """Samples of a train folder and an optional eval folder, with their ``split``.

    Without an eval folder, or when it holds no files, the train chats are
    split; otherwise each side is deduplicated alone.  A ``funnel`` counts what
    was kept and dropped on all sides, without a scan of its own.
    """
    train, evaluation = read_train_and_eval(spark, train_folder, eval_folder, strict)
    if evaluation is None:
        chats = split_exact(unique_chats(train, funnel), eval_fraction)
    else:
        # A chat may be on both sides, with an id for each.
        sides = [
            unique_chats(side, funnel)
            .withColumn("split", F.lit(name))
            .withColumn("chat_id", F.concat_ws(":", "split", "chat_id"))
            for name, side in ((TRAIN, train), (EVAL, evaluation))
        ]
        chats = sides[0].unionByName(sides[1])
    return file_samples(chats, profile, budget if budget is not None else profile.max_length, mode, counter, funnel=funnel)
