"""Which files a folder holds, and in which of the two formats they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convprep.sources.readers import pairs_as_chats, read_chat_jsonl, read_pair_csv, read_pair_jsonl

PAIR_CSV, PAIR_JSONL, CHAT_JSONL = "pair_csv", "pair_jsonl", "chat_jsonl"

# JSON lines come as .jsonl, or as the .json part files that Spark writes.
CSV_FILES, JSONL_FILES = "*.csv", "*.{jsonl,json}"


def has_files(spark: SparkSession, folder: str, pattern: str) -> bool:
    """Whether the folder holds files of the pattern; lists, does not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return not listed.select("path").limit(1).isEmpty()


def detect_format(spark: SparkSession, folder: str) -> str | None:
    """CSV files win over JSON lines; the first line of the first file by name tells pairs from chats."""
    if has_files(spark, folder, CSV_FILES):
        return PAIR_CSV
    if not has_files(spark, folder, JSONL_FILES):
        return None
    files = spark.read.format("binaryFile").option("pathGlobFilter", JSONL_FILES).load(folder)
    name = files.agg(F.min("path")).first()[0]
    first = spark.read.text(name).filter(F.col("_metadata.file_block_start") == 0).limit(1)
    keys = first.select(F.json_object_keys("value").alias("keys")).first()
    if keys is None or keys["keys"] is None:
        raise ValueError(f"the first line of {name} is no JSON object")
    return PAIR_JSONL if {"prompt", "completion"} <= set(keys["keys"]) else CHAT_JSONL


def read_chats(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """Chats of a folder, whatever its format: ``source, messages, problem, value``."""
    fmt = detect_format(spark, folder)
    if fmt is None:
        raise FileNotFoundError(f"{folder} has neither CSV nor JSON lines files")
    if fmt == PAIR_CSV:
        return pairs_as_chats(read_pair_csv(spark, f"{folder}/{CSV_FILES}", strict))
    if fmt == PAIR_JSONL:
        return pairs_as_chats(read_pair_jsonl(spark, f"{folder}/{JSONL_FILES}", strict))
    return read_chat_jsonl(spark, f"{folder}/{JSONL_FILES}", strict)


def read_train_and_eval(
    spark: SparkSession, train_folder: str, eval_folder: str | None = None, strict: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """Chats of the train folder, which must hold files, and of the eval folder, which may."""
    train = read_chats(spark, train_folder, strict)
    if eval_folder is None or detect_format(spark, eval_folder) is None:
        return train, None
    return train, read_chats(spark, eval_folder, strict)
