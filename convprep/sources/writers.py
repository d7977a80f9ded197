"""Writers; none overwrites unless told to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CSV_WRITE = {
    "quote": '"',
    "escape": '"',
    "quoteAll": True,
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_table(rows: DataFrame, path: str, fmt: str, overwrite: bool = False) -> None:
    """Write by format name: csv, tsv (with header), json, jsonl, txt (one text column)."""
    out = rows.write.mode(_mode(overwrite))
    if fmt in ("csv", "tsv"):
        out.options(**CSV_WRITE).csv(path, header=True, sep="," if fmt == "csv" else "\t")
    elif fmt in ("json", "jsonl"):
        out.option("ignoreNullFields", False).json(path)
    elif fmt == "txt":
        out.text(path)
    else:
        raise NotImplementedError(fmt)


def write_samples_csv(samples: DataFrame, path: str, overwrite: bool = False) -> None:
    """``prompt, completion`` with header, every field quoted, as an interchange file."""
    write_table(samples.select("prompt", "completion"), path, "csv", overwrite)


def write_chat_jsonl(chats: DataFrame, path: str, overwrite: bool = False) -> None:
    """One ``{"messages": [...]}`` object per line."""
    write_table(chats.select("messages"), path, "jsonl", overwrite)


SIDES = ("train", "test")
#: Folder of the list of splits, hidden from readers of the rows; it is written last.
MANIFEST = "_splits"


def write_splits(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Both sides in one pass, under ``split=train`` and ``split=test``, and then the list of splits with their sizes.

    The same pass counts the sizes.  A set without the list is not whole, so a
    write that fails leaves nothing that ``read_splits`` takes for a set; write
    it again with ``overwrite``.
    """
    named = rows.withColumn("split", F.when(F.col("split") == "eval", "test").otherwise(F.col("split")))
    sizes = Observation()
    counted = named.observe(sizes, *[F.count_if(F.col("split") == side).alias(side) for side in SIDES])
    counted.write.mode(_mode(overwrite)).partitionBy("split").parquet(path)
    listed = [(side, n) for side, n in sizes.get.items() if n]
    spark = rows.sparkSession
    spark.createDataFrame(listed, "split string, n bigint").coalesce(1).write.json(f"{path}/{MANIFEST}")


def side_of(split: str) -> str:
    """A name that contains ``train`` is the train side, else ``test`` the test side."""
    for side in SIDES:
        if side in split:
            return side
    raise ValueError(f"{split!r} names neither the train nor the test side")


def read_splits(spark: SparkSession, path: str, splits: str = "train,test") -> DataFrame:
    """The named splits of a set that was written whole, each of which must be there; only their folders are read."""
    sides = {name: side_of(name) for name in splits.split(",")}
    try:
        listed = spark.read.schema("split string, n bigint").json(f"{path}/{MANIFEST}")
    except AnalysisException as missing:
        raise FileNotFoundError(f"{path} has no list of splits, so it was not written whole") from missing
    for name in sides:
        if listed.filter(F.col("split") == name).isEmpty():
            raise FileNotFoundError(f"{path} has no split {name!r}")
    side = F.lit(None).cast("string")
    for name, value in sides.items():
        side = F.when(F.col("split") == name, value).otherwise(side)
    rows = spark.read.parquet(path)
    return rows.filter(F.col("split").isin(*sides)).withColumn("split", side)
