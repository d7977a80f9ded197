"""What was seen before: a growing corpus that new batches are compared with.

Two tables are kept, both bucketed by the column they are joined on, so that a
batch is shuffled and the corpus is not.  ``filter`` has one row for each shard
and batch, a bitmap in which every fingerprint sets four bits; it is small, and
rows of a shard merge by their union.  ``prints`` has the fingerprints.  Only
those of a batch that all bits of their shard speak for, true copies and a few
others, are compared with the prints, so results are exact.

The filter is written before the prints: if a write fails in between, bits too
many do no harm, and the batch is added again as a whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convprep.operators.turns import FINGERPRINT

#: Bits of a shard's bitmap, a fixed value of the bitmap functions.
BITS = 32768
#: Bits that a fingerprint sets, and fingerprints of a shard when the filter is full as planned.
SET, FULL = 4, 2048


def print_of(facts: DataFrame) -> Column:
    """One column that identifies a chat: its size and all of its fingerprint."""
    return F.concat_ws(":", "n_messages", *FINGERPRINT)


class SeenChats:
    """Fingerprints under ``path``, for ``expected`` chats; more of them cost time, not exactness."""

    def __init__(self, spark: SparkSession, path: str, expected: int = 1 << 20, buckets: int = 64):
        """Open what is under ``path``, or begin anew with room for ``expected`` chats."""
        self.spark, self.path = spark, path.rstrip("/")
        self._tag = uuid.uuid4().hex
        settings = self._settings()
        self.shards = settings["shards"] if settings else -(-expected // FULL)
        self.buckets = settings["buckets"] if settings else buckets
        if settings is None:
            row = [(self.shards, self.buckets)]
            spark.createDataFrame(row, "shards long, buckets int").coalesce(1).write.parquet(f"{self.path}/settings")
        self._table("filter", "shard BIGINT, bits BINARY", "shard")
        self._table("prints", "print STRING", "print")

    def _settings(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/settings/_SUCCESS")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.parquet(f"{self.path}/settings").first() if files.exists(folder) else None

    def _name(self, name: str) -> str:
        return f"seen_{name}_{self._tag}"

    def _table(self, name: str, columns: str, key: str) -> None:
        self.spark.sql(
            f"CREATE TABLE {self._name(name)} ({columns}) USING parquet "
            f"CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
        )

    def _append(self, rows: DataFrame, name: str, key: str) -> None:
        dealt = rows.repartition(self.buckets, key)
        dealt.write.format("parquet").bucketBy(self.buckets, key).option("path", f"{self.path}/{name}").mode(
            "append"
        ).saveAsTable(self._name(name))

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("print"), F.lit(self.shards))

    @staticmethod
    def _places() -> list[Column]:
        """The bits of a fingerprint, from a second hash of it."""
        h = F.xxhash64(F.lit("bits"), F.col("print"))
        return [F.shiftright(h, 15 * k).bitwiseAND(F.lit(BITS - 1)) for k in range(SET)]

    def filter(self) -> DataFrame:
        return self.spark.table(self._name("filter"))

    def prints(self) -> DataFrame:
        return self.spark.table(self._name("prints"))

    def likely(self, facts: DataFrame) -> DataFrame:
        """The chats that the filter speaks for: all that were seen, and a few others."""
        marked = facts.withColumn("print", print_of(facts)).withColumn("shard", self._shard())
        set_bits = F.lit(True)
        for place in self._places():
            byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10)
            set_bits = set_bits & (byte.cast("long").bitwiseAND(_power(place.bitwiseAND(F.lit(7)))) > 0)
        known = self.filter().withColumnRenamed("shard", "_shard")
        return marked.join(known, (F.col("shard") == F.col("_shard")) & set_bits, "left_semi").drop("shard")

    def unseen(self, facts: DataFrame) -> DataFrame:
        """``chat_id, n_messages`` and fingerprint of the valid chats of a batch that are new, the first of equal ones.

        ``facts`` is read three times; give a stored table.
        """
        firsts = facts.filter("valid").groupBy("n_messages", *FINGERPRINT).agg(F.min("chat_id").alias("chat_id"))
        again = self.likely(firsts).join(self.prints(), "print", "left_semi").select("chat_id")
        return firsts.join(again, "chat_id", "left_anti").select("chat_id", "n_messages", *FINGERPRINT)

    def add(self, chats: DataFrame) -> None:
        """Keep the fingerprints of chats, given as ``unseen`` returns them."""
        marked = chats.select(print_of(chats).alias("print"))
        bits = marked.select(self._shard().alias("shard"), F.explode(F.array(*self._places())).alias("_place"))
        bitmaps = bits.groupBy("shard").agg(F.bitmap_construct_agg("_place").alias("bits"))
        self._append(bitmaps, "filter", "shard")
        self._append(marked, "prints", "print")

    def merged(self) -> DataFrame:
        """The filter with one row for each shard, whatever batches it came in."""
        return self.filter().groupBy("shard").agg(F.bitmap_or_agg("bits").alias("bits"))

    def close(self) -> None:
        """Forget the table names; the files stay and can be opened again."""
        for name in ("filter", "prints"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(name)}")


def _power(place: Column) -> Column:
    """2 to the ``place``, for 0 to 7."""
    return F.get(F.array(*[F.lit(1 << k).cast("long") for k in range(8)]), place.cast("int"))

