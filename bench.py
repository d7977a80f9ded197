"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.  ``BENCH_COPIES``
repeats the conversations that many times under other ids, to see how times
grow with the data.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from convprep.plans.queries import QUERIES
from convprep.plans.session import scratch_path

HEADLINE = [
    "training_samples",
    "training_set",
    "budget_fit_reference",
    "chat_dedupe",
    "split_exact",
    "row_dedupe",
    "length_bucket",
    "token_ids",
    "packed_blocks",
    "inference_prompts",
    "jsonl_round_trip",
    "csv_round_trip",
    "prepare_folders_split",
    "training_rows",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("convprep-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        # Call sites of expressions are of use in error messages only.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def repeated(spark: SparkSession, folder: str, copies: int) -> str:
    """The tables with the conversations repeated under other ids."""
    out = scratch_path(spark, "bench")
    chats = spark.read.parquet(f"{folder}/conversations.parquet")
    ids = F.explode(F.sequence(F.col("conv_id"), F.col("conv_id") + (copies - 1) * 10**7, F.lit(10**7)))
    salted = F.concat("text", F.lit(" "), F.col("conv_id").cast("string"))
    chats.withColumn("conv_id", ids).withColumn("text", salted).repartition(64).write.parquet(
        f"{out}/conversations.parquet"
    )
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{out}/documents.parquet")
    return out


def run(spark: SparkSession, folder: str, name: str, times: int) -> float:
    """Best wall time of a query whose whole result is produced and thrown away."""
    best = float("inf")
    for _ in range(times):
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    return round(best, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    copies = int(os.environ.get("BENCH_COPIES", "1"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    tables = repeated(spark, folder, copies) if copies > 1 else folder
    names = sys.argv[1:] or HEADLINE
    run(spark, tables, names[0], 1)
    times = {name: run(spark, tables, name, 2) for name in names}
    chats = spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id").distinct().count()
    result = {
        "metric": "headline queries, total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
        "copies": copies,
        "chats": chats,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
