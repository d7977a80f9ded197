"""From raw documents to token ids: the stages of a training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's documents.  All but the last keep
the columns of the documents, also those that a stage does not know; where such
a column has the name of one that an operator adds, it is set aside meanwhile.
Stages take nulls, empty and very long texts, ties, repeated rows and empty
tables as their operators do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convprep.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from convprep.llm.common import stored, table

#: Columns that stages work on; all others are set aside.
KNOWN = ("doc_id", "text", "lang", "source")
#: The rank file of the tokenizer; None stands for the multilingual one of the installed public tokenizers.
RANKS: str | None = None
#: Share of all tokens that the mixture may hold.
MIX_PERCENT = 80


def set_aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The documents with all unknown columns renamed, and what undoes that and drops added columns."""
    names = {c: c if c in KNOWN else f"__aside{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, lambda rows: rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with more than half of them in scripts that no labelled document has, go."""
    rows, back = set_aside(docs)
    return back(language_id.in_known_language(rows))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z one row stays, that with the largest id."""
    rows, back = set_aside(docs)
    return back(exact_dedup.exact_dedup(rows).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) one document, of those with the smallest id, stays.

    Rows without an id have no name in a group and stay.  Rows are told apart
    by id and text, so a row that shares its id with a copy stays.
    """
    groups = jaccard_join.near_groups(docs)
    dropped = stored(groups.filter(~F.col("stays")).select("doc_id", F.col("row").alias("__row")).distinct(), "near")
    if dropped.count() <= jaccard_join.SMALL_LIST:
        dropped = F.broadcast(dropped)
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    return keyed.join(dropped, ["doc_id", "__row"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fill the budgets of their domains, languages and sources, each once at most."""
    rows, back = set_aside(docs)
    return back(mixing.mixed(rows, percent=MIX_PERCENT, epochs=1))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the bytes that they decode to."""
    path = RANKS
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    tokens = bpe.decode(bpe.encode(docs.select("doc_id", "text"), ranks), ranks)
    return tokens.select("doc_id", "ids", *bpe.digest_columns())


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", tokenize),
]

#: SQL has no cross-parsing, components or merges; the tests run the stages by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
