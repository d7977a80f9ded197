"""CSV records of files that many tasks read.

A line end inside quotes does not end a record, and whether a line begins inside
quotes depends on all lines before it in its file.  So every line is first taken
as a function: whether it ends inside quotes, if it begins outside and if it
begins inside.  There are four such functions; they compose associatively, so
each chunk, a number of lines of an input split, is summed up by one of them,
the chunks of a file are put together in order, and then every chunk knows how
it begins, and which record goes on into it.  Records that go on over the
border of a chunk are joined from their parts.  Chunks keep windows and groups
small whatever the size of a split; the text moves once, by chunk.

The files are scanned twice, for the chunks and for the text, and both scans
have to cut them alike.  They are parts of one query, so settings or executors
that change before it runs change both; should the scans differ all the same,
for executors that come or go while it starts, the query fails.

Line ends are LF or CR LF.  A quotation mark counts at the beginning of a field
only; elsewhere in an unquoted field it is a character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
# Where a line can be: at the beginning of a field, inside an unquoted one, inside quotes, after a mark in quotes.
_FIELD, _PLAIN, _QUOTED, _MARK = 0, 1, 2, 3

#: Lines of a chunk.
LINES = 1024

_CHUNK = ["file", "start", "part"]


def file_lines(spark: SparkSession, path: str, line_end: str | None = None) -> DataFrame:
    """Lines of text files with ``source STRUCT<file, start, row>``, which orders them as in the files.

    ``start`` is where the input split begins and ``row`` rises within a split,
    so the order needs no pass over the data.
    """
    reader = spark.read if line_end is None else spark.read.option("lineSep", line_end)
    return reader.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("source"),
        "value",
    )


def ends_quoted(line: Column, begins_quoted: bool, sep: str = ",") -> Column:
    """Whether a line ends inside quotes.  One step for each quotation mark."""
    pieces = F.split(line, QUOTE, -1)

    def after_piece(state: Column, piece: Column) -> Column:
        outside = F.when(F.endswith(piece, F.lit(sep)), _FIELD).otherwise(_PLAIN)
        return F.when((piece == "") | (state == _QUOTED), state).otherwise(outside)

    def after_mark(state: Column) -> Column:
        return F.when(state == _PLAIN, _PLAIN).when(state == _QUOTED, _MARK).otherwise(_QUOTED)

    begin = after_piece(F.lit(_QUOTED if begins_quoted else _FIELD), F.get(pieces, F.lit(0)))
    end = F.aggregate(F.slice(pieces, 2, F.size(pieces)), begin, lambda s, piece: after_piece(after_mark(s), piece))
    return F.when(F.instr(line, QUOTE) == 0, F.lit(begins_quoted)).otherwise(end == _QUOTED)


def composed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``fixed, inside`` before (``_b``) and after (``_a``) each row: the composition of all rows of the key so far.

    A row has ``out`` and ``into``, its values for a beginning outside and
    inside.  ``inside`` is the value if the first row of the key begins outside;
    unless ``fixed``, a beginning inside gives the opposite.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swaps = F.sum((F.col("out") & ~F.col("into")).cast("int")).over(w)
    constant = F.when(F.col("out") == F.col("into"), F.struct("out", "_swaps"))
    held = rows.withColumn("_swaps", swaps).withColumn("_held", F.last(constant, ignorenulls=True).over(w))
    since = F.col("_swaps") - F.coalesce(F.col("_held._swaps"), F.lit(0))
    inside = F.coalesce(F.col("_held.out"), F.lit(False)) != (since % 2 == 1)
    after = held.withColumn("_a", F.struct(F.col("_held").isNotNull().alias("fixed"), inside.alias("inside")))
    nothing = F.struct(F.lit(False).alias("fixed"), F.lit(False).alias("inside"))
    before = F.coalesce(F.lag("_a").over(Window.partitionBy(*keys).orderBy(*order)), nothing)
    return after.withColumn("_b", before).drop("_swaps", "_held")


def _value(composition: str, begins: Column) -> Column:
    """The value of a composition for a key that begins inside or outside."""
    c = F.col(composition)
    return F.when(c["fixed"], c["inside"]).otherwise(c["inside"] != begins)


def _followed(changes: str, begins_quoted: bool) -> Column:
    """``inside, opened`` at the end of a chunk that begins as told: whether it ends inside quotes, and the row of the
    record that goes on, if it began in the chunk."""
    nothing = F.struct(F.lit(begins_quoted).alias("inside"), F.lit(None).cast("long").alias("opened"))

    def after(state: Column, line: Column) -> Column:
        inside = F.when(state["inside"], line["into"]).otherwise(line["out"])
        opened = F.when(inside, F.when(state["inside"], state["opened"]).otherwise(line["row"]))
        return F.struct(inside.alias("inside"), opened.alias("opened"))

    return F.aggregate(changes, nothing, after)


def chunk_table(lines: DataFrame) -> DataFrame:
    """One row for each chunk: ``begins``, whether it begins inside quotes, and the sources of records that matter to it.

    ``origin`` is the record that it begins in, ``opened`` the row of the record
    that begins in it and goes on after it, ``header`` the first of its file.
    Its rows are those from ``low`` to ``high``.
    """
    changes = F.when(F.col("out") | ~F.col("into"), F.struct("row", "out", "into"))
    filled = F.when(~F.col("value").isin("", "\r"), F.col("row"))
    chunks = (
        lines.groupBy(*_CHUNK)
        .agg(
            F.min("row").alias("low"),
            F.max("row").alias("high"),
            F.min(filled).alias("_filled"),
            F.array_sort(F.collect_list(changes)).alias("_changes"),
        )
        .select(
            *_CHUNK,
            "low",
            "high",
            "_filled",
            _followed("_changes", False).alias("_outside"),
            _followed("_changes", True).alias("_inside"),
        )
    )
    functions = chunks.withColumn("out", F.col("_outside.inside")).withColumn("into", F.col("_inside.inside"))
    begun = composed(functions, ["file"], ["start", "part"]).withColumn("begins", _value("_b", F.lit(False)))
    opened = F.when(F.col("begins"), F.col("_inside.opened")).otherwise(F.col("_outside.opened"))
    source = lambda row: F.when(row.isNotNull(), F.struct("file", "start", row.alias("row")))
    in_file = Window.partitionBy("file").orderBy("start", "part")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return begun.withColumn("opened", opened).select(
        *_CHUNK,
        "low",
        "high",
        "begins",
        "opened",
        F.last(source(F.col("opened")), ignorenulls=True).over(before).alias("origin"),
        F.min(source(F.col("_filled"))).over(whole).alias("header"),
    )


def with_chunks(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """The lines with what their chunks say, none lost: a line that its chunk did not have is an error.

    Both sides have every line of the files once, so if no line is over, all chunks are alike on both.
    """
    known = F.coalesce(F.col("row").between(F.col("low"), F.col("high")), F.lit(False))
    failure = F.raise_error(F.concat(F.lit("the splits changed during the query over "), F.col("file")))
    joined = lines.join(chunks, _CHUNK, "left")
    return joined.filter(F.when(known, F.lit(True)).otherwise(failure.cast("boolean"))).drop("low", "high")


def csv_records(spark: SparkSession, path: str, sep: str = ",", header: bool = False) -> DataFrame:
    """``source, value``: the records of CSV files as text, in any number of tasks; ``source`` is that of the first line.

    Empty lines outside quotes are no records; with ``header`` the first record
    of each file is none.  A file that ends inside quotes ends its last record.
    Bytes are kept as they are.
    """
    lines = file_lines(spark, path, "\n").select(
        F.col("source.file").alias("file"),
        F.col("source.start").alias("start"),
        F.expr(f"source.row div {LINES}").alias("part"),
        F.col("source.row").alias("row"),
        "value",
        ends_quoted(F.col("value"), False, sep).alias("out"),
        ends_quoted(F.col("value"), True, sep).alias("into"),
    )
    stated = with_chunks(composed(lines, _CHUNK, ["row"]), chunk_table(lines))
    in_chunk = Window.partitionBy(*_CHUNK).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    first = F.last(F.when(~_value("_b", F.col("begins")), F.col("row")), ignorenulls=True).over(in_chunk)
    placed = stated.withColumn("_first", first)
    # Parts of a record in several chunks: where a chunk begins inside a record, and the record that goes on.
    over = F.col("_first").isNull() | F.coalesce(F.col("_first") == F.col("opened"), F.lit(False))
    begun = F.struct("file", "start", F.col("_first").alias("row"))
    placed = placed.withColumn("source", F.coalesce(F.when(F.col("_first").isNull(), F.col("origin")), begun))
    if header:
        placed = placed.filter(F.col("source") != F.col("header"))
    # Co-located with the windows: the text moves once, and what lies across borders once more.
    whole = placed.filter(~over).groupBy(*_CHUNK, "_first").agg(_joined("row", "value").alias("value"))
    joined = placed.filter(over).groupBy("source").agg(_joined("start", "row", "value").alias("value"))
    records = whole.select(begun.alias("source"), "value").unionByName(joined)
    # Regular expressions would replace bytes that are not UTF-8.
    shorter = F.substring(F.col("value"), F.lit(1), F.length("value") - 1)
    value = F.when(F.endswith("value", F.lit("\r")), shorter).otherwise(F.col("value"))
    return records.withColumn("value", value).filter(F.col("value") != "")


def _joined(*columns: str) -> Column:
    pieces = F.array_sort(F.collect_list(F.struct(*columns)))
    return F.array_join(F.transform(pieces, lambda x: x["value"]), "\n")
