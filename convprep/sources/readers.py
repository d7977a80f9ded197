"""Readers for chat and prompt-completion files.

Every reader keeps the rows it cannot use: a row has either its data or a
``problem``.  ``accepted`` and ``quarantined`` take the two sides apart, and
``strict=True`` turns the first problem into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convprep.functions.messages import MESSAGES_DDL, pair_messages
from convprep.sources.csv_records import csv_records, file_lines

WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

# A JSON number, as a value of one of the given keys outside of strings.
_NUMBER = r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"

# No text is too long for the parser but for the size of a row.
JSON_OPTIONS = {"maxStringLen": str(2**31 - 1)}

CSV_OPTIONS = {"quote": '"', "escape": '"', "multiLine": True, "emptyValue": "", "nullValue": "\u0000"}

# The same for single records.
FIELD_OPTIONS = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_OPTIONS.items()}


def quote_numbers(line: Column, keys: list[str]) -> Column:
    """Turn number values of ``keys`` into strings with the same spelling."""
    pattern = r'(?<!\\)("(?:' + "|".join(keys) + r')"\s*:\s*)' + _NUMBER + r"(?=\s*[,}])"
    return F.regexp_replace(line, pattern, '$1"$2"')


def skeleton(line: Column) -> Column:
    """A JSON line whose string values are empty: keys and types at a size that does not depend on the texts.

    Without escapes every quotation mark is the end of a string, so one scan finds the values.
    """
    plain = F.regexp_replace(line, r"\\.", "")
    return F.regexp_replace(plain, r'([:\[,]\s*)"[^"]*"(?!\s*:)', '$1""')


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions run once a row, however often the columns are used.

    A filter or projection is merged into a projection below it, with a copy of
    its expressions for each use, but not into a generator.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def line_numbers(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add the 1-based ``line`` of its file to each row of ``wanted``.

    Rows are counted per input split; only one row per split is put in order.
    """
    splits = lines.groupBy("source.file", "source.start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("source.row").alias("_first")
    )
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        F.struct("file", "start").alias("_split"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"),
    )
    return (
        wanted.withColumn("_split", F.struct("source.file", "source.start"))
        .join(offsets, "_split")
        .withColumn("line", F.col("_offset") + F.col("source.row"))
        .drop("_split", "_offset")
    )


def _finish(rows: DataFrame, strict: bool, lines: DataFrame | None = None) -> DataFrame:
    """The rows; in strict mode a problem is an error, with its line where the lines are known."""
    if not strict:
        return rows
    if lines is not None:
        wrong = line_numbers(lines, rows.filter(F.col("problem").isNotNull()))
        first = wrong.orderBy("source.file", "line").select("problem", "source.file", "line").first()
        if first is not None:
            raise ValueError(f"{first['problem']} in {first['file']}, line {first['line']}")
        return rows
    failure = F.raise_error(F.concat(F.col("problem"), F.lit(" in "), F.col("source.file")))
    return rows.withColumn("problem", F.when(F.col("problem").isNotNull(), failure.cast("string")))


def read_chat_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Chats, one JSON object per line: ``source, messages, problem, value``.

    Numbers as content keep their spelling as text.  Any other type, missing
    or extra keys, and repeated keys are structure problems.
    """
    lines = file_lines(spark, path)
    return _finish(parse_chat_lines(lines), strict, lines)


def parse_chat_lines(lines: DataFrame) -> DataFrame:
    """``source, value`` lines as ``source, messages, problem, value``; a row-wise step."""
    quoted = computed(lines, _quoted=quote_numbers(F.col("value"), ["content", "role"]))
    shape = "OBJECT<messages: ARRAY<OBJECT<content: STRING, role: STRING>>>"
    typed = computed(
        quoted,
        _json=F.try_parse_json(skeleton(F.col("_quoted"))),
        _messages=F.from_json("_quoted", f"messages {MESSAGES_DDL}", JSON_OPTIONS)["messages"],
    )
    # The shape is that of all messages merged, so a key missing from one of
    # them shows as a NULL field only.
    complete = F.forall("_messages", lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    problem = (
        F.when(~F.is_valid_utf8("value"), "not_utf8")
        .when(F.col("_json").isNull(), "malformed_json")
        .when(F.schema_of_variant("_json") != shape, "structure")
        .when(F.col("_messages").isNull(), "malformed_json")
        .when(~complete, "structure")
    )
    return computed(typed, problem=problem).select(
        "source",
        F.when(F.col("problem").isNull(), F.col("_messages")).alias("messages"),
        "problem",
        "value",
    )


def read_pair_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Prompt-completion JSON lines: ``source, prompt, completion, problem, value``.

    Blank lines are skipped and other keys ignored.
    """
    # This set matches at either end, not inside, so no text is lost.
    trimmed = computed(file_lines(spark, path), _text=F.trim(F.col("value"), F.lit(WHITESPACE)))
    lines = trimmed.filter(F.col("_text") != "")
    quoted = computed(lines, _quoted=quote_numbers(F.col("_text"), ["prompt", "completion"]))
    parsed = computed(
        quoted,
        _json=F.try_parse_json(skeleton(F.col("_quoted"))),
        _pair=F.from_json("_quoted", "prompt string, completion string", JSON_OPTIONS),
    )
    part = lambda key: F.try_variant_get("_json", f"$.{key}", "variant")
    text = lambda key: F.col("_pair")[key]
    problem = (
        F.when(~F.is_valid_utf8("value"), "not_utf8")
        .when(F.col("_json").isNull(), "malformed_json")
        .when(~F.startswith(F.schema_of_variant("_json"), F.lit("OBJECT")), "structure")
        .when(part("prompt").isNull(), "missing_key: prompt")
        .when(part("completion").isNull(), "missing_key: completion")
        .when(
            (F.schema_of_variant(part("prompt")) != "STRING")
            | (F.schema_of_variant(part("completion")) != "STRING"),
            "structure",
        )
        .when(text("prompt").isNull() | text("completion").isNull(), "malformed_json")
    )
    good = F.col("problem").isNull()
    rows = computed(parsed, problem=problem).select(
        "source",
        F.when(good, text("prompt")).alias("prompt"),
        F.when(good, text("completion")).alias("completion"),
        "problem",
        "value",
    )
    return _finish(rows, strict, lines)


def read_pair_csv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Prompt-completion CSV without header: ``source, prompt, completion, problem, value``.

    Columns past the second are ignored; a row with a single column is a
    problem, as is one with bytes that are not UTF-8.  A file of any size is
    read by many tasks, also where quoted fields hold line ends.
    """
    records = csv_records(spark, path)
    # Field one, quoted or not, then a comma.
    two_fields = F.col("value").rlike(r'^(?:"(?:[^"]|"")*+"|[^,]*),')
    problem = F.when(~F.is_valid_utf8("value"), "not_utf8").when(
        F.col("_pair.completion").isNull() & ~two_fields, "missing_column"
    )
    fields = F.from_csv("value", "prompt string, completion string", FIELD_OPTIONS)
    rows = records.withColumn("_pair", fields).withColumn("problem", problem)
    good = F.col("problem").isNull()
    return _finish(
        rows.select(
            "source",
            F.when(good, F.coalesce("_pair.prompt", F.lit(""))).alias("prompt"),
            F.when(good, F.coalesce("_pair.completion", F.lit(""))).alias("completion"),
            "problem",
            F.when(~good, F.col("value")).alias("value"),
        ),
        strict,
        file_lines(spark, path, "\n") if strict else None,
    )


def read_prepared_csv(
    spark: SparkSession, path: str, declared: tuple[str, ...] = ("prompt", "completion"), strict: bool = False
) -> DataFrame:
    """Prepared CSV with header: ``source``, the declared columns that exist, ``problem`` and ``value``.

    A record with bytes that are not UTF-8 is a problem as a whole; its columns
    are NULL and ``value`` has its bytes, written as CSV.  Types are never
    inferred, so ``007`` and ``1.50`` stay as they are.  Columns are named by
    the header of the first file; a file of any size is read by many tasks.
    """
    named = spark.read.options(**CSV_OPTIONS).csv(path, header=True).columns
    columns = ", ".join(f"c{k} string" for k in range(len(named)))
    records = csv_records(spark, path, header=True)
    good = F.is_valid_utf8("value")
    parsed = records.withColumn("_row", F.from_csv("value", columns, FIELD_OPTIONS))
    # ISO-8859-1 maps each byte to one character and back.
    fields = F.from_csv(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), columns, FIELD_OPTIONS)
    kept = F.encode(F.to_csv(fields, {"quoteAll": "true", "escape": '"'}), "ISO-8859-1")
    rows = parsed.select(
        "source",
        *[
            F.when(good, F.coalesce(F.col("_row")[f"c{named.index(name)}"], F.lit(""))).alias(name)
            for name in declared
            if name in named
        ],
        F.when(~good, "not_utf8").alias("problem"),
        F.when(~good, kept).alias("value"),
    )
    return _finish(rows, strict, file_lines(spark, path, "\n") if strict else None)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("problem").isNull()).drop("problem", "value")


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("problem").isNotNull())


def problem_counts(rows: DataFrame) -> DataFrame:
    """``problem, n``, where NULL stands for the accepted rows."""
    return rows.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def pairs_as_chats(pairs: DataFrame) -> DataFrame:
    """Reader rows of pairs as reader rows of chats, keeping the problems."""
    both = pair_messages(F.col("prompt"), F.col("completion"))
    return pairs.select("source", F.when(F.col("problem").isNull(), both).alias("messages"), "problem", "value")


def read_table(
    spark: SparkSession, path: str, fmt: str, schema: str | None = None, whole: bool = False
) -> DataFrame:
    """A table by format name: csv, tsv (with header), json, jsonl, txt.

    ``json`` takes records in an array or one per line; ``whole`` reads each
    file as one JSON value, or one text, instead.  Without a schema CSV columns
    are text.
    """
    if fmt in ("csv", "tsv"):
        sep = "," if fmt == "csv" else "\t"
        return spark.read.options(**CSV_OPTIONS).csv(path, schema=schema, header=True, sep=sep)
    if fmt == "json" and whole:
        return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("value"))
    if fmt in ("json", "jsonl"):
        return spark.read.json(path, schema=schema)
    if fmt == "txt":
        return spark.read.text(path, wholetext=whole)
    raise NotImplementedError(fmt)
