import pytest
from pyspark.sql import functions as F

from convprep.operators.dedupe import cast_declared, dedupe_chats, dedupe_rows
from convprep.sources.detect import CHAT_JSONL, PAIR_CSV, PAIR_JSONL, detect_format, read_chats, read_train_and_eval
from convprep.sources.readers import (
    accepted,
    file_lines,
    line_numbers,
    problem_counts,
    quarantined,
    read_chat_jsonl,
    read_pair_csv,
    read_pair_jsonl,
    read_prepared_csv,
    read_table,
)
from convprep.sources.writers import read_splits, side_of, write_samples_csv, write_splits, write_table

REPLY = b'{"role":"Chatbot","content":"x"}'


def chat_line(first: bytes, tail: bytes = b"") -> bytes:
    return b'{"messages":[' + first + b"," + REPLY + b"]" + tail + b"}"


CHAT_LINES = [
    (chat_line(b'{"role":"User","content":1.10}'), "1.10"),
    (chat_line(b'{"content":1e5,"role":"User"}'), "1e5"),
    (chat_line(b'{"role":"User","content": -7 }'), "-7"),
    (chat_line(b'{"role":"User","content":"say \\"content\\": 5, ok"}'), 'say "content": 5, ok'),
    (chat_line(b'{"role":"User","content":"caf\xc3\xa9 \\u00e9"}'), "café é"),
    (chat_line(b'{"role":"User","content":true}'), "structure"),
    (chat_line(b'{"role":"User","content":null}'), "structure"),
    (chat_line(b'{"role":"User","content":{"a":1}}'), "structure"),
    (chat_line(b'{"role":"User","content":["a"]}'), "structure"),
    (chat_line(b'{"role":"User","message":"a"}'), "structure"),
    (chat_line(b'{"role":"User","content":"a","x":"b"}'), "structure"),
    (chat_line(b'{"role":"User"}'), "structure"),
    (chat_line(b'{"content":"a"}'), "structure"),
    (chat_line(b'{"role":"User","content":"a"}', b',"id":1'), "structure"),
    (b'{"messages":[]}', "structure"),
    (b'{"messages":"a"}', "structure"),
    (b"[1]", "structure"),
    (chat_line(b'{"role":"User","content":NaN}'), "malformed_json"),
    (chat_line(b'{"role":"User","content":007}'), "malformed_json"),
    (chat_line(b'{"role":"User","content":"a","content":"b"}'), "malformed_json"),
    (b"not json", "malformed_json"),
    (b"", "malformed_json"),
    (chat_line(b'{"role":"User","content":"\xff"}'), "not_utf8"),
]


@pytest.fixture
def folder(tmp_path):
    def make(name, data: bytes):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
        return str(tmp_path / "in")

    return make


def test_chat_jsonl_types(spark, folder):
    path = folder("a.jsonl", b"\n".join(line for line, _ in CHAT_LINES) + b"\n")
    rows = read_chat_jsonl(spark, path).orderBy("source").collect()
    got = [r.problem or r.messages[0].content for r in rows]
    assert got == [want for _, want in CHAT_LINES]
    bad = [i + 1 for i, (_, want) in enumerate(CHAT_LINES) if want in ("structure", "malformed_json", "not_utf8")]
    numbered = line_numbers(file_lines(spark, path), quarantined(read_chat_jsonl(spark, path)))
    assert sorted(r.line for r in numbered.collect()) == bad
    with pytest.raises(Exception, match="line 1?[0-9]$"):
        read_chat_jsonl(spark, path, strict=True).collect()


def test_line_numbers_over_input_splits(spark, folder):
    path = folder("a.txt", "".join(f"{i}\n" for i in range(1, 5001)).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = file_lines(spark, path)
        assert lines.select("source.start").distinct().count() > 5
        rows = line_numbers(lines, lines.filter("value % 7 = 0"))
        assert rows.filter("line <> value").count() == 0
        assert rows.count() == 5000 // 7
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pair_jsonl(spark, folder):
    path = folder(
        "a.jsonl",
        b'  {"prompt":"a","completion":1.10,"zz":[1]}\t\n   \t\n{"prompt":"a"}\n{"completion":"a"}\n'
        b'{"prompt":null,"completion":"b"}\n[]\n{bad\n{"prompt":"p\xff","completion":"b"}\n',
    )
    rows = read_pair_jsonl(spark, path).orderBy("source").collect()
    assert (rows[0].prompt, rows[0].completion, rows[0].problem) == ("a", "1.10", None)
    assert [r.problem for r in rows[1:]] == [
        "missing_key: completion",
        "missing_key: prompt",
        "structure",
        "structure",
        "malformed_json",
        "not_utf8",
    ]
    assert {r.problem: r.n for r in problem_counts(read_pair_jsonl(spark, path)).collect()}[None] == 1


def test_pair_csv(spark, folder):
    path = folder(
        "a.csv",
        b'a,b\n"multi\nline","he said ""hi"", ok"\nonly\nx,y,z\np,,q\n,\n"",""\n lead , trail \n'
        b'back\\slash,"q\\"\n"c\r\nd",e\nbad\xff,z\n"just"\n',
    )
    rows = read_pair_csv(spark, path).orderBy("source").collect()
    assert [(r.prompt, r.completion) if r.problem is None else r.problem for r in rows] == [
        ("a", "b"),
        ("multi\nline", 'he said "hi", ok'),
        "missing_column",
        ("x", "y"),
        ("p", ""),
        ("", ""),
        ("", ""),
        (" lead ", " trail "),
        ("back\\slash", "q\\"),
        ("c\r\nd", "e"),
        "not_utf8",
        "missing_column",
    ]


NASTY = [
    ("007", "1.50"),
    ("TRUE", "NA"),
    ("", ""),
    (" lead", "trail "),
    ("new\nline", "cr\r\nlf"),
    ('"quoted"', "back\\slash"),
    ("comma,comma", "é ü"),
    ("null", "\\N"),
]


def test_prepared_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(NASTY, "prompt string, completion string")
    write_samples_csv(rows, str(tmp_path / "s"))
    back = accepted(read_prepared_csv(spark, str(tmp_path / "s"))).select("prompt", "completion")
    assert sorted(map(tuple, back.collect())) == sorted(NASTY)
    with pytest.raises(Exception, match="already exists"):
        write_samples_csv(rows, str(tmp_path / "s"))
    write_samples_csv(rows, str(tmp_path / "s"), overwrite=True)


def test_prepared_csv_drops_whole_records(spark, folder):
    path = folder("a.csv", b'prompt,completion,other\n"a\nb\xff\nc",d,1\ne,f,2\ne,f,3\ng,h,\xff\n')
    rows = read_prepared_csv(spark, path)
    good = dedupe_rows(accepted(rows))
    assert [tuple(r) for r in good.collect()] == [("e", "f")]
    kept = {bytes(r.value) for r in quarantined(rows).collect()}
    assert kept == {b'"a\nb\xff\nc","d","1"', b'"g","h","\xff"'}


def test_declared_columns_that_exist(spark):
    rows = spark.createDataFrame([(1, 2)], "prompt int, extra int")
    out = cast_declared(rows, {"prompt": "string", "completion": "string"})
    assert out.dtypes == [("prompt", "string")]


def test_formats(spark, folder, tmp_path):
    path = folder("b.jsonl", b'{"prompt":"a","completion":"b"}\n{"messages":[]}\n')
    assert detect_format(spark, path) == PAIR_JSONL
    # Lines of the other format are set aside.
    assert [r.problem for r in read_chats(spark, path).orderBy("source").collect()] == [None, "missing_key: prompt"]
    folder("a.csv", b"a,b\n")
    assert detect_format(spark, path) == PAIR_CSV
    (tmp_path / "other").mkdir()
    other = str(tmp_path / "other")
    assert read_train_and_eval(spark, path, other)[1] is None
    with pytest.raises(FileNotFoundError):
        read_chats(spark, other)
    (tmp_path / "other" / "x.jsonl").write_bytes(CHAT_LINES[0][0])
    assert detect_format(spark, other) == CHAT_JSONL
    assert read_train_and_eval(spark, path, other)[1].count() == 1
    (tmp_path / "other" / "x.jsonl").write_bytes(b"{oops")
    with pytest.raises(ValueError, match="no JSON object"):
        detect_format(spark, other)


def test_file_chats_keep_the_first_of_copies(spark, folder):
    line = lambda text: chat_line(b'{"role":"User","content":"' + text + b'"}')
    swapped = b'{"messages":[{"content":"b","role":"User"},' + REPLY + b"]}"
    path = folder("a.jsonl", b"\n".join([line(b"a"), line(b"b"), line(b"a"), swapped, line(b"c")]))
    chats = accepted(read_chat_jsonl(spark, path))
    kept = dedupe_chats(chats, "source").orderBy("source").collect()
    assert [r.messages[0].content for r in kept] == ["a", "b", "c"]
    assert [r.source.row for r in kept] == [0, 1, 4]


def test_tables(spark, tmp_path, folder):
    rows = spark.createDataFrame([("a", 1), ("b\tc", 2)], "name string, n int")
    for fmt in ("csv", "tsv", "json", "jsonl"):
        path = str(tmp_path / fmt)
        write_table(rows, path, fmt)
        assert sorted(map(tuple, read_table(spark, path, fmt, "name string, n int").collect())) == [("a", 1), ("b\tc", 2)]
    path = folder("r.json", b'[{"name":"a","n":1},{"name":"b","n":2}]')
    assert read_table(spark, path, "json", "name string, n int").count() == 2
    whole = read_table(spark, path, "json", whole=True)
    assert whole.select(F.variant_get("value", "$[1].name", "string")).first()[0] == "b"
    with pytest.raises(NotImplementedError):
        read_table(spark, path, "xml")


def test_named_splits(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train"), ("b", "eval")], "text string, split string")
    write_splits(rows, str(tmp_path / "s"))
    assert sorted(map(tuple, read_splits(spark, str(tmp_path / "s")).collect())) == [("a", "train"), ("b", "test")]
    assert read_splits(spark, str(tmp_path / "s"), "test").count() == 1
    assert (side_of("my_train_test"), side_of("testing")) == ("train", "test")
    with pytest.raises(ValueError):
        side_of("dev")


def test_a_write_that_fails_leaves_no_set(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(0, 100, 1, 4).selectExpr("CAST(id AS string) AS text", "IF(id % 5 = 0, 'eval', 'train') AS split")
    failing = rows.withColumn("text", F.when(F.col("text") == "99", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        write_splits(failing, path)
    with pytest.raises(FileNotFoundError, match="not written whole"):
        read_splits(spark, path)
    write_splits(rows, path, overwrite=True)
    assert read_splits(spark, path).groupBy("split").count().orderBy("split").collect() == [("test", 20), ("train", 80)]
    # What fails over a whole set does not leave the old list beside new rows.
    with pytest.raises(Exception, match="lost"):
        write_splits(failing, path, overwrite=True)
    with pytest.raises(FileNotFoundError):
        read_splits(spark, path)


@pytest.mark.parametrize("read", [read_pair_jsonl, read_chat_jsonl])
def test_lines_are_parsed_once(spark, tmp_path, read):
    """A filter on the problem is not another reason to parse."""
    (tmp_path / "a.jsonl").write_text("{}\n")
    plan = accepted(read(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("regexp_replace(") == 3
