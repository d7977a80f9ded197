"""Sizes and positions that must not change what is kept."""

from __future__ import annotations

import csv
import gzip
import io
import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from convprep.operators.chats import dense_positions, messages_of, with_chat_facts
from convprep.operators.dedupe import chat_facts
from convprep.plans import queries
from convprep.plans.files import prepare
from convprep.plans.rows import numbered, training_rows
from convprep.plans.session import CLEANUP, local_folder, shuffles_freed, stored
from convprep.plans.training import training_samples, training_set
from convprep.profiles import PLAIN
from convprep.sources.detect import detect_format
from convprep.sources.readers import read_chat_jsonl, read_pair_jsonl
from convprep.sources.writers import read_splits, write_splits


def chat_line(*texts):
    roles = ["User", "Chatbot"] * len(texts)
    return json.dumps({"messages": [{"role": r, "content": t} for r, t in zip(roles, texts)]})


def test_texts_of_any_length_are_read(spark, tmp_path):
    long = 'say "x"\\ \n' * 2_100_000
    (tmp_path / "a.jsonl").write_text(chat_line(long, "yes") + "\n" + chat_line("b", "c") + "\n")
    rows = read_chat_jsonl(spark, str(tmp_path / "a.jsonl"))
    got = rows.select("problem", F.length(F.get("messages", F.lit(0))["content"]).alias("n")).collect()
    assert sorted((r.problem, r.n) for r in got) == [(None, 1), (None, len(long))]
    (tmp_path / "p.jsonl").write_text(json.dumps({"prompt": long, "completion": "c", "more": {"a": [1, "x"]}}) + "\n")
    pair = read_pair_jsonl(spark, str(tmp_path / "p.jsonl")).select("problem", F.length("prompt").alias("n")).first()
    assert (pair.problem, pair.n) == (None, len(long))


@pytest.mark.parametrize("move", [lambda p: p + 1, lambda p: p * 2000, lambda p: 5000 + 7 * p])
def test_positions_count_by_order(spark, chats, move):
    table = messages_of(
        chats(
            [("System", "s"), ("User", "a"), ("Chatbot", "b"), ("User", "c"), ("Chatbot", "d")],
            [("System", "s"), ("Chatbot", "b")],
            [("User", "a"), ("Chatbot", "b")],
        )
    )
    moved = table.withColumn("pos", move(F.col("pos")).cast("long"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(dense_positions(moved).select("chat_id", "pos", "role", "content")) == rows(
        table.select("chat_id", "pos", "role", "content")
    )
    assert {r.chat_id: r.valid for r in chat_facts(moved).collect()} == {0: True, 1: False, 2: True}
    assert rows(training_samples(moved, PLAIN, 100)) == rows(training_samples(table, PLAIN, 100))
    columns = ["chat_id", "turn", "prompt", "completion", "split"]
    assert rows(training_set(moved, 0.5, PLAIN, 100).select(columns)) == rows(
        training_set(table, 0.5, PLAIN, 100).select(columns)
    )


def test_no_valid_chat_is_an_error(spark, chats):
    for fraction in (None, 0.5):
        with pytest.raises(ValueError, match="no chat can be trained on"):
            training_set(messages_of(chats([("User", "a")])), fraction, PLAIN, 100)


def test_split_of_files_stays(spark, tmp_path):
    lines = [chat_line(f"question {k}", f"answer {k}") for k in range(200)]
    first, second = tmp_path / "one", tmp_path / "other"
    first.mkdir()
    for part in range(4):
        (first / f"{part}.jsonl").write_text("\n".join(lines[part::4]) + "\n")
    shutil.copytree(first, second)

    def held(folder):
        rows = prepare(spark, str(folder), eval_fraction=0.2, profile=PLAIN).filter("split = 'eval'")
        return sorted(r.completion for r in rows.collect())

    before = held(first)
    assert len(before) == 40
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, "2048")
    try:
        assert held(second) == before
    finally:
        spark.conf.set(name, old)


def test_first_file_by_name_tells_the_format(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(chat_line("a", "b") + "\n")
    (tmp_path / "b.jsonl").write_text((json.dumps({"prompt": "p", "completion": "c"}) + "\n") * 500)
    assert detect_format(spark, str(tmp_path)) == "chat_jsonl"


def test_strict_names_the_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt": "p", "completion": "c"}\n\n{"prompt": "p"}\n')
    with pytest.raises(ValueError, match="missing_key: completion in .*a.jsonl, line 3"):
        read_pair_jsonl(spark, str(tmp_path / "a.jsonl"), strict=True)


def test_absent_split_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train")], "text string, split string")
    write_splits(rows, str(tmp_path / "s"))
    assert read_splits(spark, str(tmp_path / "s"), "train").count() == 1
    with pytest.raises(FileNotFoundError, match="test"):
        read_splits(spark, str(tmp_path / "s"))


def test_no_local_folder_on_a_cluster():
    assert local_folder("local[8]")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            local_folder(master)


def test_facts_are_repeated_by_the_places_of_a_chat(spark):
    rows = spark.range(10_000).selectExpr("0L AS chat_id", "id AS turn").unionByName(
        spark.range(50).selectExpr("id + 1 AS chat_id", "0L AS turn")
    )
    facts = spark.range(51).selectExpr("id AS chat_id", "id * 2 AS fact")
    for long_chats in (True, False):
        out = with_chat_facts(rows, facts, "turn", long_chats)
        assert out.count() == 10_050 and out.filter("fact <> chat_id * 2").isEmpty()


def test_training_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"prompt,completion\n" + b"".join(b"p%d , c%d\n" % (k % 8, k % 8) for k in range(12)))
    (tmp_path / "b.csv").write_bytes(b'prompt,completion\np9,"x\ny"\np1 , c1\nbad,\xff\n')
    path = str(tmp_path / "*.csv")
    rows = training_rows(spark, path, train_ratio=0.5).collect()
    assert {r.prompt for r in rows if r.split == "train"} == {f"p{k} " for k in range(4)}
    assert {r.text for r in rows} == {f"p{k}c{k}" for k in range(8)} | {"p9x\ny"}
    both = training_rows(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert sorted(r.prompt for r in both.filter("split = 'eval'").collect()) == ["p1 ", "p9"]
    (tmp_path / "c.csv").write_bytes(b"prompt,completion\nbad,\xff\n")
    with pytest.raises(ValueError, match="no rows on the eval side"):
        training_rows(spark, path, str(tmp_path / "c.csv"))


def test_one_funnel_counts_both_sides_without_a_scan_of_its_own(spark, tmp_path):
    from convprep.operators.report import Funnel

    (tmp_path / "train.csv").write_bytes(b'"prompt","completion"\n"a","b"\n"a","b"\n"c","\xff"\n"e","f"\n')
    (tmp_path / "eval.csv").write_bytes(b'"prompt","completion"\n"a","b"\n')
    funnel = Funnel()
    rows = training_rows(spark, str(tmp_path / "train.csv"), str(tmp_path / "eval.csv"), funnel=funnel)
    # The counts are there before the rows are asked for.
    report = {r["stage"]: r["n"] for r in funnel.report(spark).collect()}
    assert report == {"loaded": 5, "undecodable": 1, "invalid": 0, "unique": 3, "duplicate": 1}
    assert rows.count() == 3


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(k).getName() for k in range(files.size())]
    return {name for name in names if name.startswith("shuffle_")}


def test_stored_tables_leave_no_shuffle_files(spark):
    # Others may have set the session of all tests.
    other = spark.newSession()
    rows = other.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = shuffle_files(spark)
    table = stored(rows, "counts")
    assert not shuffle_files(spark) - before
    assert sum(r.n for r in table.collect()) == 5000
    # The setting is that of the session again, whether the session had one or not.
    assert other.conf.get(CLEANUP, None) is None
    other.conf.set(CLEANUP, "false")
    with pytest.raises(ZeroDivisionError), shuffles_freed(other):
        assert other.conf.get(CLEANUP) == "true"
        1 / 0
    assert other.conf.get(CLEANUP) == "false"


def test_numbers_of_rows_move_no_text(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    source = "named_struct('file', concat('f', id % 3), 'start', id % 2, 'row', id) AS source"
    rows = other.range(60).selectExpr(source, "concat('text ', id) AS prompt", "'' AS completion")
    placed = numbered(stored(rows, "rows"))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    order = lambda r: (r.source.file, r.source.start, r.source.row)
    got = placed.collect()
    assert [r.place for r in sorted(got, key=order)] == sorted(r.place for r in got) and len({r.place for r in got}) == 60


def test_pairs_twice_and_bad_lie_compressed_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "FILE_RECORDS", 4)
    texts = [(k, f"ask {k}\n" + f'é "{k}",\nline\n' * 40) for k in range(9)]
    spark.createDataFrame([*texts, (None, "no id\nx"), (3, "again\ny")], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    files = sorted(Path(queries._pairs_twice_and_bad(spark, str(tmp_path), packed=True)).glob("*.csv.gz"))
    assert len(files) >= 3 * 11 / 4
    raw = [gzip.decompress(f.read_bytes()) for f in files]
    assert sum(f.stat().st_size for f in files) < sum(map(len, raw)) / 4
    records = [r for data in raw for r in list(csv.reader(io.StringIO(data.decode("latin-1"), newline="")))[1:]]
    pairs = [(a.encode("latin-1"), b.encode("latin-1")) for a, b in records]
    assert pairs[:3] == [(b"no id", b"x"), (b"no id", b"x"), (b"no id", b"x\xff")]
    want = {k: tuple(part.encode() for part in text.split("\n", 1)) for k, text in texts}
    rest = [p for p in pairs[3:] if p[0] != b"again"]
    assert rest == [(a, b + tail) for a, b in want.values() for tail in (b"", b"", b"\xff")] and len(pairs) == 33
