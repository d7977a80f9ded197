"""CSV records of split files, against the csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from convprep.plans import queries
from convprep.plans.session import stored
from convprep.sources.csv_records import LINES, chunk_table, csv_records, file_lines, with_chunks
from convprep.sources.readers import accepted, read_pair_csv, read_prepared_csv


def session(spark, split):
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    other.conf.set("spark.sql.files.openCostInBytes", "1")
    return other


def random_pairs(rng, n):
    parts = ["a", '"', '""', "\n", "\r\n", ",", " ", "é", "word " * 9, "", "\n\n", '",', ',"']
    field = lambda: "".join(rng.choices(parts, k=rng.randrange(7)))
    return [(field(), field()) for _ in range(n)]


def written(pairs, header=True, end="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end, quoting=quoting)
    if header:
        w.writerow(["prompt", "completion"])
    w.writerows(pairs)
    return out.getvalue().encode()


@pytest.mark.parametrize("split", [7, 40, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_do_not_depend_on_the_splits(spark, tmp_path, split, end):
    rng = random.Random(split)
    expected = []
    for k in range(3):
        pairs = random_pairs(rng, 60)
        # A last record without a line end, and one that is longer than a split.
        pairs += [("x" * 50 + "\n" * 50, 'end "of" ' * 5)]
        data = written(pairs, end=end, quoting=csv.QUOTE_ALL if k else csv.QUOTE_MINIMAL)
        (tmp_path / f"{k}.csv").write_bytes(data[: -len(end)])
        expected += pairs
    small = session(spark, split)
    rows = read_prepared_csv(small, str(tmp_path))
    if split < 100:
        assert csv_records(small, str(tmp_path)).select("source.file", "source.start").distinct().count() > 20
    got = accepted(rows).orderBy("source.file", "source.start", "source.row").collect()
    assert [(r.prompt, r.completion) for r in got] == expected


def test_quotation_marks_inside_plain_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'5" pipe,b\nc"d""e,"f\ng"\n"h"i,j\n,"k"\n\n"l\n\n",m\n')
    expected = [('5" pipe', "b"), ('c"d""e', "f\ng"), ('"h"i', "j"), ("", "k"), ("l\n\n", "m")]
    for split in (5, 1000):
        rows = read_pair_csv(session(spark, split), str(tmp_path)).orderBy("source.start", "source.row")
        assert [(r.prompt, r.completion) for r in rows.collect()] == expected


def test_a_file_that_ends_inside_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,b\nc,"d\ne\nf')
    rows = csv_records(session(spark, 4), str(tmp_path)).orderBy("source.start", "source.row").collect()
    assert [r.value for r in rows] == ["a,b", 'c,"d\ne\nf']


def test_strict_errors_name_the_line(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,"b\n\nc"\nd,e\nonly\n')
    with pytest.raises(ValueError, match="missing_column in .*a.csv, line 5"):
        read_pair_csv(session(spark, 4), str(tmp_path), strict=True)


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    (tmp_path / "b.csv").write_bytes(b"\n\n")
    assert csv_records(spark, str(tmp_path)).count() == 0


def test_the_text_moves_once(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(written(random_pairs(random.Random(1), 20)))
    plan = csv_records(spark, str(tmp_path))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text.split("Initial Plan")[0]
    assert "CartesianProduct" not in final and "SinglePartition" not in final


@pytest.mark.parametrize("lines", [1, 2, 5])
def test_records_do_not_depend_on_the_chunks(spark, tmp_path, monkeypatch, lines):
    monkeypatch.setattr("convprep.sources.csv_records.LINES", lines)
    rng = random.Random(lines)
    expected = []
    for k in range(2):
        pairs = [("\n\n\n", "a\n" * 20), *random_pairs(rng, 40)]
        (tmp_path / f"{k}.csv").write_bytes(written(pairs, quoting=csv.QUOTE_ALL if k else csv.QUOTE_MINIMAL))
        expected += pairs
    got = accepted(read_prepared_csv(spark, str(tmp_path))).orderBy("source.file", "source.start", "source.row").collect()
    assert [(r.prompt, r.completion) for r in got] == expected


def test_no_text_is_ordered_by_file_or_compared_with_headers(spark, tmp_path):
    """One row for each chunk is; the records themselves meet by chunk, and parts of one record by its source."""
    (tmp_path / "a.csv").write_bytes(written(random_pairs(random.Random(2), 20)))
    plan = read_prepared_csv(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "windowspecdefinition(file#" in plan
    for window in plan.split("windowspecdefinition(")[1:]:
        assert window.split(",")[1].strip().startswith("start#")


def test_headers_after_empty_lines_and_over_several_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("convprep.sources.csv_records.LINES", 2)
    (tmp_path / "a.csv").write_bytes(b'\n\r\n"a\n\nb\n",c\nd,e\n')
    (tmp_path / "b.csv").write_bytes(b'f\n"g\n\n\nh",')
    rows = csv_records(spark, str(tmp_path), header=True).orderBy("source.file", "source.row").collect()
    assert [r.value for r in rows] == ["d,e", '"g\n\n\nh",']


def of_three_files(spark, small, tmp_path):
    """The documents of a folder in three files, which are three partitions."""
    documents = spark.read.parquet(f"{small}/documents.parquet")
    documents.repartition(3).write.parquet(f"{tmp_path}/in/documents.parquet")
    return f"{tmp_path}/in"


def test_no_task_writes_all_pairs(spark, small, tmp_path, monkeypatch):
    folder = of_three_files(spark, small, tmp_path)
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    queries.csv_split_ranges(spark, folder)
    assert len(list(tmp_path.glob("*-csv/part-*.csv"))) == 3


def test_ordered_pairs_are_written_by_as_many_tasks_as_the_session_says(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", "9")
    wide.conf.set("spark.sql.adaptive.enabled", "false")
    assert len(list(tmp_path.glob(queries._pairs_twice_and_bad(wide, small).split("/")[-1] + "/part-*.csv"))) == 9


def test_no_record_is_lost_when_the_splits_change_before_the_query(spark, tmp_path):
    pairs = [(f"p{k}\nq", f"c{k}") for k in range(3000)]
    (tmp_path / "a.csv").write_bytes(written(pairs, header=False))
    for built, run in ((3_000, 4_000), (4_000, 2_000)):
        own = session(spark, built)
        rows = accepted(read_pair_csv(own, str(tmp_path)))
        own.conf.set("spark.sql.files.maxPartitionBytes", str(run))
        got = rows.orderBy("source.start", "source.row").collect()
        assert [(r.prompt, r.completion) for r in got] == pairs


def test_chunks_of_other_splits_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(written([(f"p{k}", f"c{k}") for k in range(3000)], header=False))
    out = [F.lit(False).alias("out"), F.lit(True).alias("into")]
    place = ["source.file", "source.start", F.expr(f"source.row div {LINES}").alias("part"), "source.row", "value"]
    lines = {n: file_lines(session(spark, n), str(tmp_path)).select(*place, *out) for n in (2_000, 3_000)}
    chunks = {n: stored(chunk_table(lines[n]), "chunks") for n in lines}
    for n in lines:
        assert with_chunks(lines[n], chunks[n]).count() == 3000
    for n, other in ((2_000, 3_000), (3_000, 2_000)):
        with pytest.raises(Exception, match="the splits changed"):
            with_chunks(lines[n], chunks[other]).count()


def test_the_lines_of_one_split_meet_in_many_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\n" * 64 * LINES)
    wide = session(spark, 1 << 30)
    wide.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    wide.conf.set("spark.sql.shuffle.partitions", "8")
    wide.conf.set("spark.sql.adaptive.enabled", "false")
    shares = csv_records(wide, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in shares) == 64 * LINES
    assert max(r["count"] for r in shares) < 32 * LINES
