import glob
import os
import re

import pytest

import __spark_entry__ as entry
from convprep.plans.oracles import ORACLES
from convprep.plans.queries import QUERIES
from checking import connect, spark_rows, sql_rows

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, small, con, name):
    got = spark_rows(entry.queries()[name](spark, small))
    assert got == sql_rows(con, entry.oracle_sql()[name])


def test_samples_plan(spark, small):
    """One shuffle, by chat and block; no Python and no task that takes everything."""
    plan = entry.queries()["training_samples"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1
    assert "hashpartitioning(chat_id" in plan
    assert "SinglePartition" not in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_no_cross_joins_or_python_in_native_plans(spark, small):
    for name in ("training_set", "split_exact", "chat_dedupe", "packed_blocks", "turns"):
        plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan, name


def test_sources_name_no_local_folders():
    for path in glob.glob(f"{ROOT}/convprep/**/*.py", recursive=True):
        if "/llm/" in path:
            continue
        text = open(path).read()
        assert "localCheckpoint" not in text and ".collect()" not in text, path
