"""The pipeline's stages by brute force, and its decisions on odd documents."""

from __future__ import annotations

import os
import re

import brute

import corpus_pipeline
from convprep.llm import language_id


def listed(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_stages_by_brute_force(spark, small, odd, tmp_path):
    for k, folder in enumerate((small, odd)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            before = listed(docs)
            if name != "byte-level BPE":
                assert out.columns == columns
                out.write.parquet(f"{tmp_path}/{k}-{name}")
                out = spark.read.parquet(f"{tmp_path}/{k}-{name}")
                after = listed(out)
                assert all(a in before for a in after)
            if name == "language ID":
                clean = [b for b in before if any(c.isalpha() for c in b[1] or "")]
                gone = [b for b in clean if b not in after]
                assert not gone or folder == odd
                assert not [a for a in after if a not in clean]
            elif name == "exact dedup":
                kept = [(i, s) for i, _, _, k0, s in brute.exact_groups(before) if k0]
                assert sorted(map(repr, kept)) == sorted(repr((a[0], brute.sha((a[1] or "").translate(brute.LOWER)))) for a in after)
            elif name == "n-gram Jaccard join":
                groups = brute.near_groups(before, 5, 80)
                dropped = {g[0] for g in groups if g[0] is not None and g[2] != g[0]}
                assert sorted(map(repr, after)) == sorted(repr(b) for b in before if b[0] not in dropped)
            elif name == "mixing":
                size = sum(len(brute.words(b[1])) for b in before)
                assert 0 < sum(len(brute.words(a[1])) for a in after) <= 0.8 * size
            else:
                got = {r["doc_id"]: r["decoded_sha256"] for r in out.collect()}
                assert got == {b[0]: brute.sha(b[1] or "") for b in before}
            docs = out


def test_run(spark, small):
    first = corpus_pipeline.run(spark, small)
    rows = first.collect()
    assert first.columns[0] == "doc_id" and len({r["doc_id"] for r in rows}) == len(rows) > 50
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)


def test_run_on_nothing(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_unknown_language_is_rejected(spark):
    rows = [(k, "the cat sat on the mat and looked at the dog " * 4, "en") for k in range(10)]
    rows += [(99, "жщъ" * 30, None), (98, "ж", None), (97, "жщ a", None), (96, "12 !", None), (95, None, None)]
    # The length of a text decides nothing.
    short = [(100, "A", None), (101, "I", None), (102, "at", None), (103, "O h", None), (104, "a ж", None), (104, "THE 9", None)]
    docs = spark.createDataFrame(rows + short, "doc_id bigint, text string, lang string")
    kept = language_id.in_known_language(docs)
    assert {r["doc_id"] for r in kept.collect()} == set(range(10)) | {100, 101, 102, 103, 104}
    assert kept.filter("doc_id = 104").count() == 2


def test_near_copies_go_by_row(spark):
    """A document stays though its namesake is a copy; of near copies that share an id one stays."""
    near = " ".join(f"w{k}" for k in range(200))
    rows = [(1, near), (2, near + " x"), (2, "something else that is a text of its own"), (3, near + " y"), (1, near + " z"), (None, near + " q"), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert (2, "something else that is a text of its own") in kept and (None, near + " q") in kept
    assert sorted(map(repr, (k for k in kept if k[0] in (2, 3, 4)))) == sorted(map(repr, [rows[2], (4, None), (4, "")]))
    assert len([k for k in kept if k[0] == 1]) == 1


def test_no_local_checkpoints():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder in (root, os.path.join(root, "convprep", "llm")):
        for name in os.listdir(folder):
            if name.endswith(".py"):
                assert not re.search(r"localCheckpoint|crossJoin", open(os.path.join(folder, name)).read()), name
