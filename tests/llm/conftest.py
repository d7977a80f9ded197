from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def rows_of_folder(spark):
    def read(folder):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]

    return read


@pytest.fixture(scope="session")
def odd(spark, small, tmp_path_factory):
    """Documents with nulls, empty and long texts, ties, repeated rows, near copies and clashing columns."""
    r = random.Random(5)
    base = [x["text"] for x in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    texts = [None, "", " \n\t ", "!!! 123", "Word", "word", "WORD", "É é", "it's we'll 'tis  x y　z", "a b c d", "a b c", "\U0001f600" * 40]
    texts += base[:12] + base[:6] + [base[0].upper(), base[1].swapcase()]
    for text in base[:10]:
        w = text.split(" ")
        for _ in range(3):
            v = list(w)
            for _ in range(max(1, len(v) // 60)):
                v[r.randrange(len(v))] = "edit" + str(r.randrange(9))
            texts.append(" ".join(v))
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [f"{a} {passage} {b}" for a, b in zip(base[10:20], base[20:30])]
    texts += ["go " * 500, "go " * 499 + "stop", " ".join(base) * 6, "x" * 5000]
    rows = []
    for k, text in enumerate(texts):
        rows.append((1000 - 3 * k, text, None if k % 7 == 0 else ["en", "fr", "de", "es"][k % 4], None if k % 5 == 0 else f"src{k % 3}", k))
    rows += [rows[14], rows[14], (None, "without an id", "en", "src1", 1), (None, base[3], None, None, None)]
    out = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(rows, SCHEMA)
    extra = docs.selectExpr("*", "'mine' AS kept", "1 AS n", "2 AS node", "'x' AS lang_pred", "array(1) AS ids", "3 AS epoch")
    extra.repartition(3).write.parquet(f"{out}/documents.parquet")
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<p>a&amp;b</p>"), (2, None, "")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{out}/pages.parquet")
    vectors = [(1, [0.5] * 64), (1, [0.5] * 64), (2, None), (None, [0.25] * 64), (3, [1.0])]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{out}/pages.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>").write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.fixture(params=["small", "odd"])
def folder(request):
    return request.getfixturevalue(request.param)
