"""License scans, spelling variants and centroid clusters against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from convprep.llm import centroid_clusters, common, license_scan, spelling_variants
from convprep.llm.queries import QUERIES

RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---------------------------------------------------------------- license scans


def base_places(text):
    words = RUN.findall((text or "").translate(brute.LOWER))
    places = []
    for label, phrase in license_scan.BASE:
        p = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    return words, places


def within(text, pattern, edits, starts):
    """Ends of the slices of the text that begin in ``starts`` and are at most ``edits`` from the pattern."""
    rows = {s: 0 for s in starts}
    for s in list(rows):
        rows[s] = 0
    # cost[e]: least edits between the pattern so far and a slice that ends at e.
    cost = [rows.get(e, 99) for e in range(len(text) + 1)]
    for e in range(1, len(cost)):
        cost[e] = min(cost[e], cost[e - 1] + 1)
    for c in pattern:
        new = [cost[0] + 1]
        for e in range(1, len(cost)):
            new.append(min(cost[e] + 1, new[e - 1] + 1, cost[e - 1] + (text[e - 1] != c)))
        cost = new
    return {e for e, n in enumerate(cost) if n <= edits}


def notice_found(stream, phrase):
    """Whether a notice stands in a word stream: names unchanged, edits in the runs of other words."""
    runs = []
    for w in phrase.split():
        named = w in license_scan.NAMES or w.isdigit()
        if not runs or runs[-1][0] != named:
            runs.append((named, []))
        runs[-1][1].append(w)
    ends = set(range(len(stream) + 1))
    for k, (named, words) in enumerate(runs):
        run = " ".join(words)
        if named:
            run = f" {run} "
            ends = {e + len(run) for e in ends if stream.startswith(run, e)}
        else:
            run = " " * (k == 0) + run + " " * (k == len(runs) - 1)
            ends = within(stream, run, min(len(run) // license_scan.PER_EDIT, license_scan.MOST_EDITS), ends)
    return bool(ends)


def expected_scan(doc_id, text):
    words, places = base_places(text)
    stream = " " + " ".join(words) + " " if words else " "
    labels = {label for label, phrase in license_scan.NOTICES if notice_found(stream, phrase)}
    starts = [k for k, _ in places]
    base = ",".join(sorted({label for _, label in places}))
    assert {label for _, label in places} <= labels
    return (doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), base, ",".join(sorted(labels)))


COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")


def test_base_places_of_whole_tables(spark, folder, rows_of_folder):
    found = QUERIES["op11_license_scan"](spark, folder).collect()
    expected = Counter()
    for doc_id, text, *_ in rows_of_folder(folder):
        words, places = base_places(text)
        starts = [k for k, _ in places]
        labels = ",".join(sorted({x for _, x in places}))
        expected[(doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), labels)] += 1
    assert Counter(tuple(r[c] for c in COLUMNS[:-1]) for r in found) == expected
    for r in found:
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") and (r["n_base"] == 0 or r["score"] == 1)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abcdeilnstu é-")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("abcdeilnstu é-"))
    return "".join(out)


def notices_with_edits():
    rng = random.Random(7)
    words = "the of a license version public by 2 3 mit cc under apache general naïve x".split()
    texts = [None, "", " ", "under the mit license", "UNDER  the\nMIT-License under the mit license", "cc by nc cc by nc"]
    texts += ["under themit license", "under the mitt license", "under the mot license", "GNU Lesser GPL", "apache license, version 2.0"]
    for _, phrase in license_scan.NOTICES:
        for edits in range(0, 7):
            before, after = (" ".join(rng.choices(words, k=rng.randrange(4))) for _ in "ab")
            texts.append(f"{before} {edited(rng, phrase, edits)} {after}")
    return list(enumerate(texts))


@pytest.mark.parametrize("piece", [common.PIECE, 40])
def test_notices_with_edits(spark, piece, monkeypatch):
    rows = notices_with_edits()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, matches string, n_words int").coalesce(1)
    expected = Counter(expected_scan(i, t) for i, t in rows)
    assert sum(e[-1] != e[-2] for e in expected) > 20
    monkeypatch.setattr(license_scan, "pieces", lambda data, offs: common.pieces(data, offs, piece))
    found = license_scan.scan(docs).select("doc_id", "n_words", *license_scan.digest_columns())
    assert Counter(tuple(r[c] for c in COLUMNS) for r in found.collect()) == expected


def test_a_text_over_a_piece(spark):
    text = "word " * 300_000 + "Relased under the MIT licence " + "é " * 10
    found = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert found["n_words"] == 300_015 and [(m["label"], m["first_word"], m["last_word"], m["edits"], m["found"]) for m in found["matches"]] == [
        ("mit", 300_001, 300_004, 1, "under the mit licence")
    ]


# ---------------------------------------------------------------- spelling variants


def spelled_words(docs):
    counts = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def spelling(docs):
    n = spelled_words(docs)
    near = {w: [] for w in n}
    holes = {}
    for w in n:
        # Words one edit apart share a form with one place left open.
        for k in range(len(w) + 1):
            holes.setdefault((w[:k], w[k:]), set()).add(w)
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    for group in holes.values():
        for a in group:
            near[a] += [b for b in group if one_edit(a, b)]
    near = {w: set(v) for w, v in near.items()}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = Counter()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[(w, form[w], root, n[w], len(near[w]), n.get(form[w]))] += 1
    return out


@pytest.fixture(scope="module")
def misspelt(spark, tmp_path_factory):
    """Texts with many words that differ in a few places, some with one long common beginning."""
    rng = random.Random(11)
    words = []
    for stem in ("aaaaaaaaaa", "bcdbcd", "éàüéàüß", "a" * 40):
        for _ in range(60):
            w = stem
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w) + 1)
                w = w[:k] + rng.choice(["", "a", "b", "é", "ÿ", "×"]) + w[k + rng.randrange(2) :]
            words.append(w)
    text = lambda: " ".join(rng.choices(words, k=400))
    rows = [(k, text()) for k in range(40)] + [(k, " ".join(["Aaaaaaaaaa"] * 700)) for k in range(2)] + [(None, text()), (7, None), (8, "")]
    out = str(tmp_path_factory.mktemp("misspelt"))
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n", "'x' AS word", "2 AS form").write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("block", [2048, 4])
def test_spelling_variants(spark, misspelt, block, monkeypatch):
    monkeypatch.setattr(spelling_variants, "BLOCK_WORDS", block)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{misspelt}/documents.parquet").collect()]
    expected = spelling(docs)
    found = QUERIES["op12_spelling_variants"](spark, misspelt)
    assert Counter(tuple(r) for r in found.collect()) == expected
    assert any(e[2] != e[0] and e[2] != e[1] for e in expected)


def test_spelling_variants_of_documents(spark, folder, rows_of_folder):
    found = QUERIES["op12_spelling_variants"](spark, folder)
    assert Counter(tuple(r) for r in found.collect()) == spelling(rows_of_folder(folder))


def test_counts_are_passed_on(spark, misspelt, monkeypatch):
    docs = spark.read.parquet(f"{misspelt}/documents.parquet")
    whole = Counter(map(tuple, spelling_variants.vocabulary(docs).collect()))
    monkeypatch.setattr(spelling_variants, "HELD_WORDS", 3)
    assert Counter(map(tuple, spelling_variants.vocabulary(docs).collect())) == whole


def test_rows_of_a_hot_block_grow_with_its_words(spark, monkeypatch):
    """Words with one common half are dealt anew, not paired."""
    monkeypatch.setattr(spelling_variants, "BLOCK_WORDS", 8)
    sizes = []
    for n in (200, 400, 800):
        words = spark.createDataFrame([("common" + f"{k * 7919 % 10**6:06}".translate(str.maketrans("0123456789", "abcdefghij")), 5) for k in range(n)], "word string, n bigint")
        sizes.append(sum(rows.count() for rows in spelling_variants.blocks(words)))
    assert sizes[2] <= 5 * max(sizes[0], 200)


# ---------------------------------------------------------------- centroid clusters


def clusters(rows):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:8]]

    def assign():
        out = []
        for i, v in kept:
            out.append((i, v, *min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))))
        return out

    for _ in range(10):
        members = {}
        for _, v, _, k in assign():
            members.setdefault(k, []).append(v)
        for k, vs in members.items():
            centroids[k] = [sum(column) // len(vs) for column in zip(*vs)]
    final = assign()
    inertia = Counter()
    for _, _, d, k in final:
        inertia[k] += d
    sha = [brute.sha(",".join(map(str, c))) for c in centroids]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), sha[k]) for i, _, d, k in final)


VECTOR_COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def odd_vectors():
    rng = random.Random(13)
    rows = [(k, [rng.gauss(k % 5 / 4, 0.3) for _ in range(64)]) for k in range(150)]
    rows += [rows[3]] * 40 + [(7, rows[9][1]), (None, rows[8][1]), (None, None), (500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65)]
    rows += [(504, [None] + [0.0] * 63), (505, [float("nan")] + [0.0] * 63), (506, [float("inf")] * 64), (507, [-float("inf")] + [0.0] * 63)]
    return rows + [(508, [-0.0] * 64), (509, [1e-9, -1e-9] * 32), (510, [99999.5, -99999.5] * 32)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_of_odd_vectors(spark, kind):
    rows = odd_vectors()
    vectors = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").selectExpr("*", "1 AS cluster", "2 AS v", "3 AS distance")
    exact = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    found = centroid_clusters.cluster(vectors.repartition(5))
    assert Counter(tuple(r[c] for c in VECTOR_COLUMNS) for r in found.collect()) == clusters(exact)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = [(k, [float(k)] * 64) for k in range(n)]
    found = centroid_clusters.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    assert Counter(tuple(r[c] for c in VECTOR_COLUMNS) for r in found.collect()) == clusters(rows)


def test_too_large_a_component_is_an_error(spark):
    rows = [(1, [200000.0] * 64)]
    with pytest.raises(Exception, match="a component is"):
        centroid_clusters.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(3)
    spots = rng.integers(-2000, 2000, (8, 64))
    x = spots[rng.integers(0, 8, 2000)] + rng.integers(-30, 30, (2000, 64))
    pivots, centroids = x[:8], spots
    nearest = centroid_clusters.Nearest(pivots, centroids)
    far = np.sqrt(np.stack([centroid_clusters.squared(x, p) for p in pivots], 1).astype(float))
    exact = np.stack([centroid_clusters.squared(x, c) for c in centroids], 1)
    assert (nearest.bounds(far) <= exact).all()
    cluster, best, taken = nearest.assign(x, far)
    assert (cluster == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert taken < 0.6 * exact.size
