"""Each operator's query against brute force, on generated documents and on odd ones."""

from __future__ import annotations

import base64
import random
import zlib
from collections import Counter

import brute
import pytest
import tiktoken
from pyspark.sql import functions as F

from checking import connect, spark_rows, sql_rows
from convprep.llm import bpe, fingerprints, html_text, jaccard_join, language_id, lm_scoring, mixing, sharding, substring_dedup
from convprep.llm.queries import ORACLES, QUERIES


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, name):
    assert spark_rows(QUERIES[name](spark, small)) == sql_rows(connect(small), ORACLES[name])


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_join(spark, folder, rows_of_folder, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", block)
    found = QUERIES["op1_jaccard_join"](spark, folder)
    assert rows(found, "doc_id", "n_shingles", "component_id") == Counter(brute.near_groups(rows_of_folder(folder), 4, 85))


def test_language_id(spark, folder, rows_of_folder):
    docs = rows_of_folder(folder)
    found = QUERIES["op2_language_id"](spark, folder).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(d[0] for d in docs)
    texts = {}
    for d in docs:
        texts.setdefault(d[0], []).append(d)
    right = total = 0
    for r in found:
        assert 0 <= r["score"] <= 1 and r["held_out"] == brute.is_held_out(r["doc_id"], 0)
        mine = texts[r["doc_id"]]
        letters = [any(c.isalpha() for c in d[1] or "") for d in mine]
        if not any(letters):
            assert r["lang_pred"] == "und" and r["score"] == 0
        elif all(letters):
            assert r["lang_pred"] != "und"
            total += r["held_out"]
            right += r["held_out"] and r["lang_pred"] == mine[0][2]
    if "sf0" in folder:
        assert right >= 0.97 * total > 0


def labelled_scripts(spark):
    """Seventy labels with letters of their own, rarer and rarer."""
    rows, rng = [], random.Random(3)
    for k in range(70):
        letters = [chr(0x4E00 + 64 * k + i) for i in range(40)]
        rows += [(1000 * k + n, "".join(rng.choices(letters, k=60)), f"l{k:02}") for n in range(75 - k)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_every_label_is_learnt(spark):
    found = language_id.identify(labelled_scripts(spark)).collect()
    assert [(r["lang"], r["lang_pred"]) for r in found if r["lang_pred"] != r["lang"]] == []


def test_languages_in_groups(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("lang_pred")
    whole = rows(language_id.identify(docs), "doc_id", "lang_pred", "score", "phrase_bytes")
    monkeypatch.setattr(language_id, "TABLE_BYTES", 1)
    assert rows(language_id.identify(docs), "doc_id", "lang_pred", "score", "phrase_bytes") == whole


def test_phrases_are_longest_matches():
    parser = language_id.Parser({"x": b"abcabd\0ab"})
    for text in (b"abcabdab", b"abdabc", b"zz", b"", b"abcabcabcabd\0abz"):
        count, at = 1, 0
        for k in range(len(text)):
            if text[at : k + 1] not in b"abcabd\0ab":
                count, at = count + 1, k if text[k : k + 1] in b"abcabd\0ab" else k + 1
        import numpy as np

        got = parser.phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0, 0]
        assert got == (count if text else 0)


def test_bpe(spark, folder, rows_of_folder):
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for doc_id, text, *_ in rows_of_folder(folder):
        ids = other.encode_ordinary(text or "")
        expected[(doc_id, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text or ""))] += 1
    assert rows(QUERIES["op3_bpe"](spark, folder), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected


def test_bpe_offsets(spark):
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = spark.createDataFrame([(1, "it's déjà vu"), (2, None)], "doc_id bigint, text string")
    tokens = {r["doc_id"]: r for r in bpe.encode(docs, ranks).collect()}
    assert tokens[1]["ends"][-1] == len("it's déjà vu".encode()) and tokens[2]["ids"] == []


PAGE = """<html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><a href=x>Home</a> <a href=y>More</a></nav>
<div class="cookie-notice">We use cookies on this site to make it better for all of you, please accept.</div>
<div class="content"><h2>Title &amp; more</h2><p>First   paragraph with enough words to be seen as text &mdash; and <b>bold</b> parts.
<p>Second one, <a href=z>with a link</a>, also long enough for it.<br>Third line<ul><li>point one<li>point two</ul></div>
<div id="comments"><p>A reader writes a long comment here that must not be in the result at all.</p></div>
<form><p>Name</p><input></form><script>var a = "<p>no</p>";</script><footer>&copy; 2020 Site, all rights reserved</footer></body></html>"""


def test_html_text(spark, small, odd):
    from convprep.llm.html_text import main_text

    assert main_text(PAGE) == (
        "Title & more First paragraph with enough words to be seen as text — and bold parts. "
        "Second one, with a link, also long enough for it. Third line point one point two"
    )
    assert main_text("<article><h1>A</h1><p>b</article><p>c</p>") == "A b"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    found = QUERIES["op4_html_text"](spark, small).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(found) == len(pages)
    for r in found:
        assert r["text"] == main_text(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) > 0
        assert r["text"] == " ".join(r["text"].split()) and "<" not in r["text"]
    assert rows(QUERIES["op4_html_text"](spark, odd), "page_id", "text") == Counter({(1, ""): 1, (2, ""): 2, (None, "a&b"): 1})


def test_excluded_lines_do_not_part_an_article():
    body = "".join(f"<p>{'A sentence of the article that is long enough to surge. ' * 8}{k}</p>" for k in range(3))
    advert = "<aside><p>Buy</p><p>this</p><p>now</p></aside>"
    text = html_text.main_text(f"<html><body>{body}{advert}<p>A short end.</p></body></html>")
    assert text.endswith("A short end.") and "Buy" not in text


def test_linked_lines_of_a_marked_article_stay():
    page = "<html><body><article><h1><a href='x'>Title</a></h1><p>Text of it.</p><p><a href='y'>Source</a></p></article></body></html>"
    assert html_text.main_text(page) == "Title Text of it. Source"


@pytest.mark.parametrize(
    "page, text",
    [
        ('<body><div class="site has-sidebar"><article><p>One.</p></article><div class="sidebar"><p>Side</p></div></div>', "One."),
        ('<body class="modal-open"><div class="content-area no-sidebar"><p>Text one of it.</p><p>Two.</p></div>', "Text one of it. Two."),
        ('<div id="page" class="widget"><main><p>Main text.</p></main></div><div class="widget"><p>Side</p></div>', "Main text."),
        ('<form id="aspnet"><div class="menu"><p>Home</p></div><div><p>A long text in a form around the page.</p></div></form>', "A long text in a form around the page."),
        ('<article><section data-title="The hidden life"><p>Told.</p></section><p hidden>no</p><p hidden="">no</p></article>', "Told."),
        ('<article><h2 class="related">Related work</h2><p>Body.</p><div class="related-posts"><p>Other</p></div></article>', "Related work Body."),
        ('<div><p>A first sentence of text.</p><p><a href="x">A line that is a link</a></p><p>A second sentence.</p></div>', "A first sentence of text. A line that is a link A second sentence."),
        ('<article><p>Short.</p></article><div id="comments"><article class="comment"><p>' + "A long comment. " * 30 + "</p></article></div>", "Short."),
        ('<div class="post"><p>The post itself is here.</p></div><div class="comments"><article class="comment"><p>' + "A comment. " * 30 + "</p></article></div>", "The post itself is here."),
    ],
)
def test_doubtful_elements_are_judged_by_the_page(page, text):
    assert html_text.main_text(page) == text


def generated_page(rng):
    """A page that knows its article: containers with names that tell a state, marked and unmarked."""
    words = "stone river light under cold morning they walked slowly toward another village".split()
    sentence = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    blocks = [sentence(rng.randrange(12, 60)) for _ in range(rng.randrange(2, 7))]
    marked = rng.random() < 0.5
    state = rng.choice(["has-sidebar", "no-sidebar", "with-widget", "modal-open", "page wrap", "search-enabled"])
    body = "".join(f"<{t}>{b}</{t}>" for t, b in zip(rng.choices(["p", "li", "blockquote", "h3"], k=len(blocks)), blocks))
    body = f"<article>{body}</article>" if marked else f'<div class="{rng.choice(["text", "post-body", "entry"])}">{body}</div>'
    menu = "".join(f"<li><a href=/{k}>{rng.choice(words)}</a></li>" for k in range(6))
    side = rng.choice(["sidebar", "related-posts", "widget-area", "newsletter-signup", "ad-box"])
    after = rng.choice(['<section id="comments"><p>{}</p></section>', '<div class="comment-list"><div><p>{}</p></div></div>']).format(sentence(90))
    page = f"""<html><head><title>x</title></head><body class="{state}"><div class="site {state}"><header><h1>Site</h1><ul>{menu}</ul></header>
    <nav><ul>{menu}</ul></nav><div id="main" class="{state}">{body}</div><div class="{side}"><p>{sentence(8)}</p></div>{after}</div>
    <form><label>{sentence(3)}</label></form><footer><p>{sentence(10)}</p></footer></body></html>"""
    return page, " ".join(blocks)


def test_pages_that_know_their_article():
    rng = random.Random(17)
    for _ in range(400):
        page, text = generated_page(rng)
        assert html_text.main_text(page) == text, page


def test_sharding(spark, folder, rows_of_folder):
    docs = rows_of_folder(folder)
    found = QUERIES["op5_sharding"](spark, folder).collect()
    sized = Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == sized
    counts = Counter(r["shard"] for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s, n in counts.items():
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(n))


def test_one_more_shard_moves_few(spark, small):
    docs = sharding.sized(spark.read.parquet(f"{small}/documents.parquet"))
    for slack, most in ((0.0, 0.35), (0.3, 0.25)):
        a = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 8, slack=slack).collect()}
        b = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 9, slack=slack).collect()}
        assert sum(a[k] != b[k] for k in a) <= most * len(a)
        assert max(Counter(a.values()).values()) <= int(len(a) * (1 + slack) / 8) + 1


def test_exact_dedup(spark, folder, rows_of_folder):
    found = QUERIES["op6_exact_dedup"](spark, folder)
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(found, *columns) == Counter(brute.exact_groups(rows_of_folder(folder)))


@pytest.mark.parametrize("crowd", [4096, 1])
def test_substring_dedup(spark, folder, rows_of_folder, crowd, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    found = QUERIES["op7_substring_dedup"](spark, folder)
    expected = Counter(brute.without_passages(rows_of_folder(folder)))
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == expected


def test_lm_scoring(spark, folder, rows_of_folder):
    found = QUERIES["op8_lm_scoring"](spark, folder).collect()
    expected = brute.base_scores(rows_of_folder(folder))
    better = 0
    for r in found:
        base = expected[(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"])]
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r["score"] <= 0 and r["held_out"] == brute.is_held_out(r["doc_id"], 1)
        better += r["score"] > r["base_score"]
    assert better > 0.5 * len(found) or "sf0" not in folder


@pytest.mark.parametrize("units, hot, entries", [(1 << 20, 1 << 14, 1 << 23), (300, 300, 20000), (2, 2, 1 << 23)])
def test_lm_scoring_counts_all_pairs(spark, small, rows_of_folder, units, hot, entries, monkeypatch):
    monkeypatch.setattr(lm_scoring, "UNITS", units)
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    monkeypatch.setattr(lm_scoring, "ENTRIES", entries)
    monkeypatch.setattr(lm_scoring, "SHARDS", 3)
    docs = rows_of_folder(small)
    found = QUERIES["op8_lm_scoring"](spark, small).collect()
    scores = brute.pair_scores(docs, lm_scoring.STEPS, lm_scoring.PRIOR)
    equal = sum(r["score"] == pytest.approx(scores[r["doc_id"]], rel=1e-6) for r in found)
    # A filter may take a pair for held that is not.
    assert len(found) == len(docs) and equal >= 0.97 * len(docs)


def test_filter_gives_the_steps_of_its_pairs():
    import numpy as np

    keys, counts = np.arange(500, dtype=np.uint64) * np.uint64(977), np.arange(1, 501, dtype=np.int64)
    held = lm_scoring.filled(keys, counts)
    assert (lm_scoring.probed(held, keys) == lm_scoring.steps_of(counts)).all()
    assert (lm_scoring.probed(held, keys + np.uint64(1 << 40)) == 0).mean() > 0.99


def test_fingerprints(spark, folder, rows_of_folder):
    docs = rows_of_folder(folder)
    found = QUERIES["op9_fingerprints"](spark, folder)
    assert rows(found, "doc_id", "n_chars", "edited_sha256") == Counter(brute.edited_texts(docs))
    prints = {}
    for r in found.collect():
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    same = {}
    for d in docs:
        if len(prints[d[0]]) == 1:
            assert same.setdefault(d[1] or "", prints[d[0]]) == prints[d[0]]


@pytest.mark.parametrize("size", [3, 1 << 30])
def test_fingerprints_do_not_depend_on_ranges(spark, odd, rows_of_folder, size, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
    found = QUERIES["op9_fingerprints"](spark, odd)
    assert rows(found, "doc_id", "n_chars", "edited_sha256") == Counter(brute.edited_texts(rows_of_folder(odd)))


def scrambled(x):
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 % 2**64
    return x ^ x >> 32


def plain_winnow(text):
    """Fingerprints of a text in plain numbers: {(hash, position)}."""
    gram, window, bits = fingerprints.GRAM, fingerprints.WINDOW, fingerprints.PLACE_BITS
    factors = lambda n, seed: [scrambled((k + seed * 0x9E3779B97F4A7C15) % 2**64) | 1 for k in range(1, n + 1)]
    points = [scrambled(ord(c) + 1) for c in text]
    if not points:
        return []
    if len(points) < gram:
        h = [scrambled(sum(p * f for p, f in zip(points, factors(len(points), 5))) % 2**64)]
    else:
        one, two, four = factors(3, 3)
        value = lambda g: sum(p * (one if not k & 1 else 1) * (two if not k & 2 else 1) * (four if not k & 4 else 1) for k, p in enumerate(g))
        h = [scrambled(value(points[k : k + gram]) % 2**64) for k in range(len(points) - gram + 1)]
    h = [x >> bits for x in h]
    width, out = min(window, len(h)), []
    for k in range(len(h) - width + 1):
        low = min(h[k : k + width])
        at = max(i for i in range(k, k + width) if h[i] == low)
        if (at, low) not in out[-1:]:
            out.append((at, low))
    return out


def alike(a, b):
    a, b = ({h for _, h in x} for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_by_brute_force(spark, folder, rows_of_folder):
    docs = [d for d in rows_of_folder(folder) if len(d[1] or "") < 3000]
    table = spark.createDataFrame([(d[0], d[1]) for d in docs], "doc_id bigint, text string")
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    text = lambda prints: " ".join(f"{p}:{h:010x}" for p, h in prints)
    expected = Counter()
    for k, d in enumerate(order):
        mine, after = d[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(mine) // 2
        own, changed, other = (plain_winnow(t) for t in (mine, mine[: len(mine) - half] + after[:half], after))
        expected[(d[0], text(own), text(changed), alike(own, changed), alike(own, other))] += 1
    found = fingerprints.compared_with_next(table)
    assert rows(found, "doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next") == expected


def test_half_of_a_short_text_is_found(spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    for size in (32, 48, 64, 90):
        for text in [t[:size] for t in texts if len(t) >= size]:
            half = size // 2
            mine, edited = (fingerprints.winnow(fingerprints.points_of(t))[0] for t in (text, text[:-half] + "~" * half))
            assert set(mine.tolist()) & set(edited.tolist()), text


def test_winnowing(spark, small, monkeypatch):
    texts = ["", "a", "abcdefghijklmnop" * 30, "a" * 300]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(3).collect()]
    for text in texts:
        points = fingerprints.points_of(text)
        h = [int(x) >> fingerprints.PLACE_BITS for x in fingerprints.gram_hashes(points)]
        width, expected = min(fingerprints.WINDOW, len(h)), []
        for i in range(len(h) - width + 1 if h else 0):
            low = min(h[i : i + width])
            at = max(k for k in range(i, i + width) if h[k] == low)
            if (low, at) not in expected[-1:]:
                expected.append((low, at))
        whole = list(zip(*[x.tolist() for x in fingerprints.winnow(points)]))
        assert whole == expected
        monkeypatch.setattr(fingerprints, "BLOCK", 64)
        assert list(zip(*[x.tolist() for x in fingerprints.winnow(points)])) == expected
        monkeypatch.undo()


def test_mixing(spark, folder, rows_of_folder):
    docs = rows_of_folder(folder)
    tokens = {}
    for d in docs:
        tokens.setdefault(d[0], []).append(len(brute.words(d[1])))
    found = QUERIES["op10_mixing"](spark, folder).collect()
    total = sum(sum(t) for t in tokens.values())
    assert sum(r["n_tokens"] for r in found) <= total * 0.6
    assert all(r["n_tokens"] in tokens[r["doc_id"]] and r["epoch"] in (0, 1) for r in found)
    leaves = Counter((r["domain"], r["lang"], r["source"]) for r in found)
    assert len(leaves) > 3


def test_shortages_go_to_siblings_first(spark):
    """A source that can't fill its share leaves it to its language, not to other languages."""
    leaves = spark.createDataFrame(
        [("domain0", "de", "a", 10), ("domain0", "de", "b", 1000), ("domain0", "fr", "c", 1000)],
        "domain string, lang string, source string, tokens bigint",
    )
    from pyspark.sql import functions as F

    quotas = {r["source"]: r["quota"] for r in mixing.leaf_quotas(leaves, F.lit(400), 1).collect()}
    assert quotas == {"a": 10, "b": 190, "c": 200}
    quotas = {r["source"]: r["quota"] for r in mixing.leaf_quotas(leaves, F.lit(2005), 1).collect()}
    assert sum(quotas.values()) == 2005 and quotas["a"] == 10
