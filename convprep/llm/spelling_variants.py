"""Spelling variants: words one edit apart, grouped under the frequent form.

Words of neighbouring lengths share a block if they share what surrounds one
window of their characters: an edit lies in one window and leaves the rest of
the word as it is.  In a block, the product of the matrix of letter counts with
its transpose gives all squared distances at once; an edit changes the counts
by a squared distance of two at most, so only such pairs are compared as words.

Words have two windows, their halves.  The words of a block over ``BLOCK_WORDS``
are dealt anew by the halves of its window, until the blocks are small or the
window is one character: such a block holds words that differ there by a letter
or two, so it is bounded by the letters.  So no block's work grows with the vocabulary, and
each pair counts once, in the window of its first difference.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convprep.llm.common import LOWER, UPPER, bounded_batches, stored, table

#: Runs of letters.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Characters of a word and its occurrences, at least.
SHORTEST, LEAST = 6, 5
#: One run in so many loses a character, by the digest of its document and itself.
DELETED = 199
#: How many times as frequent a form is, at least.
RATIO = 5
#: Different words that a task counts before it passes the counts on.
HELD_WORDS = 200_000
#: Words of a block whose distances are taken at once; larger blocks are dealt anew.
BLOCK_WORDS = 2048
#: Letter counts of a word; other letters share the last ones.
COUNTS = 32
#: Rounds of following forms two, four, ... steps; each step multiplies the occurrences by RATIO, so 2^5 steps exceed a long.
ROUNDS = 5

_LOWER = str.maketrans(UPPER, LOWER)


# ---------------------------------------------------------------- words


def spelled(doc_id: object, runs: Counter[str]) -> Iterator[tuple[str, int]]:
    """The runs of a document with their occurrences, with the deletion that falls on some of them."""
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), before)
        if h % DELETED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= SHORTEST:
            yield run, n


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words that are long and frequent enough.

    A null text has no words; a null id counts as empty.  Texts of any length
    are read whole.  Rows that repeat count each.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                whole = t.as_py() or ""
                lower = whole.lower() if whole.isascii() else whole.translate(_LOWER)
                for word, n in spelled(i.as_py(), Counter(RUN.findall(lower))):
                    counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield counted(counts)
                    counts.clear()
        yield counted(counts)

    partial = docs.select(doc_id, text).mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def counted(counts: Counter[str]) -> pa.RecordBatch:
    columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n"])


# ---------------------------------------------------------------- blocks


def dealt(words: DataFrame) -> DataFrame:
    """Each word in the blocks of a window: (size, low, high) and the characters around it.

    ``size`` is the length of the shorter word of a pair, so a word is in the
    blocks of its own length and of the length before.
    """
    around = F.xxhash64(
        F.expr("substring(word, 1, low)"),
        F.expr("substring(word, length + high - size + 1, size - high)"),
    )
    return words.withColumn("around", around)


def halves(words: DataFrame) -> DataFrame:
    """Rows with a window (low, high) once for each of its halves."""
    middle = F.expr("cast((low + high) div 2 as int)")
    windows = F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")),
        F.struct(middle.alias("low"), F.col("high").alias("high")),
    )
    kept = [c for c in words.columns if c not in ("low", "high", "around")]
    return words.select(*kept, F.explode(windows).alias("window")).select(*kept, "window.low", "window.high")


BLOCK = ["size", "low", "high", "around"]


def sized(rows: DataFrame) -> DataFrame:
    """The rows of blocks that hold a pair, with the number of words of the block.

    A block needs a word of its size; counts come first, so words alone in a block go no further.
    """
    own = F.count(F.when(F.col("length") == F.col("size"), 1))
    counts = rows.groupBy(*BLOCK).agg(F.count("*").alias("words"), own.alias("own")).filter("words > 1 and own > 0")
    return rows.join(counts.drop("own"), BLOCK)


def blocks(words: DataFrame) -> list[DataFrame]:
    """Tables of blocks of at most ``BLOCK_WORDS`` words, or of windows of one character."""
    size = F.explode(F.array(F.col("length"), F.col("length") - 1))
    start = words.withColumn("length", F.length("word")).select("*", size.alias("size"))
    # The words of the shortest length have no shorter partners.
    start = start.filter(F.col("size") >= SHORTEST).withColumns({"low": F.lit(0), "high": F.col("size")})
    rows, out = start, []
    while True:
        found = stored(sized(dealt(halves(rows))), "blocks")
        small = (F.col("words") <= BLOCK_WORDS) | (F.col("high") - F.col("low") <= 1)
        out.append(found.filter(small))
        rows = found.filter(~small).drop("words", "around")
        if rows.isEmpty():
            return out


# ---------------------------------------------------------------- distances


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
    letters = np.where(points < 128, points - 97, 26 + points % (COUNTS - 26))
    flat = np.bincount(np.repeat(np.arange(len(words)), sizes) * COUNTS + letters, minlength=len(words) * COUNTS)
    return flat.reshape(len(words), COUNTS).astype(np.float64)


def first_difference(a: str, b: str) -> int:
    """Where two words part."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def near_in_window(a: str, b: str, low: int, high: int) -> bool:
    """Whether one edit, whose first difference is in the window, makes ``a`` of ``b``; ``a`` is not the longer one."""
    at = first_difference(a, b)
    if not (low <= at < high or at == high == len(a)):
        return False
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def near_pairs(words: list[str], keys: np.ndarray, windows: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Numbers of the words of near pairs of one block; ``keys`` rise from block to block.

    The product is taken for strips of rows and the words of their blocks.
    """
    counts = letter_counts(words)
    squares = (counts * counts).sum(1)
    lengths = np.array([len(w) for w in words])
    sizes = np.array([w[0] for w in windows])[keys]
    ends = np.searchsorted(keys, keys, side="right")
    first = 0
    while first < len(words):
        last = min(first + 256, len(words))
        to = int(ends[last - 1])
        distances = squares[first:last, None] + squares[None, first:to] - 2 * (counts[first:last] @ counts[first:to].T)
        rows, others = np.nonzero(distances <= 2)
        rows, others = rows + first, others + first
        likely = (others > rows) & (keys[rows] == keys[others])
        likely &= np.minimum(lengths[rows], lengths[others]) == sizes[rows]
        for i, j in zip(rows[likely].tolist(), others[likely].tolist()):
            a, b = (i, j) if lengths[i] <= lengths[j] else (j, i)
            _, low, high = windows[keys[i]]
            if near_in_window(words[a], words[b], low, high):
                yield i, j
        first = last


def near_words(rows: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) summed up inside each block; ``form`` is the near word of largest n."""
    placed = rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    chosen = placed.select(*BLOCK, "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last block of a batch may go on in the next.
            cut = last_block(batch)
            if cut:
                yield summed(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
                if changes(held):
                    yield summed(pa.Table.from_batches(held[:-1]))
                    held = [batch]
        if held:
            yield summed(pa.Table.from_batches(held))

    return chosen.mapInArrow(run, "word string, n_near long, form string, form_n long")


def block_columns(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([np.asarray(rows.column(c)) for c in BLOCK])


def last_block(batch: pa.RecordBatch) -> int:
    """Where the last block of a batch begins."""
    key = block_columns(batch)
    other = np.flatnonzero((key != key[:, -1:]).any(0))
    return int(other[-1]) + 1 if len(other) else 0


def changes(held: list[pa.RecordBatch]) -> bool:
    """Whether the last batch, one block, is another block than what came before."""
    return len(held) > 1 and bool((block_columns(held[-2])[:, -1] != block_columns(held[-1])[:, 0]).any())


def summed(rows: pa.Table) -> pa.RecordBatch:
    key = block_columns(rows)
    starts = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]) if rows.num_rows else np.zeros(0, bool)
    keys = np.cumsum(starts) - 1
    windows = [tuple(w) for w in key[:3, starts].T.tolist()]
    words, ns = rows.column("word").to_pylist(), rows.column("n").to_pylist()
    near: dict[int, tuple[int, int, str]] = {}
    for i, j in near_pairs(words, keys, windows) if words else ():
        for a, b in ((i, j), (j, i)):
            count, n, form = near.get(a, (0, 0, ""))
            if (-ns[b], words[b]) < (-n, form):
                n, form = ns[b], words[b]
            near[a] = (count + 1, n, form)
    columns = [
        pa.array([words[k] for k in near], pa.string()),
        pa.array([v[0] for v in near.values()], pa.int64()),
        pa.array([v[2] for v in near.values()], pa.string()),
        pa.array([v[1] for v in near.values()], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "form", "form_n"])


# ---------------------------------------------------------------- forms


def with_forms(words: DataFrame) -> DataFrame:
    """(word, n) with n_near, form and form_n: near words, and the most frequent of them where it is a form."""
    found = None
    for rows in blocks(words):
        found = near_words(rows) if found is None else found.unionByName(near_words(rows))
    # UTF-8 bytes are in code-point order, and so is Spark's order of strings.
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    n = -F.col("best.less")
    is_form = n >= RATIO * F.col("n")
    return joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"),
        F.when(is_form, n).alias("form_n"),
    )


def with_roots(words: DataFrame) -> DataFrame:
    """Forms followed to the last, twice as far each round."""
    jumps = words.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumps = stored(jumps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return words.join(jumps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of the texts.

    Null and empty texts have no words, an empty table gives an empty table;
    of equally frequent near words the smallest is the form.  Only the id and
    the text are read, so other columns may have any names.
    """
    words = stored(vocabulary(docs, doc_id, text), "words")
    return with_roots(stored(with_forms(words), "forms"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    found = spelling_variants(table(spark, folder, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
