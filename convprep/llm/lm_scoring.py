"""Language-model scoring with log-frequency Bloom filters.

Counts of words and of pairs of words are exact and come from all training
texts; every pair counts.  Counts of pairs are quantised on a logarithmic scale
of ``STEPS`` steps for a doubling, and step k of a pair is stored as membership
of (pair, 1) to (pair, k).  A count is read back by probing until a step is
missing.

The filter of all pairs grows with the corpus, so it is cut into hash shards.
The number of shards follows the training tokens, so that about ``ENTRIES``
entries at most are in one; the filter of a shard is filled where the probes of
its pairs arrive.  Pairs of which a single one makes up one in ``HOT`` training
tokens would be a burden to one shard; there are at most ``HOT`` of them, and
their filter is sent to all workers.  Words that make up one in ``UNITS`` tokens
are at most ``UNITS`` and are sent to all workers too; the exact counts of all
others meet the texts in the shards.  Where a count is held changes no result.

The probability of a word t after b is (n(b, t) + PRIOR * p(t)) / (n(b) + PRIOR)
with the quantised count of the pair and the base probability p, so the
logarithm of a text is a sum of terms of single words and of the pairs held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convprep.llm.common import (
    bounded_batches,
    buffer_of,
    free_shuffles,
    hash_spans,
    held_out,
    lower_bytes,
    mix,
    offsets_of,
    pieces,
    ragged,
    signed,
    stored,
    table,
    word_spans,
)

UNITS = 1 << 20
HOT = 1 << 14
STEPS = 4
#: Weight of the base probability, in tokens.
PRIOR = 64.0
PROBES = 4
#: Bits of the place of a frequent word in a key of two, and of the word before it in such a key.
PLACE_BITS = 21
BEFORE_BITS = 42
#: Least number of shards, about the most entries of one, and bits of a filter for each entry.
SHARDS = 48
ENTRIES = 1 << 23
ENTRY_BITS = 64
LOW = np.uint64(0xFFFFFFFF)
#: Bytes of text that send their probes together.
PART = 1 << 22
#: The token after the last word; no word has the hash of nothing.
END = np.uint64(mix(np.array([7], np.uint64))[0])
#: Distinct counts that a task holds before it passes them on.
HELD = 1 << 21
#: What a shard gets first, instead of a piece of texts: rows of rare words, rows of pairs.
WORDS_FIRST, THEN_PAIRS = -2, -1


# ---------------------------------------------------------------- tokens


def tokens_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's words and then the end, and where each text begins."""
    low = lower_bytes(data)
    starts, ends, first = word_spans(low, offs)
    begin = first + np.arange(len(first))
    out = np.full(int(begin[-1]), END, np.uint64)
    out[np.arange(len(starts)) + np.searchsorted(first, np.arange(len(starts)), side="right") - 1] = hash_spans(low, starts, ends)
    return out, begin


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


def counted(batches: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct values and their counts, summed over a task as far as memory is bounded."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0
    for values in batches:
        key, n = np.unique(values, return_counts=True)
        keys.append(key)
        counts.append(n)
        held += len(key)
        if held >= HELD:
            key, n = summed(keys, counts)
            keys, counts, held = [key], [n], len(key)
            if held >= HELD // 2:
                yield key, n
                keys, counts, held = [], [], 0
    if keys:
        yield summed(keys, counts)


def key_counts(texts: DataFrame, keys_of) -> DataFrame:
    """(key, n): number of all keys that ``keys_of`` finds among the tokens of the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (p for batch in batches for p in pieces(*buffer_of(batch.column(0))))
        for key, n in counted(keys_of(*tokens_of(data, offs)) for _, _, data, offs in parts):
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(n)], names=["key", "n"])

    return texts.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class Words:
    """The frequent words: sorted hashes and counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Place of each token, -1 for those that are not frequent."""
        if not len(self.keys):
            return np.full(len(tokens), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, tokens), len(self.keys) - 1)
        return np.where(self.keys[at] == tokens, at, -1)


def before_of(values: np.ndarray, begin: np.ndarray, end) -> np.ndarray:
    """The value before each; an end before the first of a text."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[begin[:-1]] = end
    return before


def rare_codes(tokens: np.ndarray) -> np.ndarray:
    """The upper half of the keys of pairs whose second word is this; it decides their shard, which is the word's too."""
    return (mix(tokens) >> np.uint64(33) | np.uint64(1 << 31)) << np.uint64(32)


def rare_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Keys of pairs whose second word is rare, from the hashes of both; above all other keys."""
    return rare_codes(tokens) | mix(tokens ^ mix(before & LOW)) & LOW


def pairs_of(words: Words, tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of each token with the one before it (an end before the first), the token's place and the hash before it.

    Where both words are frequent the key is of their places; where the first
    is rare it is of its hash and a place; where the second is rare, of both hashes.
    """
    place = words.find(tokens)
    before, hashed = before_of(place, begin, words.find(np.array([END]))[0]), before_of(tokens, begin, END)
    code = np.where(before >= 0, before.astype(np.uint64), hashed >> np.uint64(64 - BEFORE_BITS + 1) | np.uint64(1 << (BEFORE_BITS - 1)))
    keys = code << np.uint64(PLACE_BITS) | np.maximum(place, 0).astype(np.uint64)
    rare = place < 0
    keys[rare] = rare_keys(hashed[rare], tokens[rare])
    return keys, place, hashed


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    keys = np.where(keys >> np.uint64(63), keys & ~LOW, keys)
    return (mix(keys ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(shards)).astype(np.int64)


# ---------------------------------------------------------------- filters


def steps_of(n: np.ndarray) -> np.ndarray:
    """Quantised count: one, then one more for each part of a doubling."""
    return np.floor(np.log2(n) * STEPS + 1e-9).astype(np.int64) + 1


def counts_of(step: np.ndarray) -> np.ndarray:
    return 2.0 ** ((step - 1) / STEPS)


def bits_of(pairs: np.ndarray, step: np.ndarray | int, size: int) -> Iterator[np.ndarray]:
    """The bits of (pair, step) in a filter of ``size`` bits, a power of two."""
    h = mix(pairs * np.uint64(0x9E3779B97F4A7C15) + np.asarray(step).astype(np.uint64))
    other = mix(h) | np.uint64(1)
    for k in range(PROBES):
        yield (h + np.uint64(k) * other) & np.uint64(size - 1)


def filled(pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The filter of distinct pairs and their counts, as bytes; its size follows the entries."""
    steps = steps_of(n)
    size = 1 << max(6, math.ceil(math.log2(max(1, int(steps.sum()) * ENTRY_BITS))))
    held = np.zeros(size // 8, np.uint8)
    step = 1
    while len(pairs):
        for bit in bits_of(pairs, step, size):
            np.bitwise_or.at(held, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        step += 1
        left = steps >= step
        pairs, steps = pairs[left], steps[left]
    return held


def probed(held_bytes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Step of each pair in a filter, by probing until one is missing."""
    out = np.zeros(len(pairs), np.int64)
    left = np.arange(len(pairs))
    step = 1
    while left.size:
        held = np.ones(len(left), bool)
        for bit in bits_of(pairs[left], step, 8 * len(held_bytes)):
            held &= (held_bytes[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        left = left[held]
        out[left] = step
        step += 1
    return out


# ---------------------------------------------------------------- the model


class Model:
    """Frequent words, the filter of hot pairs, and what the shards need; of bounded size."""

    def __init__(self, words: Words, total: int, distinct: int, hot: np.ndarray):
        self.words, self.total, self.distinct, self.hot = words, total, distinct, hot
        self.hot_share = HOT
        self.mass = total + 0.5 * (distinct + 1)
        self.log_base = math.log10(self.mass)
        # Entries are at most 2.5 for each token of a pair.
        self.shards = max(SHARDS, -(-5 * total // (2 * ENTRIES)))

    def gains(self, step: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a pair that is held adds to the logarithm of its second word, which has the count ``n``."""
        return np.log10(1.0 + counts_of(step) * self.mass / (PRIOR * (n + 0.5)))

    def is_hot(self, n: np.ndarray) -> np.ndarray:
        return n * self.hot_share >= self.total


def context_logs(n: np.ndarray) -> np.ndarray:
    """What a word of this count adds, as a context, to the logarithm of the next word."""
    return np.log10(PRIOR / (n + PRIOR))


def learn(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the column ``text``, and the stored counts (key, n) of words too rare for it."""
    unigrams = stored(key_counts(training, lambda tokens, begin: tokens), "unigrams")
    total, distinct = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # A token in UNITS or more, and the end: at most UNITS words and one.
    is_frequent = (F.col("n") * UNITS >= F.lit(total)) | (F.col("key") == F.lit(int(signed(np.array([END]))[0])))
    frequent = unigrams.filter(is_frequent).toArrow()
    words = Words(frequent.column("key").to_numpy().view(np.uint64), frequent.column("n").to_numpy())
    model = Model(words, total, distinct, np.zeros(8, np.uint8))
    if total:
        shared = training.sparkSession.sparkContext.broadcast(model)

        def of_hot_words(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
            words = shared.value.words
            hot = np.append(shared.value.is_hot(words.counts), False)
            keys, place, _ = pairs_of(words, tokens, begin)
            both = hot[place] & hot[before_of(place, begin, words.find(np.array([END]))[0])]
            return keys[both]

        hot = key_counts(training, of_hot_words).filter(F.col("n") * HOT >= F.lit(total)).toArrow()
        model.hot = filled(hot.column("key").to_numpy().view(np.uint64), hot.column("n").to_numpy())
    return model, unigrams.filter(~is_frequent)


# ---------------------------------------------------------------- shards

#: Bytes of a value in the columns near, far, rare and prev.
WIDTHS = 6, 8, 8, 4
#: Pairs of frequent words in six bytes each, other keys in eight; then rare words and the hash before each; the text
#: in its piece and the count of every one of them, in this order.
SHARD_ROW = "shard int, piece bigint, near binary, far binary, rare binary, prev binary, who array<int>, n array<bigint>"


def binary_column(values: np.ndarray, limits: np.ndarray, width: int) -> pa.Array:
    """The lower ``width`` bytes of the values between limits, as binaries."""
    data = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width])
    offsets = (limits * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(limits) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def values_of(data: np.ndarray, width: int) -> np.ndarray:
    """The values of a part of a binary column."""
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(-1, width)
    return out.view(np.uint64).ravel()


def dealt(
    shards: int, piece: int, keys: np.ndarray, rare: np.ndarray, prev: np.ndarray, who: np.ndarray, n: np.ndarray
) -> dict[str, pa.Array]:
    """Columns of ``SHARD_ROW``: the keys of pairs and then the rare words, each in its shard."""
    at = np.concatenate([shard_of(keys, shards), shard_of(rare_codes(rare), shards)])
    kind = np.concatenate([(keys >> np.uint64(BEFORE_BITS) != 0).astype(np.int8), np.full(len(rare), 2, np.int8)])
    order = np.lexsort((kind, at))
    values = np.concatenate([keys, rare])[order]
    before = np.concatenate([np.zeros(len(keys), np.uint64), prev])[order]
    at, kind = at[order], kind[order]
    found, heads = np.unique(at, return_index=True)

    def column(of: int, values: np.ndarray, width: int) -> pa.Array:
        limits = np.append(0, np.searchsorted(at[kind == of], found, side="right"))
        return binary_column(values[kind == of], limits, width)

    ends = np.append(heads, len(at))
    return {
        "shard": pa.array(found.astype(np.int32)),
        "piece": pa.array(np.full(len(found), piece, np.int64)),
        "near": column(0, values, WIDTHS[0]),
        "far": column(1, values, WIDTHS[1]),
        "rare": column(2, values, WIDTHS[2]),
        "prev": column(2, before, WIDTHS[3]),
        "who": ragged(who[order].astype(np.int32), ends, pa.int32()),
        "n": ragged(n[order].astype(np.int64), ends, pa.int64()),
    }


def dealt_words(words: DataFrame, shards: int) -> DataFrame:
    """The counts of rare words, dealt to their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            key, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            key = np.ascontiguousarray(key).view(np.uint64)
            zeros = np.zeros(len(key), np.uint64)
            yield pa.RecordBatch.from_pydict(dealt(shards, WORDS_FIRST, none, key, zeros, zeros, n))

    return words.select("key", "n").mapInArrow(run, SHARD_ROW)


def dealt_pairs(training: DataFrame, shared) -> DataFrame:
    """The counts of all pairs of each task but the hot ones, dealt to their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        none = np.zeros(0, np.uint64)

        def values() -> Iterator[np.ndarray]:
            for batch in batches:
                for _, _, data, offs in pieces(*buffer_of(batch.column(0))):
                    tokens, begin = tokens_of(data, offs)
                    keys = pairs_of(model.words, tokens, begin)[0]
                    yield keys[probed(model.hot, keys) == 0]

        for key, n in counted(values()):
            yield pa.RecordBatch.from_pydict(dealt(model.shards, THEN_PAIRS, key, none, none, np.zeros(len(key)), n))

    return training.select("text").mapInArrow(run, SHARD_ROW)


class Shard:
    """What a shard holds: exact counts of its rare words, and the filter of its pairs."""

    def __init__(self, model: Model):
        self.model = model
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.filter: np.ndarray | None = None

    def close(self) -> None:
        """Sum what was learnt."""
        none = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        sides = [list(zip(*side)) if side else none for side in (self.words, self.pairs)]
        self.rare = Words(*summed(list(sides[0][0]), list(sides[0][1])))
        self.rare_counts = np.append(self.rare.counts, 0)
        pairs = summed(list(sides[1][0]), list(sides[1][1]))
        self.words, self.pairs = [], []
        self.filter = filled(*pairs)

    def sums(self, keys: np.ndarray, rare: np.ndarray, prev: np.ndarray, who: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Texts of a piece, what pairs and contexts add to each, logarithms and number of its rare words that are known."""
        model = self.model
        counts = self.rare_counts[self.rare.find(rare)]
        step = probed(self.filter, np.concatenate([keys, rare_keys(prev, rare)]))
        second = np.concatenate([model.words.counts[(keys & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)], counts])
        added = np.where(step > 0, model.gains(np.maximum(step, 1), second), 0.0)
        added[len(keys) :] += context_logs(counts)
        texts, inverse = np.unique(who, return_inverse=True)
        own = inverse[len(keys) :], n[len(keys) :]
        size = len(texts)
        return (
            texts,
            np.bincount(inverse, added * n, size),
            np.bincount(own[0], np.log10(counts + 0.5) * own[1], size),
            np.bincount(own[0], (counts > 0) * own[1], size).astype(np.int64),
        )


# ---------------------------------------------------------------- scoring


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(all columns of ``docs`` but the text, n_tokens, n_known, train_tokens, base_score, score).

    Both tables have a column ``text``; null counts as empty, which is one
    token, the end.  ``base_score`` comes from exact counts of single tokens,
    ``score`` from the model.  Without training texts every token has
    probability one.  Texts of any length are scored whole.  Repeated rows get
    equal scores; columns with the added names are replaced.  The rows of
    ``docs`` must come in the same order when a lost task is run again, as those
    of files do.

    Texts are read once.  A piece of texts sends its probes to the shards, and
    the rows with what can be summed without them along; both meet again by piece.
    """
    spark = docs.sparkSession
    free_shuffles(spark)
    bounded_batches(spark)
    model, rare_words = learn(training)
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    others = [c for c in docs.columns if c not in (*added, "text")]
    shared = spark.sparkContext.broadcast(model)
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("docs_row")
    chosen = docs.select(row, "text")
    kind = chosen.schema["docs_row"].dataType.simpleString()
    home = f"home array<struct<docs_row:{kind},n_tokens:bigint,n_known:bigint,base:double,more:double>>"
    kinds = {"texts": pa.int32(), "gained": pa.float32(), "logs": pa.float64(), "known": pa.int64()}

    def run_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words, shards = model.words, model.shards
        # Pieces are numbered in their task.
        piece = TaskContext.get().partitionId() << 40
        own_logs, context = np.log10(words.counts + 0.5), context_logs(words.counts)
        for batch in batches:
            for first, last, data, offs in pieces(*buffer_of(batch.column(1)), PART):
                tokens, begin = tokens_of(data, offs)
                texts = last - first
                owner = np.repeat(np.arange(texts), np.diff(begin))
                keys, place, hashed = pairs_of(words, tokens, begin)
                common = place >= 0
                end = words.find(np.array([END]))[0]
                base = np.bincount(owner[common], own_logs[place[common]], texts)
                # A context for each token but the first, whose context is an end, as is the last token.
                more = np.bincount(owner[common], context[place[common]], texts)
                step = probed(model.hot, keys)
                hot = common & (step > 0)
                more += np.bincount(owner[hot], model.gains(step[hot], words.counts[place[hot]]), texts)
                ask, rare = np.flatnonzero(common & ~hot), np.flatnonzero(~common)
                if not model.total:
                    base += model.log_base * np.diff(begin)
                    ask, rare = ask[:0], rare[:0]
                asked = distinct(owner[ask], keys[ask])
                seldom = distinct(owner[rare], tokens[rare], hashed[rare] & LOW)
                who, n = (np.concatenate([asked[k], seldom[k]]) for k in (0, -1))
                columns = dealt(shards, piece, asked[1], seldom[1], seldom[2], who, n)
                sent = len(columns["shard"])
                if sent:
                    homes = pa.nulls(sent, home_type(batch))
                    yield pa.RecordBatch.from_arrays([*columns.values(), homes], names=[*columns, "home"])
                fields = [
                    batch.column(0).slice(first, texts),
                    pa.array(np.diff(begin)),
                    pa.array(np.bincount(owner[common], minlength=texts).astype(np.int64)),
                    pa.array(base.astype(np.float64)),
                    pa.array(more.astype(np.float64)),
                ]
                rows = pa.StructArray.from_arrays(fields, names=["docs_row", "n_tokens", "n_known", "base", "more"])
                empty = {name: binary_column(keys[:0], np.zeros(2, np.int64), 8) for name in ("near", "far", "rare", "prev")}
                lists = {name: ragged(np.zeros(0), np.zeros(2), of) for name, of in (("who", pa.int32()), ("n", pa.int64()))}
                at_home = {"shard": pa.array([piece % shards], pa.int32()), "piece": pa.array([piece])} | empty | lists
                at_home["home"] = pa.ListArray.from_arrays(pa.array([0, texts], pa.int32()), rows)
                yield pa.RecordBatch.from_arrays(list(at_home.values()), names=list(at_home))
                piece += 1

    def home_type(batch: pa.RecordBatch) -> pa.DataType:
        names = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("more", pa.float64())]
        return pa.list_(pa.struct([("docs_row", batch.column(0).type), *names]))

    def run_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = -1, Shard(shared.value)
        for batch in batches:
            data, limits = zip(*[buffer_of(batch.column(k)) for k in (2, 3, 4, 5)])
            who, n = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (6, 7))
            ends = offsets_of(batch.column(6))
            shard_no, piece = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            # Rows of one shard that learn the same, or all ask, are taken together.
            turn = np.flatnonzero(np.diff(shard_no * 4 + np.minimum(piece, 0), prepend=-9, append=-9))
            for a, b in zip(turn[:-1], turn[1:]):
                if shard_no[a] != at:
                    at, shard = shard_no[a], Shard(shared.value)
                near, far, rare, prev = (
                    values_of(d[limit[a] : limit[b]], width) for d, limit, width in zip(data, limits, WIDTHS)
                )
                keys, mine = np.concatenate([near, far]), n[ends[a] : ends[b]]
                if piece[a] == WORDS_FIRST:
                    shard.words.append((rare, mine.copy()))
                    continue
                # Values are in order of rows and kinds; here all of a kind come together.
                sizes = [np.diff(limit[a : b + 1]) // width for limit, width in zip(limits[:3], WIDTHS)]
                order = np.argsort(np.repeat(np.tile([0, 1, 2], b - a), np.stack(sizes, 1).ravel()), kind="stable")
                if piece[a] == THEN_PAIRS:
                    shard.pairs.append((keys, mine[order]))
                    continue
                if shard.filter is None:
                    shard.close()
                row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])) << 32
                asks = (row | who[ends[a] : ends[b]])[order]
                texts, *sums = shard.sums(keys, rare, prev, asks, mine[order])
                lists = np.searchsorted(texts, np.arange(b - a + 1) << 32)
                columns = [ragged(x, lists, of) for x, of in zip([(texts & 0xFFFFFFFF).astype(np.int32), *sums], kinds.values())]
                here = slice(a, b)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[here], batch.column(8)[here], *columns], names=["piece", "home", *kinds]
                )

    def run_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished() -> pa.RecordBatch:
            names = ["docs_row", "n_tokens", "n_known", "base_score", "score"]
            rows, (gained, logs, known) = home_rows, totals
            n_tokens = rows.field("n_tokens").to_numpy(zero_copy_only=False)
            base = rows.field("base").to_numpy(zero_copy_only=False) + logs - n_tokens * model.log_base
            columns = [
                rows.field("docs_row"),
                rows.field("n_tokens"),
                pa.array(rows.field("n_known").to_numpy(zero_copy_only=False) + known.astype(np.int64)),
                pa.array(base),
                pa.array(base + rows.field("more").to_numpy(zero_copy_only=False) + gained),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        model = shared.value
        at, home_rows, totals = -1, None, []
        for batch in batches:
            homes = batch.column(1)
            limits = offsets_of(batch.column(2))
            texts, *sums = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in range(2, 6))
            for i, piece in enumerate(batch.column(0).to_pylist()):
                if homes[i].is_valid:
                    if home_rows is not None:
                        yield finished()
                    at, home_rows = piece, homes[i].values
                    totals = [np.zeros(len(home_rows)) for _ in range(3)]
                    continue
                mine = slice(limits[i], limits[i + 1])
                for total, values in zip(totals, sums):
                    total[texts[mine]] += values[mine]
        if home_rows is not None:
            yield finished()

    sent = chosen.mapInArrow(run_texts, f"{SHARD_ROW}, {home}")
    shards = model.shards
    if model.total:
        learnt = dealt_words(rare_words, shards).unionByName(dealt_pairs(training, shared))
        sent = learnt.unionByName(sent, allowMissingColumns=True)
    meeting = sent.repartition(shards, "shard").sortWithinPartitions("shard", "piece")
    back = meeting.mapInArrow(run_shards, f"piece bigint, {home}, texts array<int>, gained array<float>, logs array<double>, known array<bigint>")
    # The row with the texts of a piece comes first.
    back = back.repartition(shards, "piece").sortWithinPartitions("piece", F.col("home").isNull())
    summed_up = back.mapInArrow(run_back, f"docs_row {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    train_tokens = F.lit(int(model.total)).cast("long").alias("train_tokens")
    return summed_up.select("docs_row.*", "n_tokens", "n_known", train_tokens, "base_score", "score")


def distinct(owner: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (owner, keys...) in order of the owner, and how often each is there."""
    order = np.lexsort((*keys[::-1], owner))
    sides = [owner[order], *[k[order] for k in keys]]
    fresh = np.zeros(len(owner), bool)
    fresh[:1] = True
    for side in sides:
        fresh[1:] |= side[1:] != side[:-1]
    heads = np.flatnonzero(fresh)
    return (*[side[heads] for side in sides], np.diff(np.append(heads, len(owner))))


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = F.col("held_out")
    flagged = docs.withColumn("held_out", held_out(F.col("doc_id"), 1))
    return score(flagged, flagged.filter(~out).select("text"))
