"""Byte-level BPE encoding and decoding with the rank file of a public tokenizer.

Texts are cut before the merges without a regular expression: each code point
gets a class from a table (with what the next one or two code points decide),
and each class is a function between the few states that the cutting rule can
be in.  Composing such functions is associative, so the states at all places
of a buffer come from a scan over lanes: every lane composes its functions,
the lanes' results are scanned by doubling, and the lanes then run from known
states.  The slices between the boundaries go through the pair merges, whose
results are kept in a bounded cache.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convprep.llm.common import bounded_batches, buffer_of, offsets_of, pieces, ragged, table

#: Merged slices kept by a worker in each of two generations; a full one becomes the older, which is then forgotten.
CACHE = 80_000
#: Longer slices are merged with a heap and not kept.
LONG_SLICE = 64
#: Stands for pairs that make no token.
NO_RANK = 2**31 - 1
#: Tokens decoded at once.
PIECE_TOKENS = 1 << 17
#: Lanes of the scan.
LANES = 4096

# Classes of a code point; FIRST is added for the first one of a text.
LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, BLANK_BEFORE, BLANK, SPACE_BEFORE, SPACE, FIRST = range(10)
CLASSES = 2 * FIRST
# States after a code point: the next one begins a slice; in a run of letters, numbers or others; after a blank that
# joins the next run; in a run of white space; one or two more letters belong to the slice.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_SPACE, ONE_MORE, TWO_MORE = range(8)
STATES = 8
# The contractions of the pattern, and Unicode's white space.
TWO_LETTERS = "stmd"
THREE_LETTERS = ("re", "ve", "ll")
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def codepoint_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER, BLANK (the space itself) or SPACE (other white space) of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(c))[0])
        if kind is not None:
            out[c] = kind
    out[list(WHITE_SPACE)] = SPACE
    out[32] = BLANK
    return out


def transition(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point, and whether that one begins a slice."""
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE2: IN_OTHERS, QUOTE3: IN_OTHERS}.get(kind)
    if kind == LETTER and state in (ONE_MORE, TWO_MORE):
        return (FREE if state == ONE_MORE else ONE_MORE), False
    if run is not None and state in (run, JOINING):
        return run, False
    if kind == QUOTE2:
        return ONE_MORE, True
    if kind == QUOTE3:
        return TWO_MORE, True
    if run is not None:
        return run, True
    if kind == BLANK_BEFORE:
        return JOINING, True
    if kind == SPACE_BEFORE:
        return FREE, True
    return IN_SPACE, state != IN_SPACE


@lru_cache(1)
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Next state and begin flag by (state, class); function by (function, class) and by (function, function); state after a function from FREE."""
    go = np.zeros((STATES, CLASSES), np.uint8)
    begins = np.zeros((STATES, CLASSES), bool)
    for s in range(STATES):
        for k in range(CLASSES):
            go[s, k], begins[s, k] = transition(FREE if k >= FIRST else s, k % FIRST)
    begins[:, FIRST:] = True
    known = {tuple(range(STATES)): 0}
    order = [tuple(range(STATES))]
    for f in order:
        for k in range(CLASSES):
            g = tuple(int(go[s, k]) for s in f)
            if g not in known:
                known[g] = len(order)
                order.append(g)
    step = np.array([[known[tuple(int(go[s, k]) for s in f)] for k in range(CLASSES)] for f in order], np.int32)
    then = np.array([[known[tuple(g[s] for s in f)] for g in order] for f in order], np.int32)
    return go, begins, step, then, np.array([f[FREE] for f in order], np.uint8)


def classes_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Class of each code point, those of the next ones taken into account."""
    kind = codepoint_classes()[points]
    n = len(points)
    follows = np.zeros(n, bool)
    follows[:-1] = (kind[1:] < BLANK_BEFORE) & ~first[1:]
    out = kind.copy()
    out[(kind == BLANK) & follows] = BLANK_BEFORE
    out[(kind == SPACE) & follows] = SPACE_BEFORE
    quotes = np.flatnonzero(points == 39)
    if quotes.size:
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        ends = np.concatenate([first, np.ones(2, bool)])
        one = np.where(ends[quotes + 1], 0, padded[quotes + 1])
        two = np.where(ends[quotes + 1] | ends[quotes + 2], 0, padded[quotes + 2])
        out[quotes[np.isin(one, [ord(c) for c in TWO_LETTERS])]] = QUOTE2
        for a, b in THREE_LETTERS:
            out[quotes[(one == ord(a)) & (two == ord(b))]] = QUOTE3
    out[first] += FIRST
    return out


def boundaries(kind: np.ndarray) -> np.ndarray:
    """Whether each code point begins a slice, by a scan over transition functions."""
    go, begins, step, then, from_free = machine()
    n = len(kind)
    lanes = min(LANES, max(1, n // 32))
    length = -(-n // lanes)
    grid = np.zeros(lanes * length, np.uint8)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(lanes, length).T)
    whole = np.zeros(lanes, np.int32)
    flat = step.ravel()
    for row in grid:
        whole = flat[whole * CLASSES + row]
    shift = 1
    while shift < lanes:
        whole[shift:] = then[whole[:-shift], whole[shift:]]
        shift *= 2
    state = np.zeros(lanes, np.uint8)
    state[1:] = from_free[whole[:-1]]
    out = np.empty((length, lanes), bool)
    go, begins = go.ravel(), begins.ravel()
    for t, row in enumerate(grid):
        at = state * np.uint8(CLASSES) + row
        out[t] = begins[at]
        state = go[at]
    return out.T.ravel()[:n]


def slice_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions at which the slices begin."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points), bool)
    first[np.searchsorted(at, offs[:-1][offs[:-1] < offs[1:]])] = True
    return at[boundaries(classes_of(points, first))]


class Merger:
    """Pair merges by rank, with a bounded cache; for rank files of at most 65,536 tokens."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}
        by_rank = sorted((r, t) for t, r in self.ranks.items())
        size = by_rank[-1][0] + 1
        self.lengths = np.zeros(size, np.int64)
        for r, t in by_rank:
            self.lengths[r] = len(t)
        self.places = np.zeros(size, np.int64)
        self.places[1:] = np.cumsum(self.lengths)[:-1]
        self.bytes = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)
        #: Tokens of single bytes, and the rank of each pair of tokens that makes one, by both ids.
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                one, two = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if one is not None and two is not None:
                    pairs[one << 16 | two] = rank
        self.pairs = np.array(sorted(pairs), np.uint32)
        self.pair_rank = np.array([pairs[p] for p in self.pairs.tolist()], np.int32)

    def looked_up(self, slices: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each slice, from the cache or by merging the new ones together."""
        found = list(map(self.cache.get, slices))
        if None not in found:
            return found
        new = {s for s, f in zip(slices, found) if f is None}
        fresh = {s: self.older[s] for s in new if s in self.older}
        fresh.update((s, (self.ranks[s],)) for s in new if s in self.ranks)
        left = [s for s in new if s not in fresh]
        short = [s for s in left if len(s) <= LONG_SLICE]
        fresh.update(zip(short, self.merged_short(short)))
        if len(self.cache) + len(fresh) > CACHE:
            self.cache, self.older = {}, self.cache
        self.cache.update(fresh)
        if len(short) < len(left):
            fresh.update((s, self.merged_long(s)) for s in left if len(s) > LONG_SLICE)
        return [fresh[s] if f is None else f for s, f in zip(slices, found)]

    def pair_ranks(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Rank of what two tokens make together; NO_RANK where it is none or one is missing (-1)."""
        key = (one.astype(np.uint32) << np.uint32(16)) | (two.astype(np.uint32) & np.uint32(0xFFFF))
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (one >= 0) & (two >= 0), self.pair_rank[at], NO_RANK)

    def merged_short(self, slices: list[bytes]) -> list[tuple[int, ...]]:
        """Merges of many slices at once, one pair of each in a round; rows are slices, padded to one width."""
        sizes = np.fromiter(map(len, slices), np.int64, len(slices))
        out: list[tuple[int, ...]] = [()] * len(slices)
        for width in (8, 16, 32, LONG_SLICE):
            rows = np.flatnonzero((sizes <= width) & (sizes > (width // 2 if width > 8 else 0)))
            if not rows.size:
                continue
            raw = np.frombuffer(b"".join([slices[i].ljust(width, b"\0") for i in rows.tolist()]), np.uint8)
            tokens = self.single[raw].reshape(-1, width)
            columns = np.arange(width)
            tokens[columns >= sizes[rows][:, None]] = -1
            ranks = np.full(tokens.shape, NO_RANK, np.int32)
            ranks[:, :-1] = self.pair_ranks(tokens[:, :-1], tokens[:, 1:])
            going = np.arange(len(rows))
            while going.size:
                part = ranks[going]
                at = part.argmin(1)
                low = part[np.arange(len(going)), at]
                more = low < NO_RANK
                going, at, low = going[more], at[more], low[more]
                if not going.size:
                    break
                part, mine, nth = part[more], tokens[going], np.arange(len(going))
                # What comes after the pair moves one place to the left.
                later = columns[:-1] > at[:, None]
                mine[nth, at] = low
                mine[:, :-1] = np.where(later, mine[:, 1:], mine[:, :-1])
                mine[:, -1] = -1
                part[:, :-1] = np.where(later, part[:, 1:], part[:, :-1])
                part[:, -1] = NO_RANK
                after = np.where(at + 1 < width, mine[nth, np.minimum(at + 1, width - 1)], -1)
                part[nth, at] = self.pair_ranks(low, after)
                inner = np.flatnonzero(at > 0)
                part[inner, at[inner] - 1] = self.pair_ranks(mine[inner, at[inner] - 1], low[inner])
                tokens[going], ranks[going] = mine, part
            counts = (tokens >= 0).sum(1).tolist()
            for i, row, n in zip(rows.tolist(), tokens.tolist(), counts):
                out[i] = tuple(row[:n])
        return out

    def merged_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap of pairs over a linked list, for slices of any length."""
        n = len(piece)
        ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        get, heap = self.ranks.get, []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                rank = get(piece[i : ends[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ends[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if ends[i] else n
            if j >= n or ends[j] != end:
                continue
            ends[i], ends[j] = end, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : ends[i]]])
            i = after[i]
        return tuple(out)

    def encoded(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a buffer, and where the ids of each text begin."""
        starts = slice_starts(data, offs)
        whole, at = data.tobytes(), starts.tolist()
        found = self.looked_up([whole[a:b] for a, b in zip(at, at[1:] + [len(whole)])])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, before[np.searchsorted(starts, offs)]

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.places[ids] - (ends - sizes), sizes) + np.arange(total)]


_MERGERS: dict[bytes, Merger] = {}


def merger(file: bytes) -> Merger:
    """One merger for a worker and rank file."""
    if file not in _MERGERS:
        _MERGERS[file] = Merger(file)
    return _MERGERS[file]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, ranks: bytes, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with ``ids`` and ``ends`` (the byte at which each token ends).

    ``ranks`` is the content of a rank file; its size does not depend on the
    data.  Null and empty texts give empty lists.  Texts of any length are
    encoded whole, a column named ids or ends is replaced, repeated rows stay.
    """
    bounded_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text, "ids", "ends")]
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    chosen = docs.select(*[F.col(f"`{c}`") for c in others], F.col(text).alias("__text"))
    kept = docs.select(*[F.col(f"`{c}`") for c in others]).schema
    schema = kept.add("ids", T.ArrayType(T.IntegerType())).add("ends", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = merger(shared.value)
        for batch in batches:
            data, offs = buffer_of(batch.column(len(others)))
            for first, last, part, at in pieces(data, offs):
                ids, before = work.encoded(part, at)
                ends = np.cumsum(work.lengths[ids])
                counts = np.diff(before)
                ends = ends - np.repeat(at[:-1], counts)
                columns = [c.slice(first, last - first) for c in batch.columns[: len(others)]]
                lists = [ragged(x.astype(np.int32), before, pa.int32()) for x in (ids, ends)]
                yield pa.RecordBatch.from_arrays(columns + lists, names=others + ["ids", "ends"])

    return chosen.mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks: bytes, ids: str = "ids") -> DataFrame:
    """All columns of ``tokens`` with ``decoded``, the bytes that the ids stand for; a null list gives no bytes.

    Where the offsets of ``encode`` are among the columns, they are held
    against the lengths of the tokens, and a difference is an error.
    """
    bounded_batches(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    names = [c for c in tokens.columns if c != "decoded"]
    schema = tokens.select(*[F.col(f"`{c}`") for c in names]).schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = merger(shared.value)
        for batch in batches:
            lists = batch.column(names.index(ids))
            if lists.null_count:
                lists = pa.array([x.as_py() or [] for x in lists], lists.type)
            flat, limits = lists.flatten().to_numpy(zero_copy_only=False), offsets_of(lists)
            told = batch.column(names.index("ends")) if "ends" in names else None
            for first, last, part, at in pieces(flat, limits, PIECE_TOKENS):
                ends = np.concatenate([[0], np.cumsum(work.lengths[part])])
                if told is not None and not told.null_count:
                    kept = told.slice(first, last - first).flatten().to_numpy(zero_copy_only=False)
                    if not np.array_equal(kept, ends[1:] - np.repeat(ends[at[:-1]], np.diff(at))):
                        raise ValueError("offsets and ids do not belong together")
                whole, cuts = work.decoded(part).tobytes(), ends[at].tolist()
                out = pa.array([whole[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())
                columns = [c.slice(first, last - first) for c in batch.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*columns, out], names=[*names, "decoded"])

    return tokens.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def digest_columns() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of rows of ``decode``."""
    written = F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tokens = encode(table(spark, folder, "documents").select("doc_id", "text"), ranks)
    return decode(tokens, ranks).select("doc_id", *digest_columns())
