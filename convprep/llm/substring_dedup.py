"""Removal of passages that an earlier document has, by suffix automata.

A window of ``WINDOW`` words is anchored at the smallest hash of its runs of
``GRAM`` words, so equal windows have equal anchors, and the consecutive
windows of a document with one anchor make a segment.  Anchors that only one
document has can't be in a repeated passage and go after one aggregation.

The rest are the reference, in shards: one for each anchor.  As the reference
grows with the corpus, a whole automaton can't be sent to all workers; shards
and the documents' segments meet by a shuffle instead.  In a shard the distinct
segments come in the order of their first document.  Each is streamed through
the suffix automaton of those before it, and the matching statistics tell, for
each of its windows, the first document that has it; a segment with anything
new is added.  A document loses the words of all windows whose first document
is an earlier one.

The windows of anchors that very many documents have are shards of their own,
so that no automaton grows beyond ``CROWD`` segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convprep.llm.common import (
    bounded_batches,
    buffer_of,
    free_shuffles,
    grams,
    hash_spans,
    offsets_of,
    pieces,
    signed,
    stored,
    table,
    word_spans,
)

WINDOW = 13
GRAM = 5
#: Documents with an anchor above which its windows are taken one by one.
CROWD = 4096
#: Windows of a segment.
SEGMENT = 64
#: Stands for a null id: larger than any other.
LAST_ID = 2**63 - 1


# ---------------------------------------------------------------- segments


def segments_of(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, text, first window (as a word of the buffer) and number of windows of each segment."""
    runs = grams(words, GRAM, 21)
    width = window - GRAM + 1
    if len(runs) < width:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    low, span = runs, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(runs) - width + 1], low[width - span :])
    owner = np.searchsorted(first, np.arange(len(low)), side="right") - 1
    inside = np.arange(len(low)) + window <= first[owner + 1]
    at = np.flatnonzero(inside)
    low, owner = low[at], owner[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(fresh)
    # Long runs of one anchor come from repetitions and are cut.
    group = np.cumsum(fresh) - 1
    fresh |= (np.arange(len(at)) - heads[group]) % SEGMENT == 0
    heads = np.flatnonzero(fresh)
    return low[heads], owner[heads], at[heads], np.diff(np.concatenate([heads, [len(at)]]))


def segment_hashes(words: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of ``count`` words from ``begin`` on."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    h = count.astype(np.uint64)
    for k in range(int(count.max())):
        on = np.flatnonzero(count > k)
        x = words[begin[on] + k] + h[on] * factor
        x ^= x >> np.uint64(29)
        h[on] = x * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, row, id, start): every segment of every document (row, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffer_of(batch.column(2))
            row, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at, _, part, limits in pieces(data, offs):
                starts, ends, first = word_spans(part, limits)
                anchor, owner, begin, _ = segments_of(hash_spans(part, starts, ends), first, window)
                columns = [signed(anchor), row[owner + at], doc[owner + at], (begin - first[owner]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "row", "id", "start"])

    return docs.select("row", "id", "text").mapInArrow(run, "anchor bigint, row bigint, id bigint, start bigint")


def segments(candidates: DataFrame, window: int, with_words: bool) -> DataFrame:
    """The segments of (row, id, text, starts) whose start is listed; those of crowded anchors window by window.

    ``starts`` holds twice the start of each, plus one if its anchor is crowded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offs = buffer_of(batch.column(2))
            lists = batch.column(3)
            listed, limits = lists.flatten().to_numpy(zero_copy_only=False), offsets_of(lists)
            for at, last, part, cuts in pieces(data, offs):
                starts, ends, first = word_spans(part, cuts)
                words = hash_spans(part, starts, ends)
                anchor, owner, begin, count = segments_of(words, first, window)
                mine = listed[limits[at] : limits[last]]
                of = np.repeat(np.arange(last - at), np.diff(limits[at : last + 1]))
                order = np.argsort(first[of] + (mine >> 1), kind="stable")
                wanted, crowded = (first[of] + (mine >> 1))[order], (mine & 1)[order].astype(bool)
                if not len(wanted):
                    continue
                place = np.minimum(np.searchsorted(wanted, begin), len(wanted) - 1)
                chosen = wanted[place] == begin
                anchor, owner, begin, count = anchor[chosen], owner[chosen], begin[chosen], count[chosen]
                split = crowded[place[chosen]]
                times = np.where(split, count, 1)
                nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                anchor, owner = np.repeat(anchor, times), np.repeat(owner, times)
                begin, count = np.repeat(begin, times) + nth, np.repeat(np.where(split, 1, count), times)
                single = np.repeat(split, times)
                seg = segment_hashes(words, begin, count + window - 1)
                anchor = np.where(single, seg, anchor)
                columns = [signed(anchor), signed(seg), doc[owner + at]]
                names = ["anchor", "seg", "id"]
                if with_words:
                    # The words of a segment are the bytes from its first to its last, in which spaces are made even later.
                    whole = part.tobytes()
                    a, b = starts[begin].tolist(), ends[begin + count + window - 2].tolist()
                    columns.append(pa.array([whole[i:j].decode("utf-8", "replace") for i, j in zip(a, b)], pa.string()))
                    names.append("words")
                else:
                    columns += [row[owner + at], (begin - first[owner]).astype(np.int64)]
                    names += ["row", "start"]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    more = "words string" if with_words else "row bigint, start bigint"
    return candidates.select("row", "id", "text", "starts").mapInArrow(run, f"anchor bigint, seg bigint, id bigint, {more}")


# ---------------------------------------------------------------- shards


class Automaton:
    """Suffix automaton of word sequences that are added one after the other; a state knows its first document."""

    def __init__(self) -> None:
        self.go: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [LAST_ID]

    def _state(self, go: dict[bytes, int], link: int, size: int, first: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.go) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state that p reaches by the word, parted from longer sequences if needed."""
        q = self.go[p][word]
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._state(dict(self.go[q]), self.link[q], self.size[p] + 1, self.first[q])
        self.link[q] = copy
        while p >= 0 and self.go[p].get(word) == q:
            self.go[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes], document: int) -> None:
        last = 0
        for word in words:
            if word in self.go[last]:
                last = self._split(last, word)
                continue
            new = self._state({}, 0, self.size[last] + 1, document)
            p = last
            while p >= 0 and word not in self.go[p]:
                self.go[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word)
            last = new

    def firsts(self, words: list[bytes], window: int) -> list[int]:
        """First document of each window, by matching statistics; LAST_ID if none has it."""
        go, link, size = self.go, self.link, self.size
        state = length = 0
        out = []
        for k, word in enumerate(words):
            while state and word not in go[state]:
                state = link[state]
                length = size[state]
            if word in go[state]:
                state = go[state][word]
                length += 1
            if k >= window - 1:
                found = LAST_ID
                if length >= window:
                    at = state
                    while size[link[at]] >= window:
                        at = link[at]
                    found = self.first[at]
                out.append(found)
        return out


def shard_firsts(group: list[tuple[int, int, str]], window: int) -> Iterator[tuple[int, list[int]]]:
    """(segment, first document of each window) for (segment, its first document, words) by ascending document."""
    automaton = None
    for k, (seg, low, text) in enumerate(group):
        words = text.encode().split()
        if len(group) == 1:
            yield seg, [low] * (len(words) - window + 1)
            return
        automaton = automaton or Automaton()
        found = automaton.firsts(words, window)
        if LAST_ID in found:
            automaton.add(words, low)
        yield seg, [min(f, low) for f in found]


def first_documents(distinct: DataFrame, window: int) -> DataFrame:
    """(anchor, seg, firsts) of the segments (anchor, seg, low, high, words) with a window that a later document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        group: list[tuple[int, int, str]] = []
        highs: dict[int, int] = {}

        def finish() -> list[tuple[int, int, list[int]]]:
            return [(now, seg, f) for seg, f in shard_firsts(group, window) if min(f) < highs[seg]]

        def batch_of(rows: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["anchor", "seg", "firsts"])

        for batch in batches:
            out: list[tuple[int, int, list[int]]] = []
            for anchor, seg, low, high, words in zip(*[c.to_pylist() for c in batch.columns]):
                if anchor != now:
                    out += finish()
                    now, group, highs = anchor, [], {}
                group.append((seg, low, words))
                highs[seg] = high
            if out:
                yield batch_of(out)
        if out := finish():
            yield batch_of(out)

    shards = distinct.select("anchor", "seg", "low", "high", "words").repartition("anchor").sortWithinPartitions("anchor", "low", "seg")
    return shards.mapInArrow(run, "anchor bigint, seg bigint, firsts array<bigint>")


# ---------------------------------------------------------------- removal


def plain_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, whole): number of words and digest of all of them for (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(2).cast(pa.binary())]
            split = [t.split() for t in texts]
            shas = [hashlib.sha256(b" ".join(w)).hexdigest() for w in split]
            columns = [batch.column(0), batch.column(1), pa.array([len(w) for w in split], pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_words", "whole"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row bigint, doc_id bigint, n_words bigint, whole string")


def cleaned(rows: DataFrame, window: int) -> DataFrame:
    """(row, n_removed, kept_text) for (row, text, marks), marks being the first words of windows to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            marks = batch.column(2)
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").split()
                steps = np.zeros(len(words) + 1, np.int64)
                begin = np.unique(marks[k].values.to_numpy(zero_copy_only=False))
                np.add.at(steps, begin, 1)
                np.add.at(steps, begin + window, -1)
                gone = np.cumsum(steps)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
            columns = [batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_removed", "kept_text"])

    return rows.select("row", "text", "marks").mapInArrow(run, "row bigint, n_removed bigint, kept_text string")


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The documents as (row, doc_id, text), and (row, n_removed, kept_text) of those that lose words.

    Words are runs of other bytes than white space, unchanged.  A window is
    ``window`` consecutive words; a word goes if a window over it also starts
    in a document with a smaller id.  Null and empty texts have no words.  A
    null id is larger than any other; rows with equal ids do not count for
    each other.  Texts of any length are read whole; an empty table gives an
    empty table.
    """
    bounded_batches(docs.sparkSession)
    free_shuffles(docs.sparkSession)
    rows = docs.select("doc_id", "text").select(
        F.xxhash64("doc_id", "text").alias("row"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "doc_id", "text"
    )
    found = anchors(rows, window)
    known = stored(
        found.groupBy("anchor")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"), (F.count("*") > CROWD).cast("int").alias("crowded"))
        .filter("low < high")
        .select("anchor", "crowded"),
        "anchors",
    )
    listed = found.join(known, "anchor").groupBy("row").agg(
        F.collect_set(F.col("start") * 2 + F.col("crowded")).alias("starts")
    )
    candidates = stored(rows.join(listed, "row").select("row", "id", "text", "starts"), "candidates")
    distinct = stored(
        segments(candidates, window, True)
        .groupBy("anchor", "seg")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("words").alias("words")),
        "segments",
    )
    firsts = stored(first_documents(distinct, window), "firsts")
    marks = (
        segments(candidates, window, False)
        .join(firsts, ["anchor", "seg"])
        .select("row", F.posexplode("firsts").alias("k", "first"), "id", "start")
        .filter(F.col("first") < F.col("id"))
        .groupBy("row")
        .agg(F.collect_list(F.col("start") + F.col("k")).alias("marks"))
    )
    return rows, cleaned(candidates.select("row", "text").join(marks, "row"), window)


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows, changed = repeated_passages(table(spark, folder, "documents"))
    digest = changed.select("row", "n_removed", F.sha2("kept_text", 256).alias("kept")).dropDuplicates(["row"])
    return plain_rows(rows).join(digest, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
    )
