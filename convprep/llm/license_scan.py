"""License scans: short notices found with a few edits.

A notice of words is a pattern whose names (``mit``, a version) must stand
unchanged, while the words around them may have some edits.  A match with at
most k edits leaves one of any k + 1 parts of the notice whole, so an automaton
of those parts finds every candidate; the bounded-error matching of the regex
library then verifies it in a window around the part and counts its edits.

Texts are compared as words: A-Z become a-z, and every run of ASCII characters
that are neither digits nor letters becomes one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructType

from convprep.llm.common import bounded_batches, buffer_of, pieces, table

#: Phrases whose places are counted, with their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Other notices.
NOTICES = BASE + (
    ("apache-2", "apache license 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "under the bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("isc", "under the isc license"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl-2", "gnu lesser general public license version 2"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("mpl-2", "mozilla public license version 2"),
    ("cc-by", "cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nd", "cc by nd"),
    ("cc0", "cc0 1 0 universal"),
)
#: Words without which a notice says something else, besides all numbers.
NAMES = {"mit", "bsd", "isc", "gnu", "lesser", "affero", "mozilla", "cc", "by", "nc", "sa", "nd", "cc0"}
#: A run of other words may have one edit for so many characters, the space at its border included.
PER_EDIT = 8
#: Edits of one such run at most, as the time of the matching grows with the power of the edits.
MOST_EDITS = 4

_WORD = np.full(256, 32, np.uint8)
_WORD[48:58] = np.arange(48, 58)
_WORD[65:91] = np.arange(97, 123)
_WORD[97:123] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)

MATCH = "struct<notice:int,label:string,first_word:bigint,last_word:bigint,edits:int,found:string>"


@dataclass(frozen=True)
class Notice:
    label: str
    #: The words with a space before, between and after.
    text: str
    #: Edits that all of it may have.
    edits: int
    #: Its names, each with its spaces.
    names: tuple[str, ...]
    pattern: str

    @staticmethod
    def of(label: str, phrase: str) -> Notice:
        runs: list[tuple[bool, list[str]]] = []
        for word in phrase.split():
            named = word in NAMES or word.isdigit()
            if not runs or runs[-1][0] != named:
                runs.append((named, []))
            runs[-1][1].append(word)
        pattern, edits, names = "", 0, []
        for k, (named, words) in enumerate(runs):
            run = " ".join(words)
            if named:
                # Names have the spaces around them, so they stand as whole words.
                names.append(f" {run} ")
                pattern += names[-1]
            else:
                run = " " * (k == 0) + run + " " * (k == len(runs) - 1)
                allowed = min(len(run) // PER_EDIT, MOST_EDITS)
                edits += allowed
                pattern += f"(?:{run}){{e<={allowed}}}"
        return Notice(label, f" {phrase} ", edits, tuple(names), f"(?b){pattern}")


class Scanner:
    """Finds notices in word streams."""

    def __init__(self, notices: tuple[tuple[str, str], ...]):
        self.notices = [Notice.of(*n) for n in notices]
        self.patterns = [regex.compile(n.pattern) for n in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(self.notices):
            cuts = np.linspace(0, len(n.text), n.edits + 2).astype(int)
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(n.text[a:b], []).append((k, int(a)))
        self.seeds = ahocorasick.Automaton()
        for part, places in seeds.items():
            self.seeds.add_word(part, (len(part), places))
        self.seeds.make_automaton()

    def candidates(self, stream: str) -> set[tuple[int, int]]:
        """(notice, where it begins but for its edits) of every whole part in the stream."""
        return {(k, end + 1 - size - at) for end, (size, places) in self.seeds.iter(stream) for k, at in places}

    def matches(self, stream: str, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(begin, end, notice, edits) of the matches inside the texts that end at ``ends``, in order.

        Of overlapping matches of one notice the one with fewest edits is kept,
        the first of those.
        """
        found: dict[int, set[tuple[int, int, int]]] = {}
        for k, begin in self.candidates(stream):
            n = self.notices[k]
            # The part lies inside one text, which also holds the match.
            middle = min(max(begin + len(n.text) // 2, 0), len(stream) - 1)
            low, high = max(begin - n.edits, 0), min(begin + len(n.text) + n.edits, len(stream))
            window = stream[low:high]
            if "\n" in window:
                text = int(np.searchsorted(ends, middle))
                low, high = max(low, int(ends[text - 1]) + 1 if text else 0), min(high, int(ends[text]))
                window = stream[low:high]
            if any(name not in window for name in n.names):
                continue
            m = self.patterns[k].search(window)
            if m:
                found.setdefault(k, set()).add((sum(m.fuzzy_counts), low + m.start(), low + m.end()))
        out = []
        for k, spans in found.items():
            taken: list[tuple[int, int]] = []
            for edits, a, b in sorted(spans):
                # The space at a border may belong to two notices.
                if all(b - 1 <= x or y - 1 <= a for x, y in taken):
                    taken.append((a, b))
                    out.append((a, b, k, edits))
        return sorted(out)


def word_stream(data: np.ndarray, offs: np.ndarray) -> tuple[str, np.ndarray]:
    """All texts as ``" word word \\n word ... \\n"``, and the place of each text's line end."""
    mapped = _WORD[data]
    rows = np.arange(len(offs) - 1)
    # A space before each text, and a space, a line end after it.
    spread = np.full(len(data) + 3 * len(rows), 32, np.uint8)
    sizes = np.diff(offs)
    moved = np.repeat(3 * rows + 1, sizes)
    spread[np.arange(len(data)) + moved] = mapped
    spread[offs[1:] + 3 * rows + 2] = 10
    space = spread == 32
    keep = np.ones(len(spread), bool)
    keep[1:] &= ~(space[1:] & space[:-1])
    stream = spread[keep].tobytes().decode("utf-8")
    points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
    return stream, np.flatnonzero(points == 10)


def scan(docs: DataFrame, text: str = "text", notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """All columns of ``docs`` but the text, with n_words and matches.

    A match names its notice (its number in ``notices``), label, first and
    last word (counted from 0), edits and the words found.  A null or empty
    text has no words and no matches; texts of any length are read whole, in
    pieces of about 1 MB, a longer one alone.  Equal rows stay; columns named
    n_words or matches are replaced.  An empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text, "n_words", "matches")]
    kept = docs.select(*[F.col(f"`{c}`") for c in others])
    schema = StructType(list(kept.schema)).add("n_words", LongType()).add("matches", DataType.fromDDL(f"array<{MATCH}>"))
    chosen = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("__text"))
    struct = pa.struct(
        [("notice", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]
        + [("edits", pa.int32()), ("found", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            counts, matches = [], []
            for *_, data, offs in pieces(*buffer_of(batch.column(len(others)))):
                stream, ends = word_stream(data, offs)
                n, found = results(scanner, stream, ends)
                counts.append(n)
                matches += found
            count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            added = [pa.array(count, pa.int64()), pa.array(matches, pa.list_(struct))]
            names = [*others, "n_words", "matches"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *added], names=names)

    return chosen.mapInArrow(run, schema)


def results(scanner: Scanner, stream: str, ends: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """Number of words and matches of each text of a stream."""
    points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
    gap = (points == 32) | (points == 10)
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    firsts = np.searchsorted(begins, np.concatenate([[0], ends]))
    out: list[list[dict]] = [[] for _ in ends]
    for a, b, k, edits in scanner.matches(stream, ends):
        row = int(np.searchsorted(ends, a))
        # The words that the match touches, from the one that its first character but a space is in.
        inner = a + next((i for i, c in enumerate(stream[a:b]) if c != " "), 0)
        first = int(np.searchsorted(begins, inner, side="right")) - 1
        last = int(np.searchsorted(begins, b)) - 1
        out[row].append(
            {
                "notice": k,
                "label": scanner.notices[k].label,
                "first_word": first - int(firsts[row]),
                "last_word": last - int(firsts[row]),
                "edits": edits,
                "found": stream[a:b].strip(),
            }
        )
    return np.diff(firsts), out


def digest_columns(notices: tuple[tuple[str, str], ...] = NOTICES) -> list:
    """Base places, labels and the likeness of the best match, from ``matches``."""
    sizes = F.array(*[F.lit(len(phrase)) for _, phrase in notices])
    labels = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda m: m["label"]))), ",")
    base = F.filter("matches", lambda m: (m["notice"] < len(BASE)) & (m["edits"] == 0))
    starts = F.transform(base, lambda m: m["first_word"])
    likeness = F.transform("matches", lambda m: 1.0 - m["edits"] / F.get(sizes, m["notice"]))
    return [
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"),
    ]


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", *digest_columns())
