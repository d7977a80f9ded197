"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded labelled sample is built.  A
text is cut into phrases, each the longest match that the sample contains; a
phrase costs the logarithm of the sample's size, and the language with the
lowest cost for each byte wins.  Texts are parsed in blocks of ``BLOCK`` bytes,
which adds at most one phrase for a block, for all languages alike; so one long
text is no longer than many short ones, and the blocks of many texts advance
together, one byte a step, by lookups in a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convprep.llm.common import bounded_batches, buffer_of, held_out, lower_bytes, pieces, stored, table

#: Bound of the labelled sample of a language: documents, and characters of each, taken from any place in it.
SAMPLE_DOCS = 64
SAMPLE_CHARS = 400
#: Bytes of the table of a group of languages; one language has at most 64 * (4 * 400 + 1) bytes of text, two states
#: for each, and an entry of four bytes for each state and class, so it always fits.
TABLE_BYTES = 1 << 28
#: Classes of bytes at most: 26 letters, 128 bytes of other characters, the break, and all others.
CLASSES = 156
#: Bytes of a block.
BLOCK = 512
#: Texts with a smaller share of letters in the samples' scripts are in none of the languages.
KNOWN_LETTERS = 0.5
UNKNOWN = "und"
#: Which texts of a buffer can be judged.
Readable = Callable[[np.ndarray, np.ndarray], np.ndarray]

_BREAK = np.uint32(1 << 31)


# ---------------------------------------------------------------- learning


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case; each run of other ASCII characters becomes one zero byte."""
    out = lower_bytes(data)
    # Two-byte capitals of Latin-1 differ from the small ones by 32 in the second byte.
    after = np.flatnonzero(out[:-1] == 0xC3) + 1
    capitals = after[(out[after] >= 0x80) & (out[after] <= 0x9E) & (out[after] != 0x97)]
    out[capitals] += 32
    letter = (out >= 0x80) | ((out >= 97) & (out <= 122))
    out[~letter] = 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[offs[:-1][offs[:-1] < offs[1:]]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings of the text; state 0 begins."""
    go: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
        last = new
    return go


class Parser:
    """The automata of all languages in one table of (state, byte class)."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        seen = sorted(set(b"".join(samples.values())) | {0})
        self.classes = np.zeros(256, np.uint32)
        self.width = len(seen) + 1
        self.classes[:] = len(seen)
        self.classes[seen] = np.arange(len(seen))
        self.cost = np.array([np.log2(len(samples[lang]) + 2) for lang in self.languages])
        rows, self.roots, first = [], [], 0
        for lang in self.languages:
            go = suffix_automaton(samples[lang])
            root = np.full(self.width, np.uint32(first * self.width) | _BREAK, np.uint32)
            for c, s in go[0].items():
                root[self.classes[c]] = np.uint32((first + s) * self.width) | _BREAK
            part = np.tile(root, (len(go), 1))
            for s, arcs in enumerate(go):
                for c, t in arcs.items():
                    part[s, self.classes[c]] = (first + t) * self.width
            rows.append(part)
            self.roots.append(first * self.width)
            first += len(go)
        self.table = np.concatenate(rows).ravel() if rows else np.zeros(0, np.uint32)

    def phrases(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Number of phrases of each text (rows) in each language (columns)."""
        sizes = np.diff(offs)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = offs[owner] + nth * BLOCK
        length = np.minimum(BLOCK, offs[owner + 1] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        kinds = self.classes[data]
        state = np.repeat(np.array(self.roots, np.uint32)[:, None], len(owner), axis=1)
        count = np.zeros(state.shape, np.uint32)
        going = np.searchsorted(-length, -np.arange(1, BLOCK + 1), side="right")
        for t, active in enumerate(going):
            if not active:
                break
            now = self.table[state[:, :active] + kinds[begin[:active] + t]]
            count[:, :active] += now >> np.uint32(31)
            state[:, :active] = now & ~_BREAK
        out = np.zeros((len(sizes), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, count[k] + 1.0, len(sizes))
        return out


def sampled(labelled: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """(lang, nth, part): a bounded sample of the rows with text and label of every language, chosen by a hash of the id."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    starts = F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1
    start = F.pmod(F.xxhash64(F.lit("start"), F.col(doc_id)), starts) + 1
    rows = rows.select(
        F.col(lang).alias("lang"),
        F.xxhash64(doc_id).alias("draw"),
        F.substring(F.col(text), start.cast("int"), F.lit(SAMPLE_CHARS)).alias("part"),
    )
    first = Window.partitionBy("lang").orderBy("draw", "part")
    return rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= SAMPLE_DOCS).drop("draw")


def groups_of(sizes: list[tuple[str, int]]) -> list[tuple[str, str]]:
    """First and last language, by name, of groups whose tables fit in ``TABLE_BYTES``; a row is a name and its bytes."""
    groups: list[tuple[str, str]] = []
    held = 0
    for name, size in sorted(sizes):
        need = 2 * size * CLASSES * 4
        if groups and held + need <= TABLE_BYTES:
            groups[-1] = (groups[-1][0], name)
            held += need
        else:
            groups.append((name, name))
            held = need
    return groups


def learn(sample: DataFrame) -> Parser:
    """Automata of the languages of a sample."""
    texts_of: dict[str, list[str]] = {}
    for row in sample.orderBy("lang", "nth").collect():
        texts_of.setdefault(row["lang"], []).append(row["part"])
    parts = {}
    for name, texts in texts_of.items():
        data, offs = buffer_of(pa.array(texts, pa.string()))
        clean, at = normalised(data, offs)
        joined = b"\0".join(clean[a:b].tobytes() for a, b in zip(at[:-1], at[1:]))
        if joined.strip(b"\0"):
            parts[name] = joined
    return Parser(parts)


# ---------------------------------------------------------------- prediction


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letters = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128))])
    out = np.diff(ascii_letters[offs]) > 0
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    for i in np.flatnonzero(~out & (np.diff(wide[offs]) > 0)):
        out[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def lowest_costs(parser: Parser, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Cheapest language of the parser, its cost, the next cost and bytes for each phrase of every text of a buffer."""
    clean, at = normalised(data, offs)
    phrases = np.maximum(parser.phrases(clean, at), 1.0)
    cost = phrases * parser.cost
    best = cost.argmin(1)
    rows = np.arange(len(best))
    second = np.partition(cost, 1, axis=1)[:, 1] if len(parser.languages) > 1 else np.full(len(best), np.inf)
    return [parser.languages[b] for b in best], cost[rows, best], second, np.diff(at) / phrases[rows, best]


def predictions(
    parser: Parser, data: np.ndarray, offs: np.ndarray, readable: Readable = has_letter
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bytes for each phrase of every text of a buffer."""
    letters = readable(data, offs)
    if not parser.languages:
        return [UNKNOWN] * len(letters), np.zeros(len(letters)), np.zeros(len(letters))
    found, lowest, second, size = lowest_costs(parser, data, offs)
    names = [name if ok else UNKNOWN for name, ok in zip(found, letters)]
    return names, np.where(letters, 1.0 - lowest / second, 0.0), np.where(letters, size, 0.0)


def identify(
    docs: DataFrame,
    training: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: DataFrame | None = None,
    readable: Readable = has_letter,
) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (0 to 1) and phrase_bytes.

    Automata are learnt from ``training``, by default the rows of ``docs`` that
    are not held out, for every label.  A text that is null or has no letter of
    any script (or that is not ``readable``) is ``und`` with score 0, and so is
    every text if nothing can be learnt.  The score is one minus the ratio of the lowest cost to the next.
    Equal costs go to the first language by name.  Repeated rows get the same
    values; columns named like the added ones are replaced.

    Languages are taken in groups of bounded size.  With more than one group
    the texts are stored with a row number, parsed by one group after the other
    and joined to the lowest costs.
    """
    bounded_batches(docs.sparkSession)
    if sample is None:
        training = docs.filter(~held_out(F.col(doc_id), 0)) if training is None else training
        sample = stored(sampled(training, doc_id, text, lang), "sample")
    # One row for each label.
    sizes = sample.groupBy("lang").agg(F.sum(F.octet_length("part") + 1).alias("size")).collect()
    groups = groups_of([(r["lang"], r["size"]) for r in sizes])
    added = ("lang_pred", "score", "phrase_bytes")
    names = [c for c in docs.columns if c not in added]
    chosen = docs.select(*[F.col(f"`{c}`") for c in names])
    if len(groups) > 1:
        return in_groups(chosen, sample, groups, text, readable)
    parser = docs.sparkSession.sparkContext.broadcast(learn(sample))
    schema = chosen.select("*").schema
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffer_of(batch.column(place))
            found: tuple[list, list, list] = ([], [], [])
            for _, _, part, at in pieces(data, offs):
                for into, values in zip(found, predictions(parser.value, part, at, readable)):
                    into.extend(values)
            columns = [
                pa.array(found[0], pa.string()),
                pa.array(np.array(found[1], np.float64)),
                pa.array(np.array(found[2], np.float64)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *added])

    out = schema.add("lang_pred", "string").add("score", "double").add("phrase_bytes", "double")
    return chosen.mapInArrow(run, out)


def in_groups(
    docs: DataFrame, sample: DataFrame, groups: list[tuple[str, str]], text: str, readable: Readable = has_letter
) -> DataFrame:
    """``docs`` with the added columns, by one group of languages after the other."""
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("docs_row")
    numbered = stored(docs.select(row).withColumn("row", F.monotonically_increasing_id()), "numbered")
    costs = None
    for first, last in groups:
        learnt = learn(sample.filter(F.col("lang").between(first, last)))
        if not learnt.languages:
            continue
        parser = spark.sparkContext.broadcast(learnt)

        def run(batches: Iterator[pa.RecordBatch], parser=parser) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offs = buffer_of(batch.column(1))
                for a, b, part, at in pieces(data, offs):
                    letters = pa.array(readable(part, at))
                    columns = [batch.column(0).slice(a, b - a), *[pa.array(c) for c in lowest_costs(parser.value, part, at)]]
                    columns = [c.filter(letters) for c in columns]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "lang", "lowest", "second", "size"])

        found = numbered.select("row", F.col("docs_row").getField(text).alias("text"))
        found = stored(found.mapInArrow(run, "row bigint, lang string, lowest double, second double, size double"), "costs")
        parser.unpersist()
        costs = found if costs is None else costs.unionByName(found)
    if costs is None:
        best = numbered.select("row").limit(0).selectExpr("row", "'' AS lang_pred", "0D AS score", "0D AS phrase_bytes")
    else:
        best = costs.groupBy("row").agg(
            F.min(F.struct("lowest", "lang", "size")).alias("best"),
            F.array_sort(F.flatten(F.collect_list(F.array("lowest", "second")))).alias("all"),
        )
        score = (1.0 - F.col("best.lowest") / F.get("all", F.lit(1))).alias("score")
        best = best.select("row", F.col("best.lang").alias("lang_pred"), score, F.col("best.size").alias("phrase_bytes"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("score", "phrase_bytes")]
    pred = F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred")
    return numbered.join(best, "row", "left").select("docs_row.*", pred, *zero)


def known_blocks(sample: DataFrame) -> list[int]:
    """The blocks of 128 code points that a sample has letters of; bounded as the blocks are."""
    letters = F.explode(F.regexp_extract_all("part", F.lit(r"\p{L}"), F.lit(0))).alias("letter")
    blocks = sample.select(letters).select(F.shiftright(F.ascii("letter"), 7).alias("block")).distinct()
    return sorted(r["block"] for r in blocks.collect())


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_counts(data: np.ndarray, offs: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each text of a buffer, and those in known blocks."""
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    at = np.flatnonzero((data < 0x80) | (data >= 0xC0))
    first, *rest = (padded[at + k].astype(np.int32) for k in range(4))
    two = (first & 31) << 6 | rest[0] & 63
    three = (first & 15) << 12 | (rest[0] & 63) << 6 | rest[1] & 63
    four = (first & 7) << 18 | (rest[0] & 63) << 12 | (rest[1] & 63) << 6 | rest[2] & 63
    points = np.where(first < 0x80, first, np.where(first < 0xE0, two, np.where(first < 0xF0, three, np.minimum(four, 0x10FFFF))))
    letter = letters()[points]
    limits = np.searchsorted(at, offs)
    sums = [np.concatenate([[0], np.cumsum(x)])[limits] for x in (letter, letter & known[points >> 7])]
    return np.diff(sums[0]), np.diff(sums[1])


def in_known_language(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` that are in one of its languages, with the columns of ``identify``.

    A text is in none of them if it has no letters, or if less than the share
    ``KNOWN_LETTERS`` of its letters are of a script (a block of code points)
    that the labelled sample of any language has letters of.  The rule is the same for a text of one letter and a long one.
    Without a labelled row every text goes.
    """
    training = docs.filter(~held_out(F.col(doc_id), 0))
    sample = stored(sampled(training, doc_id, text, lang), "sample")
    known = np.zeros(0x110000 >> 7, bool)
    known[known_blocks(sample)] = True

    def readable(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        all_letters, of_known = letter_counts(data, offs, known)
        return (all_letters > 0) & (of_known >= KNOWN_LETTERS * all_letters)

    found = identify(docs, None, doc_id, text, lang, sample, readable)
    return found.filter(F.col("lang_pred") != UNKNOWN)


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = identify(docs.select("doc_id", "text"), docs.filter(~held_out(F.col("doc_id"), 0)))
    return found.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "lang_pred", "score", "phrase_bytes")
