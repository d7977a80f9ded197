"""Exact similarity join of shingle sets, and the components of its links.

Documents with the same set are one node.  Two sets that are similar enough
share some of their rarest elements: the order is by how frequent an element is
in the corpus (by a sketch of fixed size, which only decides the order), and a
set announces itself under its first few.  Each node goes home to the announced
element that most nodes share, and visits the homes of nodes that it shares
enough others with.

The nodes of a home make tiles by bands of size: only sets of one band or of
the next one can be similar.  In a tile, signatures (bitmaps of hashed
elements) are compared first: the number of bits in which two differ bounds
their overlap from above.  Only the sets that may have a partner by that are
fetched, and intersections of the sorted arrays decide.  A tile gives a
spanning forest of its links, so groups of any size make no more rows than
nodes.  Large tiles are cut into blocks, and each pair of blocks is a task of
its own.
"""

from __future__ import annotations

import math
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
    lower_bytes,
    mix,
    multipliers,
    offsets_of,
    pieces,
    ragged,
    signed,
    stored,
    table,
    word_spans,
)

#: Counters of the sketch of element frequencies.
SKETCH = 1 << 22
#: Elements among which a task looks for recurring ones.
COUNTED = 1 << 22
#: Nodes, and elements of all of them together, in a block of a tile.
BLOCK_NODES = 2048
BLOCK_ELEMENTS = 1 << 21
#: Documents that may be sent to all workers as a list of ids.
SMALL_LIST = 300_000


# ---------------------------------------------------------------- sets


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text of a buffer."""
    low = lower_bytes(data)
    starts, ends, first = word_spans(low, offs)
    words = hash_spans(low, starts, ends)
    all_grams = grams(words, width, 11)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            yield np.unique(all_grams[a : b - width + 1])
        elif b > a:
            short = (words[a:b] * multipliers(b - a, 13)).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def node_of(s: np.ndarray) -> np.uint64:
    """Identity of a set."""
    return mix(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0]


def sets_of(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, int, int, list]]:
    """Batch, first and last row, and their sets, piece by piece."""
    for batch in batches:
        data, offs = buffer_of(batch.column(column))
        for first, last, part, at in pieces(data, offs):
            yield batch, first, last, list(shingle_sets(part, at, width))


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Roughly how many sets hold an element, as a power of two, by the element's hash; of fixed size.

    Tasks count the elements that recur within ``COUNTED`` of theirs and leave
    out the others, the great majority.  Only elements that make up one in
    ``SKETCH`` of what was counted enter, so there are at most that many.
    """

    def recurring(flat: list[np.ndarray]) -> pa.RecordBatch:
        element, n = np.unique(np.concatenate(flat), return_counts=True)
        element, n = element[n > 1], n[n > 1]
        return pa.RecordBatch.from_arrays([pa.array(signed(element)), pa.array(n)], names=["element", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, held = [], 0
        for _, _, _, sets in sets_of(batches, 0, width):
            flat += sets
            held += sum(map(len, sets))
            if held >= COUNTED:
                yield recurring(flat)
                flat, held = [], 0
        if flat:
            yield recurring(flat)

    found = docs.select("text").mapInArrow(run, "element bigint, n bigint")
    counts = stored(found.groupBy("element").agg(F.sum("n").alias("n")), "recurring")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    place = F.shiftrightunsigned("element", 42)
    steps = (
        counts.filter(F.col("n") * SKETCH >= F.lit(total))
        .groupBy(place.alias("place"))
        .agg(F.max(F.floor(F.log2("n"))).alias("steps"))
        .toArrow()
    )
    out = np.zeros(SKETCH, np.uint8)
    out[steps.column("place").to_numpy()] = steps.column("steps").to_numpy()
    return out


def shared_elements(percent: int) -> int:
    """Elements that prefixes of similar sets share: different sets above two thirds have three in common at least."""
    return 3 if percent > 66 else 1


def prefix_size(n: int, percent: int) -> int:
    """Elements of which similar sets share ``shared_elements``: n less the smallest overlap, plus those."""
    return min(n, n - -(-percent * n // 100) + shared_elements(percent))


def band_of(n: int, percent: int) -> int:
    """Band of a size; similar sets are in one band or in neighbouring ones."""
    return int(math.floor(math.log(n) / -math.log(percent / 100) + 1e-9))


def bits_of(band: int, percent: int) -> int:
    """Bits of a signature in a tile: a power of two, not below the largest size of its band."""
    return max(64, 1 << math.ceil((band + 1) * math.log2(100 / percent)))


def signature(s: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of hashed elements."""
    at = mix(s) & np.uint64(bits - 1)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def announced(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(row, doc_id, n, node, band, prefix, own_bits, guest_bits) of each document's set.

    These are its size, identity, rarest elements, and signatures for the tiles
    of its own band and of the next.
    """
    frequency = docs.sparkSession.sparkContext.broadcast(sketch(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, last, sets in sets_of(batches, 2, width):
            sizes = np.array([len(s) for s in sets], np.int64)
            nodes = np.zeros(len(sets), np.uint64)
            bands = np.zeros(len(sets), np.int32)
            parts, limits, signatures = [], [0], ([], [])
            for k, s in enumerate(sets):
                if len(s):
                    nodes[k] = node_of(s)
                    bands[k] = band_of(len(s), percent)
                    for into, band in zip(signatures, (bands[k], bands[k] + 1)):
                        into.append(signature(s, bits_of(int(band), percent)).tobytes())
                    order = np.lexsort((s, frequency.value[(s >> np.uint64(42)).astype(np.int64)]))
                    parts.append(s[order[: prefix_size(len(s), percent)]])
                    limits.append(limits[-1] + len(parts[-1]))
                else:
                    limits.append(limits[-1])
                    for into in signatures:
                        into.append(b"")
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            columns = [
                *[c.slice(first, last - first) for c in batch.columns[:2]],
                pa.array(sizes),
                pa.array(signed(nodes)),
                pa.array(bands),
                ragged(signed(flat), np.array(limits), pa.int64()),
                *[pa.array(x, pa.binary()) for x in signatures],
            ]
            names = ["row", "doc_id", "n", "node", "band", "prefix", "own_bits", "guest_bits"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "row bigint, doc_id bigint, n bigint, node bigint, band int, prefix array<bigint>, own_bits binary, guest_bits binary"
    return docs.select("row", "doc_id", "text").mapInArrow(run, kind)


# ---------------------------------------------------------------- tiles


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Forest:
    """Disjoint groups of numbers 0 to n - 1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up


def partners(i: int, sizes: np.ndarray, bitmaps: np.ndarray, own: np.ndarray, side: np.ndarray, at_home: np.ndarray, percent: int) -> np.ndarray:
    """Later members that member i may be similar to, by sizes and by a bound of the overlap.

    Pairs need a member of the tile's own band and one that is at home here;
    where two blocks meet, one of each.
    """
    rest = np.arange(i + 1, len(sizes))
    small, large = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
    may = (100 * small >= percent * large) & (own[i] | own[rest]) & (at_home[i] | at_home[rest])
    if side.any():
        may &= side[i] != side[rest]
    rest = rest[may]
    # The bits that differ are elements of one set only: they bound the overlap from above.
    apart = np.bitwise_count(bitmaps[rest] ^ bitmaps[i]).sum(1, dtype=np.int64)
    overlap = (sizes[i] + sizes[rest] - apart) // 2
    return rest[100 * overlap >= percent * (sizes[i] + sizes[rest] - overlap)]


def promising(sizes: np.ndarray, bitmaps: np.ndarray, own: np.ndarray, side: np.ndarray, at_home: np.ndarray, percent: int) -> np.ndarray:
    """Which members of a tile have a partner."""
    out = np.zeros(len(sizes), bool)
    for i in range(len(sizes) - 1):
        found = partners(i, sizes, bitmaps, own, side, at_home, percent)
        if found.size:
            out[i] = out[found] = True
    return out


def tile_links(sets: list[np.ndarray], own: np.ndarray, side: np.ndarray, at_home: np.ndarray, band: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links that this tile decides, as pairs of places."""
    sizes = np.array([len(s) for s in sets], np.int64)
    bitmaps = np.stack([signature(s, bits_of(band, percent)) for s in sets])
    forest, links = Forest(len(sets)), []
    for i in range(len(sets) - 1):
        rest = partners(i, sizes, bitmaps, own, side, at_home, percent)
        rest = rest[forest.roots()[rest] != forest.root(i)] if rest.size else rest
        for j in rest.tolist():
            a, b = forest.root(i), forest.root(j)
            if a != b and similar(sets[i], sets[j], percent):
                forest.parent[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


TILE = ["home", "band", "one", "two"]


def members_of(batches: Iterator[pa.RecordBatch], payload) -> Iterator[tuple[tuple, list[tuple]]]:
    """Tile and its members (side, own, at_home, node, payload) from rows sorted by tile."""
    now, members = None, []
    for batch in batches:
        keys = list(zip(*[batch.column(k).to_pylist() for k in range(4)]))
        rows = zip(*[batch.column(k).to_pylist() for k in range(4, 8)], payload(batch.column(8)))
        for key, row in zip(keys, rows):
            if key != now:
                if len(members) > 1:
                    yield now, members
                now, members = key, []
            members.append(row)
    if len(members) > 1:
        yield now, members


def in_tiles(rows: DataFrame, payload: str) -> DataFrame:
    return (
        rows.select(*TILE, "side", "own", "at_home", "node", payload)
        .repartition(*TILE)
        .sortWithinPartitions(*TILE, "node")
    )


def promising_members(rows: DataFrame, percent: int) -> DataFrame:
    """The tile rows whose signature (``sig``) lets them have a partner: tile and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, members in members_of(batches, lambda c: c.to_pylist()):
            side, own, home, node, sig = zip(*members)
            # A signature is led by the size of the set.
            sizes = np.array([int.from_bytes(x[:8], "big") for x in sig], np.int64)
            bitmaps = np.stack([np.frombuffer(x[8:], np.uint64) for x in sig])
            found = promising(sizes, bitmaps, np.array(own), np.array(side), np.array(home), percent)
            if found.any():
                chosen = [n for n, ok in zip(node, found.tolist()) if ok]
                columns = [pa.array([k] * len(chosen), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(chosen, pa.int64())], names=[*TILE, "node"])

    return in_tiles(rows, "sig").mapInArrow(run, "home bigint, band int, one int, two int, node bigint")


def links_of_tiles(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the tile rows with their ``elements``."""

    def arrays(lists: pa.ListArray) -> Iterator[np.ndarray]:
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        limits = offsets_of(lists)
        return (flat[a:b].copy() for a, b in zip(limits[:-1], limits[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, members in members_of(batches, arrays):
            side, own, home, node, sets = zip(*members)
            found = tile_links(list(sets), np.array(own), np.array(side), np.array(home), key[1], percent)
            if found:
                ends = [pa.array([node[p[k]] for p in found], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    return in_tiles(rows, "elements").mapInArrow(run, "a bigint, b bigint")


def tiles(nodes: DataFrame, percent: int) -> DataFrame:
    """(home, band, one, two, side, own, at_home, node) rows of all tiles with a pair to decide.

    ``nodes`` has a row (node, n, band, prefix) for each document.
    """
    said = nodes.select("node", "n", "band", F.explode("prefix").alias("element"))
    shared = said.groupBy("element").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    meeting = stored(said.join(shared.select("element"), "element").distinct(), "meeting")
    popular = meeting.groupBy("element").agg(F.count("*").alias("nodes"))
    ranked = meeting.join(popular, "element")
    homes = ranked.groupBy("node").agg(F.max(F.struct("nodes", "element")).alias("home"))
    settled = stored(meeting.join(homes, "node"), "settled")
    # How many elements a node shares with the nodes of a home, its own or one that is not below it.
    at = settled.groupBy("element", F.col("home").alias("other")).agg(F.count("*").alias("members"))
    met = stored(
        settled.join(at, "element")
        .filter((F.col("other") > F.col("home")) | ((F.col("other") == F.col("home")) & (F.col("members") > 1)))
        .groupBy("node", "n", "band", "home", "other")
        .agg(F.count("*").alias("shared"))
        .filter(F.col("shared") >= shared_elements(percent)),
        "met",
    )
    row = ["node", "n", F.col("band").alias("its")]
    away = met.filter("other <> home").select(*row, F.col("other").alias("to"), F.lit(False).alias("at_home"))
    residents = settled.select("node", "n", "band", "home").distinct()
    hosts = residents.join(away.select(F.col("to").alias("home")).distinct(), "home", "left_semi")
    living = met.filter("other = home").select("node", "n", "band", "home").union(hosts.select("node", "n", "band", "home"))
    visits = away.union(living.distinct().select(*row, F.col("home").alias("to"), F.lit(True).alias("at_home")))
    bands = F.array(
        F.struct(F.col("its").alias("band"), F.lit(True).alias("own")),
        F.struct((F.col("its") + 1).alias("band"), F.lit(False).alias("own")),
    )
    placed = visits.select(
        F.col("to.element").alias("home"), "node", "n", "at_home", F.explode(bands).alias("b")
    ).select("home", "node", "n", "at_home", "b.band", "b.own")
    placed = stored(placed, "placed")
    sizes = (
        placed.groupBy("home", "band")
        .agg(F.count("*").alias("members"), F.sum("n").alias("elements"), F.max("own").alias("owns"), F.max("at_home").alias("lives"))
        .filter("members > 1 and owns and lives")
        .select(
            "home",
            "band",
            F.greatest(
                F.ceil(F.col("members") / BLOCK_NODES), F.ceil(F.col("elements") / BLOCK_ELEMENTS)
            ).cast("int").alias("blocks"),
        )
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(
            F.least(k, F.col("block")).alias("one"),
            F.greatest(k, F.col("block")).alias("two"),
            (F.col("block") > k).cast("int").alias("side"),
        ),
    )
    return (
        placed.join(sizes, ["home", "band"])
        .withColumn("block", block)
        .withColumn("meet", F.explode(meets))
        .select("home", "band", "meet.one", "meet.two", "meet.side", "own", "at_home", "node")
    )


def links(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) links between nodes; those of a tile are a spanning forest."""
    placed = stored(tiles(sets.filter("n > 0").select("node", "n", "band", "prefix"), percent), "tiles")
    size = F.unhex(F.lpad(F.hex("n"), 16, "0"))
    known = sets.select("node", "own_bits", "guest_bits", size.alias("size")).join(
        placed.select("node").distinct(), "node", "left_semi"
    ).dropDuplicates(["node"])
    sig = F.concat("size", F.when(F.col("own"), F.col("own_bits")).otherwise(F.col("guest_bits")))
    passed = stored(promising_members(placed.join(known, "node").withColumn("sig", sig), percent), "promising")
    placed = stored(placed.join(passed, [*TILE, "node"], "left_semi"), "members")
    # One text stands for each node whose set is needed.
    needed = placed.select("node").distinct()
    chosen = stored(sets.select("node", "row").join(needed, "node").groupBy("node").agg(F.min("row").alias("row")), "chosen")
    if chosen.count() <= SMALL_LIST:
        chosen = F.broadcast(chosen)
    texts = docs.select("row", "text").join(chosen, "row").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, last, found in sets_of(batches, 1, width):
            limits = np.concatenate([[0], np.cumsum([len(s) for s in found])])
            flat = signed(np.concatenate(found)) if found else np.zeros(0, np.int64)
            columns = [batch.column(0).slice(first, last - first), ragged(flat, limits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "elements"])

    arrays = texts.mapInArrow(run, "node bigint, elements array<bigint>")
    # A short list of tiles goes to the sets, so that these move only once.
    listed = F.broadcast(placed) if placed.count() <= SMALL_LIST else placed
    return links_of_tiles(arrays.join(listed, "node"), percent)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node with an edge can reach.

    Every node points to the smallest of its neighbours and itself, and edges
    are moved to those, until nothing changes; each round at least halves
    long chains.  Rounds are cut by stored tables.
    """
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = stored(both, "edges")
    while True:
        # Large star: all larger neighbours of a node point to its smallest neighbour.
        around = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("low"))
        large = (
            around.join(least, "a")
            .filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
            .distinct()
        )
        # Small star: all smaller neighbours of a node, and the node, point to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("x"), "low"), F.struct(F.col("b").alias("x"), "low"))).alias("e"))
            .select(F.col("e.x").alias("a"), F.col("e.low").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        after = stored(small, "edges")
        if after.count() == now.count() and after.exceptAll(now).isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = after


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, row, stays) of each row of ``docs`` (doc_id, text).

    Words are runs of other bytes than white space with A-Z in lower case; a
    set holds the distinct sequences of ``width`` words, or the whole sequence
    of a shorter text.  Two documents link if their sets' intersection is at
    least ``percent`` of the union.  ``component_id`` is the smallest id that
    links reach.  A text without words, or null, has size 0 and links with
    nothing, and its component is itself.  Repeated rows share their component;
    an empty table gives an empty table.  Texts of any length are read whole.

    ``stays`` holds for one row of each component, of the rows with the smallest
    id that with the smallest ``row`` (a hash of id and text), and for rows
    without an id or without words.
    """
    bounded_batches(docs.sparkSession)
    free_shuffles(docs.sparkSession)
    docs = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    sets = stored(announced(docs, width, percent), "sets")
    edges = stored(links(docs, sets, width, percent), "links")
    grouped = sets.select("doc_id", "row", "n", "node").join(components(edges), "node", "left")
    grouped = grouped.withColumn("group", F.coalesce("root", "node"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))
    least = grouped.filter("n > 0").groupBy("group").agg(F.min(named).alias("least"))
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return grouped.join(least, "group", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "row",
        (alone | (F.col("row") == F.col("least.row"))).alias("stays"),
    )


def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents"), width=4, percent=85)
