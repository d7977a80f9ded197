"""Token ids, label masks and packed blocks of training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convprep.functions.tokens import split_words
from convprep.operators.running import WIDTH, running_total
from convprep.profiles import BEGIN, CONTROL_TOKENS, TURN_END

IGNORED = -100

BEGIN_ID, END_ID = CONTROL_TOKENS.index(BEGIN), CONTROL_TOKENS.index(TURN_END)


def word_ids(text: Column, vocabulary: int = 50000) -> Column:
    """Ids without a dictionary: control tokens are numbered, words are hashed."""
    controls = F.array(*[F.lit(t) for t in CONTROL_TOKENS])

    def word_id(word: Column) -> Column:
        known = F.when(F.startswith(word, F.lit("<")), F.array_position(controls, word)).otherwise(0)
        hashed = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")
        return F.when(known > 0, known - 1).otherwise(hashed % vocabulary + len(CONTROL_TOKENS)).cast("int")

    return F.transform(split_words(text), word_id)


def with_special(
    ids: Column, begin: int = BEGIN_ID, end: int = END_ID, limit: int | Column | None = None
) -> Column:
    """Ids with begin and end token, cut at ``limit``, the chosen sequence length."""
    full = F.concat(F.array(F.lit(begin)), ids, F.array(F.lit(end)))
    return full if limit is None else F.slice(full, F.lit(1), F.lit(limit) if isinstance(limit, int) else limit)


def label_mask(ids: Column, marker: int) -> Column:
    """Labels that ignore everything up to the last marker; without one, everything."""
    last = F.size(ids) - F.array_position(F.reverse(ids), F.lit(marker))
    found = F.array_contains(ids, F.lit(marker))
    return F.transform(ids, lambda x, i: F.when(found & (i > last), x).otherwise(IGNORED))


def pack(
    samples: DataFrame,
    length: int,
    shards: int = 64,
    end: int | None = END_ID,
    keep_tail: bool = True,
    width: int | None = WIDTH,
) -> DataFrame:
    """``shard, block, ids``: the samples of a shard end to end, cut every ``length`` tokens.

    ``samples`` has ``chat_id`` of any type, integer ``turn``, and ``ids`` with
    their number ``n_ids``; it is read for the sizes and again for the ids, so
    give it as a stored table.  ``end`` is put after each sample.  A chat is
    placed by a digest of its id, in one of 65,536 slots dealt over the shards;
    inside a slot chats go by id.  Offsets come from running totals of sizes
    over slots and inside them, so only numbers are ordered, whatever the ids;
    a block gathers at most ``length`` tokens.  The last block of a shard may
    be shorter and can be left out.
    """
    closed = F.col("ids") if end is None else F.concat("ids", F.array(F.lit(end)))
    slot = F.conv(F.substring(F.md5(F.col("chat_id").cast("string")), 1, 4), 16, 10).cast("long")
    shard = F.pmod(slot, F.lit(shards)).alias("shard")
    rows = samples.select(shard, "chat_id", "turn", closed.alias("ids"))
    size = F.col("n_ids").cast("long") + (0 if end is None else 1)
    sizes = samples.select(shard, slot.alias("_slot"), "chat_id", "turn", size.alias("_n"))
    chats = sizes.groupBy("shard", "_slot", "chat_id").agg(F.sum("_n").alias("_n"))
    slots = chats.groupBy("shard", "_slot").agg(F.sum("_n").alias("_n"))
    slots = running_total(slots, ["shard"], "_slot", "_n", "_slot_at", None).drop("_n")
    inside = Window.partitionBy("shard", "_slot").orderBy("chat_id").rowsBetween(Window.unboundedPreceding, -1)
    chats = (
        chats.withColumn("_in_slot", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(slots, ["shard", "_slot"])
        .select("shard", "chat_id", (F.col("_slot_at") + F.col("_in_slot")).alias("_chat_at"))
    )
    sizes = sizes.drop("_slot")
    inside = running_total(sizes, ["shard", "chat_id"], "turn", "_n", "_turn_at", width)
    places = inside.join(chats, ["shard", "chat_id"]).select(
        "chat_id", "turn", (F.col("_chat_at") + F.col("_turn_at")).alias("at")
    )
    placed = rows.join(places, ["chat_id", "turn"])
    block = F.explode(F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + size(ids) - 1) div {length}")))
    cuts = placed.select("shard", "at", "ids", block.alias("block"))
    skip = F.greatest(F.col("block") * length - F.col("at"), F.lit(0))
    room = (F.col("block") + 1) * length - F.greatest(F.col("at"), F.col("block") * length)
    piece = F.slice("ids", (skip + 1).cast("int"), room.cast("int"))
    blocks = (
        cuts.select("shard", "block", F.struct("at", piece.alias("ids")).alias("_piece"))
        .groupBy("shard", "block")
        .agg(F.array_sort(F.collect_list("_piece")).alias("_pieces"))
        .select("shard", "block", F.flatten(F.transform("_pieces", lambda x: x["ids"])).alias("ids"))
    )
    return blocks if keep_tail else blocks.filter(F.size("ids") == length)
