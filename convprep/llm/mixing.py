"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens flows down a tree of domain, language and source.  At each
node it is divided among the children by their weights, up to what each can
give; what one can't give goes to its siblings by their weights, and only what
all of them can't give is left to the parent's siblings.  As a node's capacity
is the sum of its leaves', one division of each level from the root does this.

A leaf gives its documents in seeded epochs: each epoch has an order of its
own, whole epochs are taken first, and of the last one a prefix that fits.
Documents are placed in ``BUCKETS`` buckets by their order key; sums over the
buckets find the one in which the prefix ends, and only that bucket's rows are
ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convprep.llm.common import WORD, stored, table

BUCKETS = 4096
#: Leaves that may be sent to all workers.
SMALL_TREE = 20_000
LEVELS = ("domain", "lang", "source")
#: Parameters of the query and the pipeline's stage.
SEED = 17
DOMAINS = 4
DOMAIN_WEIGHTS = {"domain0": 4.0, "domain1": 2.0, "domain2": 1.0, "domain3": 1.0}
LANG_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}
OTHER_WEIGHT = 1.0


def tokens_in(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """A domain for each source: one of ``DOMAINS``, by the source's name."""
    digits = F.conv(F.substring(F.md5(source.cast("binary")), 1, 6), 16, 10).cast("long")
    return F.concat(F.lit("domain"), (digits % DOMAINS).cast("string"))


def weight_of(name: Column, weights: dict[str, float]) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for key, weight in weights.items():
        out = F.when(name == key, F.lit(weight)).otherwise(out)
    return out


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """Hexadecimal digits by which an epoch is ordered."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.md5(name.cast("binary"))


def divided(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``children`` (parent columns, child, capacity, weight, budget) with quota, the child's whole tokens.

    Children fill in the order of capacity by weight.  The level up to which
    the others are filled is the largest of the levels that hold if exactly
    the ones before are full.
    """
    order = Window.partitionBy(*parent).orderBy("ratio", child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(onward)
    filled = (
        children.withColumn("ratio", F.col("capacity") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(whole))
        .withColumn("share", F.least(F.col("capacity").cast("double"), F.col("level") * F.col("weight")))
        .withColumn("quota", F.floor(F.col("share") + 1e-6))
        .withColumn("room", F.when(F.col("quota") < F.col("capacity"), F.col("share") - F.col("quota")).otherwise(F.lit(-1.0)))
    )
    # Tokens lost by rounding go to the largest remainders.
    nth = F.row_number().over(Window.partitionBy(*parent).orderBy(F.round("room", 6).desc(), child))
    lost = F.col("budget") - F.sum("quota").over(whole)
    more = (nth <= lost) & (F.col("room") >= 0)
    return filled.withColumn("quota", F.col("quota") + F.when(more, 1).otherwise(0)).drop("ratio", "level", "share", "room")


def leaf_quotas(leaves: DataFrame, budget: Column, epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, quota) of leaves (domain, lang, source, tokens); weights of the names."""
    held = leaves.withColumn("capacity", F.col("tokens") * epochs)
    weights = (weight_of(F.col("domain"), DOMAIN_WEIGHTS), weight_of(F.col("lang"), LANG_WEIGHTS), F.lit(OTHER_WEIGHT))
    above = held.agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).select(
        F.lit(0).alias("root"), F.least("capacity", budget).cast("long").alias("budget")
    )
    parent = ["root"]
    held = held.withColumn("root", F.lit(0))
    for name, weight in zip(LEVELS, weights):
        nodes = held.groupBy(*parent, name).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight)
        above = divided(nodes.join(above, parent), parent, name).select(*parent, name, F.col("quota").alias("budget"))
        parent = [*parent, name]
    return held.join(above, parent).select(*LEVELS, "tokens", F.col("budget").alias("quota"))


def mixed(docs: DataFrame, percent: int = 60, epochs: int = 2, seed: int = SEED) -> DataFrame:
    """The chosen rows of ``docs`` (doc_id, text, lang, source and others), with domain, n_tokens and epoch.

    The budget is ``percent`` of all tokens; a document comes at most
    ``epochs`` times, once for each epoch from 0.  Null languages and sources
    are leaves named ``none``.  A leaf gives at most its quota; documents
    without words cost nothing and come with the prefix that they are in.
    Equal order keys go by id; rows that repeat an id count each.  An empty
    table gives an empty table; columns with the added names are replaced.
    """
    added = ("domain", "n_tokens", "epoch")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("row"),
        F.col("doc_id").alias("id"),
        F.coalesce("lang", F.lit("none")).alias("lang"),
        F.coalesce("source", F.lit("none")).alias("source"),
        tokens_in(F.col("text")).alias("n_tokens"),
    ).withColumn("domain", domain_of(F.col("source")))
    sums = stored(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    leaves = leaf_quotas(sums, F.floor(F.col("tokens") * percent / 100), epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(F.lit(epochs))
    plan = stored(
        leaves.withColumn("whole", whole.cast("int")).withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens")),
        "quotas",
    )
    small = plan.count() <= SMALL_TREE
    near = F.broadcast(plan) if small else plan
    keyed = rows.join(near.select(*LEVELS, "whole", "rest"), list(LEVELS))
    key = order_key(F.col("id"), F.col("whole"), seed)
    keyed = keyed.withColumn("key", key).withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    # Where the prefix of each leaf ends, from sums over its buckets.
    along = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        keyed.filter(F.col("whole") < epochs)
        .groupBy(*LEVELS, "bucket", "rest")
        .agg(F.sum("n_tokens").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
        .filter(F.col("before") <= F.col("rest"))
        .groupBy(*LEVELS)
        .agg(F.max(F.struct("bucket", "before")).alias("end"))
        .select(*LEVELS, F.col("end.bucket").alias("last"), (F.col("end.before")).alias("before"))
    )
    ends = stored(ends, "ends")
    placed = keyed.join(F.broadcast(ends) if small else ends, list(LEVELS), "left")
    inner = placed.filter(F.coalesce(F.col("bucket") != F.col("last"), F.lit(True))).withColumn(
        "more", F.coalesce(F.col("bucket") < F.col("last"), F.lit(False)).cast("int")
    )
    running = Window.partitionBy(*LEVELS).orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter(F.col("bucket") == F.col("last")).withColumn(
        "more", (F.col("before") + F.sum("n_tokens").over(running) <= F.col("rest")).cast("int")
    )
    out = ["row", "domain", "n_tokens", "whole", "more"]
    copies = inner.select(*out).unionByName(edge.select(*out)).withColumn("copies", F.col("whole") + F.col("more"))
    return copies.filter("copies > 0").select(
        "row.*", "domain", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch")
    )


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixed(table(spark, folder, "documents"))
    return rows.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _case(name: str, weights: dict[str, float]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + f" ELSE {OTHER_WEIGHT} END"


def _level(name: str, source: str, budgets: str, parent: list[str], child: str, weight: str) -> str:
    """SQL of one level, written for rows in memory: the level is sought among all children of a node."""
    keys = ", ".join(parent)
    return f"""
{name}_c AS (
  SELECT {keys}, {child}, sum(capacity)::BIGINT AS capacity, CAST({weight} AS DOUBLE) AS weight FROM {source} GROUP BY {keys}, {child}
), {name}_r AS (
  SELECT c.*, b.budget, capacity / weight AS ratio FROM {name}_c c JOIN {budgets} b USING ({keys})
), {name}_l AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER (PARTITION BY {keys} ORDER BY ratio, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (PARTITION BY {keys} ORDER BY ratio, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS one
  FROM {name}_r
), {name}_s AS (
  SELECT *, least(capacity::DOUBLE, max(one) OVER (PARTITION BY {keys}) * weight) AS share FROM {name}_l
), {name}_q AS (
  SELECT *, floor(share + 1e-6)::BIGINT AS base,
    CASE WHEN floor(share + 1e-6) < capacity THEN share - floor(share + 1e-6) ELSE -1.0 END AS room FROM {name}_s
), {name}_b AS (
  SELECT {keys}, {child}, base + CASE WHEN room >= 0 AND
    row_number() OVER (PARTITION BY {keys} ORDER BY round(room, 6) DESC, {child}) <= budget - sum(base) OVER (PARTITION BY {keys})
    THEN 1 ELSE 0 END AS budget FROM {name}_q
)"""


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents
), t AS (
  SELECT *, 'domain' || (('0x' || left(md5(source), 6))::BIGINT % {DOMAINS}) AS domain, 0 AS root FROM d
), leaf AS (
  SELECT root, domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (2 * sum(n_tokens))::BIGINT AS capacity FROM t GROUP BY ALL
), top AS (
  SELECT 0 AS root, least(sum(capacity), floor(sum(tokens) * 60 / 100))::BIGINT AS budget FROM leaf
), {_level("a", "leaf", "top", ["root"], "domain", _case("domain", DOMAIN_WEIGHTS))},
{_level("b", "leaf", "a_b", ["root", "domain"], "lang", _case("lang", LANG_WEIGHTS))},
{_level("c", "leaf", "b_b", ["root", "domain", "lang"], "source", str(OTHER_WEIGHT))},
q AS (
  SELECT leaf.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 2 END AS whole, budget FROM leaf JOIN c_b USING (root, domain, lang, source)
), k AS (
  SELECT t.*, whole, budget - whole * tokens AS rest,
    md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM t JOIN q USING (root, domain, lang, source)
), p AS (
  SELECT *, whole + CASE WHEN whole < 2 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) <= rest
    THEN 1 ELSE 0 END AS copies FROM k
)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, n_tokens, e.epoch::INTEGER AS epoch
FROM p, (SELECT unnest([0, 1]) AS epoch) e WHERE e.epoch < copies
"""
