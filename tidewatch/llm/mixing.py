"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

Sources get word targets by weight, capped and reshared. Each source's documents
lie in blocks by hash; a target is so many whole passes over a source and a part
of one more, cut at a block (and inside that, at one document). The exact
numbers of block draws per source are then divided among output shards by a
binary tree: a node halves its draws at random, which splits the sources' quotas
by the multivariate hypergeometric law and keeps every sum. One random order of
all draws serves all levels, as the halves of a random order are random halves;
it is found by counting draws in ranges of their hashes, so no task sorts them
all. A shard draws its quota from each source's permuted blocks, disjoint from
the other shards', and orders its documents by hash. All of it is DataFrame
work. Words are counted once, into a narrow table; texts are never shuffled as
long as the table of blocks is small enough to broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import checkpointed, masked, without

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Blocks of a source at least, and for each shard; sub-blocks of a cut block.
BLOCKS, BLOCKS_A_SHARD, SUB_BLOCKS = 1024, 16, 4096
#: Shards at least, and words that a shard should hold at most.
SHARDS, SHARD_WORDS = 16, 500_000_000
#: Ranges of hashes that draws are counted in.
RANGE_BITS = 12
BROADCAST_BLOCKS = 100_000


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`, 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    blank = lambda x: F.when(x == "", 1).otherwise(0)
    return F.when(F.size(parts) == 1, 1 - blank(parts[0])).otherwise(F.size(parts) - blank(parts[0]) - blank(F.element_at(parts, -1))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = MOST_REPEATS) -> DataFrame:
    """source, source_size, target of each source of sizes (source, size).

    Sources in code-point order, null last, weigh `weights`, repeating. Targets
    are min(weight * level, cap * size) with the level at which they sum to all
    sizes: sources fill in order of cap * size / weight, so the level follows
    from running sums, and no source is left above its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    full = ranked.withColumn("_cap", cap * F.col("source_size")).withColumn("_fills", F.col("_cap") / F.col("_w"))
    up = Window.orderBy("_fills", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_fills").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(up), F.lit(0.0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(up), F.lit(0.0)))
    # the level as if all before were full and none from here on; the first that holds up counts
    first = full.withColumn("_level", level).withColumn("_holds", F.col("_level") <= F.col("_fills"))
    chosen = F.min(F.when(F.col("_holds"), F.struct("_fills", F.col("source").isNull(), "source", "_level"))).over(whole)["_level"]
    return first.withColumn("target", F.least(F.col("_cap"), F.col("_w") * F.coalesce(chosen, F.lit(math.inf)))).select("source", "source_size", "target")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size and _h, a hash that rows alike in doc_id and text share."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"))


def _block(blocks: int) -> Column:
    return F.pmod("_h", F.lit(blocks)).cast("int")


def _sub_block() -> Column:
    return F.pmod(F.xxhash64("_h"), F.lit(SUB_BLOCKS)).cast("int")


def in_random_order(units: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """units (source, nth) with rank, from 0, in a random order of all; and their number."""
    h = F.xxhash64(F.lit(seed), "source", "nth")
    hashed = units.withColumn("_h", h).withColumn("_range", F.shiftrightunsigned("_h", 64 - RANGE_BITS))
    counts = checkpointed(hashed.groupBy("_range").agg(F.count("*").alias("n")))  # at most 2 ** RANGE_BITS rows
    before = counts.select(F.col("_range").alias("_at"), (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(F.shiftleft("_h", RANGE_BITS), "source", "nth")
    placed = hashed.withColumn("_nth", F.row_number().over(inside)).join(F.broadcast(before), F.col("_range") == F.col("_at"))
    return placed.select("source", "nth", (F.col("_before") + F.col("_nth") - 1).alias("rank")), counts.agg(F.sum("n")).first()[0] or 0


def tree_node(rank: Column, total: int, levels: int) -> Column:
    """The leaf that the draw of a rank falls to when a node of n draws gives ceil(n / 2) to its left half, level by level."""
    root = F.struct(F.lit(0).cast("long").alias("node"), rank.cast("long").alias("at"), F.lit(total).cast("long").alias("n"))

    def halve(s: Column, _: Column) -> Column:
        left = F.floor((s["n"] + 1) / 2).cast("long")
        right = s["at"] >= left
        return F.struct((2 * s["node"] + right.cast("long")).alias("node"), F.when(right, s["at"] - left).otherwise(s["at"]).alias("at"), F.when(right, s["n"] - left).otherwise(left).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), root, halve)["node"] if levels else F.lit(0).cast("long")


def _plan(narrow: DataFrame, weights: tuple[int, ...], cap: int, shards: int | None, seed: int, whole_documents: bool) -> tuple[DataFrame, int]:
    """Per source and block what is drawn of it, and the number of blocks. narrow must be checkpointed.

    Columns: _ps, _pb, source_size, target, part and words (of the last, partial
    pass), cut and parts (of the block at the cut: its first sub-block not taken
    whole, and the words taken there by document), times (the draws' shards).
    """
    total = narrow.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(SHARDS, 1 << max(0, math.ceil(total / SHARD_WORDS) - 1).bit_length())
    n_blocks = max(BLOCKS, BLOCKS_A_SHARD * shards)
    narrow = narrow.withColumn("_block", _block(n_blocks))
    blocks = checkpointed(narrow.groupBy("source", "_block").agg(F.sum("size").alias("words")))
    targets = checkpointed(source_targets(blocks.select("source", F.col("words").alias("size")), weights, cap))
    per_source = F.broadcast if targets.count() <= BROADCAST_BLOCKS else (lambda df: df)  # for tables of a row a source

    # passes over each source, and its blocks in permuted order up to the cut
    same = blocks["source"].eqNullSafe(targets["source"])
    drawn = blocks.join(targets, same).drop(targets["source"]).where("source_size > 0")
    passes = F.floor(F.col("target") / F.col("source_size")).cast("long")
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "_block"), "_block")
    drawn = (
        drawn.withColumn("passes", passes)
        .withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
        .withColumn("before", F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))))
    )
    drawn = checkpointed(drawn.select("source", "source_size", "target", "_block", "words", "passes", "part"))

    # inside a cut block: its sub-blocks by hash, and the documents of the one that is cut again
    cut = drawn.where("part > 0 AND part < words").select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "part")
    at_cut = narrow.join(per_source(cut), narrow["source"].eqNullSafe(cut["_s"]) & (narrow["_block"] == cut["_b"]))
    at_cut = checkpointed(at_cut.select("source", "_block", "size", "_h", _sub_block().alias("_sub"), "part"))
    running = Window.partitionBy("source").orderBy("_sub")
    subs = at_cut.groupBy("source", "_block", "_sub", "part").agg(F.sum("size").alias("words")).withColumn("before", F.sum("words").over(running) - F.col("words"))
    first = subs.where("words > 0 AND part - before < words").groupBy(F.col("source").alias("_s")).agg(F.min(F.struct("_sub", (F.col("part") - F.col("before")).alias("left"))).alias("first"))
    own = at_cut.join(per_source(first), at_cut["source"].eqNullSafe(first["_s"]) & (at_cut["_sub"] == F.col("first._sub")))
    one_by_one = Window.partitionBy("source").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    part_of = F.greatest(F.lit(0), F.least(F.col("size"), F.col("first.left") - F.sum("size").over(one_by_one) + F.col("size")))
    own = own.withColumn("_part", part_of)
    if whole_documents:
        own = own.withColumn("_part", F.when(2 * F.col("_part") >= F.col("size"), F.col("size")).otherwise(F.lit(0)))
    own = own.groupBy("source", "_block", "_sub", "_h").agg(F.min("_part").alias("_part"))
    inside = own.groupBy(F.col("source").alias("_cs"), F.col("_block").alias("_cb")).agg(F.first("_sub").alias("cut"), F.map_from_entries(F.collect_list(F.struct("_h", "_part"))).alias("parts"))

    # exact numbers of draws per source, divided by the tree
    times = F.expr("passes + IF(part > 0, 1, 0)")
    units = drawn.where(times > 0).select("source", "_block", F.explode(F.sequence(F.lit(1), times)).alias("time"), "passes")
    spread = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "_block", "time"), "_block", "time")
    units = checkpointed(units.withColumn("nth", F.row_number().over(spread)))
    ordered, n_units = in_random_order(units.select("source", "nth"), seed + 3)
    levels = math.ceil(math.log2(shards))
    quotas = ordered.select("source", "nth", F.pmod(tree_node(F.col("rank"), n_units, levels), F.lit(shards)).cast("int").alias("shard"))
    slices = quotas.select(F.col("source").alias("_s"), "shard", F.row_number().over(Window.partitionBy("source").orderBy("shard", "nth")).alias("_n"))
    given = units.join(slices, units["source"].eqNullSafe(slices["_s"]) & (units["nth"] == slices["_n"])).drop("_s", "_n")
    given = given.groupBy(F.col("source").alias("_s"), F.col("_block").alias("_b")).agg(F.collect_list(F.struct((F.col("time") > F.col("passes")).alias("partial"), "shard", "time")).alias("times"))
    known = drawn.select(F.col("source").alias("_ps"), F.col("_block").alias("_pb"), "source_size", "target", "part", "words")
    plan = known.join(given, known["_ps"].eqNullSafe(F.col("_s")) & (known["_pb"] == F.col("_b")), "left").drop("_s", "_b")
    plan = plan.join(inside, plan["_ps"].eqNullSafe(F.col("_cs")) & (plan["_pb"] == F.col("_cb")), "left").drop("_cs", "_cb")
    return checkpointed(plan), n_blocks


def _drawn(rows: DataFrame, plan: DataFrame, n_blocks: int, seed: int) -> DataFrame:
    """rows (source, size, _h, ...) with source_size, target, taken and draws."""
    if plan.count() <= BROADCAST_BLOCKS:
        plan = F.broadcast(plan)
    rows = rows.withColumn("_block", _block(n_blocks)).withColumn("_sub", _sub_block())
    met = rows.join(plan, rows["source"].eqNullSafe(F.col("_ps")) & (rows["_block"] == F.col("_pb")), "left")
    whole = (F.col("part") >= F.col("words")) | F.coalesce(F.col("_sub") < F.col("cut"), F.lit(False))
    partial = F.when(whole, F.col("size")).when(F.col("_sub") == F.col("cut"), F.coalesce(F.element_at("parts", F.col("_h")), F.lit(0))).otherwise(F.lit(0))
    none = F.array().cast("array<struct<partial:boolean,shard:int,time:long>>")
    draws = F.transform(F.coalesce("times", none), lambda t: F.struct(t["shard"].alias("shard"), F.xxhash64("_h", t["time"], F.lit(seed)).alias("place"), F.when(t["partial"], partial).otherwise(F.col("size")).alias("words")))
    met = met.withColumn("draws", F.filter(F.array_sort(draws), lambda d: d["words"] > 0))
    met = met.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))
    return met.withColumn("source_size", F.coalesce("source_size", F.lit(0)).cast("long")).withColumn("target", F.coalesce("target", F.lit(0.0)))


READ = ("doc_id", "text", "source")
NEW = ("size", "source_size", "target", "taken", "draws")


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_REPEATS, shards: int | None = None, seed: int = 0, whole_documents: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, draws of every row of docs, whose texts are read once; see mix."""
    narrow = checkpointed(_sized(docs, seed))
    plan, n_blocks = _plan(narrow, weights, cap, shards, seed, whole_documents)
    return _drawn(narrow, plan, n_blocks, seed).select("doc_id", *NEW)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_REPEATS, shards: int | None = None, seed: int = 0, whole_documents: bool = False) -> DataFrame:
    """docs with size, source_size, target, taken and draws.

    size: words of the text (null 0). taken: words that the mix takes, repeats
    counted, at most cap * size; a source's sum is within a word of its target,
    since one document at the cut gives a part of its words. With
    whole_documents that one is taken or left, whichever is nearer. draws: an
    array of struct(shard, place, words), one for each time the document is
    drawn; order by place within a shard. shards: a power of two is fair; by
    default from the number of words. Sources without words take nothing.
    Equal seeds give equal mixes, however rows are partitioned. Rows alike in
    doc_id and text are drawn alike. A null source is a source. Columns of docs
    that have one of the new names are replaced. An empty table gives no rows.
    """
    own, names = masked(without(docs, *NEW), READ)
    plan, n_blocks = _plan(checkpointed(_sized(own, seed)), weights, cap, shards, seed, whole_documents)
    sized = own.withColumn("size", n_words(F.col("text"))).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    return _drawn(sized, plan, n_blocks, seed).select(*own.columns, *NEW).toDF(*names, *NEW)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' own columns, a row for each draw of a whole document."""
    own, names = masked(docs, READ)
    out = mix(own, whole_documents=True, **options)
    return out.select(*own.columns, F.explode("draws").alias("_draw")).drop("_draw").toDF(*names)
