"""Sharding by extendible hashing.

A directory is indexed by leading bits of a row's hash. A bucket whose bytes
pass the limit is split on one bit more, and only such a bucket; the others keep
their shallow depth. Sizes per hash prefix are summed before anything moves, so
the directory is built from counts; rows then look their shard up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import checkpointed, size_hint, without

LIMIT_BYTES = 8 << 20
STEP_BITS = 8
#: Hash bits: the first HASH_DIGITS hexadecimal digits of an MD5.
HASH_DIGITS, HASH_BITS = 15, 60


def row_hash() -> Column:
    """HASH_BITS bits of a row's doc_id and text; null is told from empty."""
    text = F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit(""))
    of = F.md5(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text), "UTF-8"))
    return F.conv(F.substring(of, 1, HASH_DIGITS), 16, 10).cast("long")


def _prefix(h: Column, bits: Column | int) -> Column:
    """The first bits of a hash below 2**HASH_BITS."""
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - bits).cast("int"))


def _directory(rows: DataFrame, below: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Leaves with a depth over `below` up to `depth`, and prefixes at `depth` that are still too large.

    rows: h, bytes, all under prefixes of `below` bits that were too large.
    """
    cells = rows.groupBy(_prefix(F.col("h"), depth).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("least"), F.max("h").alias("most")
    )
    levels = F.explode(F.sequence(F.lit(below), F.lit(depth))).alias("depth")
    sums = (
        cells.select("*", levels)
        .groupBy("depth", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("depth")).alias("prefix"))
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))
        .withColumn("fits", (F.col("bytes") <= limit) | (F.col("least") == F.col("most")))
    )
    sums = checkpointed(sums)
    parents = sums.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    split = sums.where("fits").withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_semi")
    top = sums.where(F.col("fits") & (F.col("depth") == 0)) if below == 0 else None
    leaves = split.drop("parent") if top is None else split.drop("parent").unionByName(top)
    return leaves.select("depth", "prefix", "bytes", "rows"), sums.where(~F.col("fits") & (F.col("depth") == depth)).select("prefix")


def shard_documents(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """docs with shard (its hash bits as text, "" for the whole), shard_depth, shard_bytes, shard_rows, n_bytes.

    A row's size is its text's UTF-8 bytes, null 0; its hash is of doc_id and
    text, so copies under other ids part. Rows that agree in both cannot part:
    they, or one text beyond the limit, are a shard of their own that may pass it.
    A null doc_id is a value like another. Columns of docs that have one of the
    new names are replaced. An empty table gives no rows.
    """
    docs = without(docs, "shard", "shard_depth", "shard_bytes", "shard_rows", "n_bytes", "_h")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    h = row_hash()
    rows = docs.select(h.alias("h"), size.alias("bytes"))
    expected = max(1, 3 * size_hint(docs) // limit)
    below, depth = 0, min(20, max(STEP_BITS, math.ceil(math.log2(4 * expected))))
    found, pending = [], rows
    while True:
        leaves, large = _directory(pending, below, depth, limit)
        found.append((depth, leaves))
        if large.isEmpty() or depth == HASH_BITS:
            break
        pending = pending.join(large, _prefix(F.col("h"), depth) == large["prefix"], "left_semi")
        below, depth = depth, min(HASH_BITS, depth + STEP_BITS)
    out = docs.withColumn("_h", h).withColumn("n_bytes", size)
    shard = F.lit(None)
    for k, (bits, leaves) in enumerate(found):
        # the directory's entries: every cell of `bits` bits points to its leaf
        cells = F.explode(F.sequence(F.call_function("shiftleft", F.col("prefix"), F.lit(bits) - F.col("depth")), F.call_function("shiftleft", F.col("prefix") + 1, F.lit(bits) - F.col("depth")) - 1))
        name = F.when(F.col("depth") == 0, "").otherwise(F.expr("right(lpad(bin(prefix), 64, '0'), depth)"))
        entry = leaves.select(cells.alias(f"_cell{k}"), F.struct(name.alias("name"), F.col("depth").cast("int").alias("depth"), "bytes", "rows").alias(f"_leaf{k}"))
        out = out.join(entry, _prefix(F.col("_h"), bits) == F.col(f"_cell{k}"), "left").drop(f"_cell{k}")
        shard = F.coalesce(shard, F.col(f"_leaf{k}"))
    out = out.withColumn("_shard", shard)
    return out.select(*[f"`{c}`" for c in docs.columns], F.col("_shard.name").alias("shard"), F.col("_shard.depth").alias("shard_depth"), F.col("_shard.bytes").alias("shard_bytes"), F.col("_shard.rows").alias("shard_rows"), "n_bytes")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Write docs as one folder of Parquet per shard under path."""
    shard_documents(docs, limit).repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
