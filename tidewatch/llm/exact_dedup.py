"""Exact deduplication by recursive Grace hashing.

Each input task first combines its own equal texts in a bounded open-addressing
table, so that a text held by a third of all rows leaves a task once per flush.
The combined records go to buckets by hash. A bucket's task enters complete
texts in an open-addressing table of a byte budget; what does not fit is spilled
to the shared checkpoint folder and dealt out anew by the next hash level, until
every bucket fits. Texts never travel again: classes and members meet by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import broadcast_if_small, checkpointed, column, default_partitions, masked, size_hint, texts

TABLE_BYTES = 64 << 20
ENTRY_BYTES = 200
RECORD_IDS = 50_000
MOST_BUCKETS = 1 << 20

_RECORD = pa.schema(
    [("h", pa.int64()), ("sha", pa.binary()), ("text", pa.binary()), ("rows", pa.int64()), ("max_id", pa.int64()), ("at", pa.int32()), ("uid", pa.int64()), ("ids", pa.list_(pa.int64()))]
)
RECORD = "h long, sha binary, text binary, rows long, max_id long, at int, uid long, ids array<long>"
SPILLED = RECORD + ", key binary"


class OpenTable:
    """Open addressing with linear probing; equality is that of whole contents."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def find(self, h: int, text: bytes) -> tuple[int, int]:
        """(entry or -1, slot where the search ended)."""
        slots, hashes, known = self.slots, self.hashes, self.texts
        mask = len(slots) - 1
        at = h & mask
        while (entry := slots[at]) >= 0:
            if hashes[entry] == h and known[entry] == text:
                return int(entry), at
            at = (at + 1) & mask
        return -1, at

    def insert(self, h: int, text: bytes, at: int) -> int:
        entry = len(self.texts)
        self.slots[at] = entry
        self.hashes.append(h)
        self.texts.append(text)
        self.bytes += len(text) + ENTRY_BYTES
        if 2 * len(self.texts) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = np.full(mask + 1, -1, np.int64)
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _combine(budget: int):
    """Records of the distinct texts of each flush of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 33
        table, shas, ids = OpenTable(), [], []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal serial, held
            rows = []
            for entry, text in enumerate(table.texts):
                own = ids[entry]
                known = [x for x in own if x is not None]
                most = max(known, default=None)
                h = table.hashes[entry]
                rows.append((h - (1 << 64) if h >> 63 else h, shas[entry], text, len(own), most, own.index(most), serial, own))
                serial += 1
            held = 0
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_RECORD)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORD, strict=True)], schema=_RECORD)

        for batch in batches:
            for text, doc_id in zip(texts(batch), column(batch, "doc_id").to_pylist(), strict=True):
                text = (text or b"").lower()
                sha = hashlib.sha256(text).digest()
                h = int.from_bytes(sha[:8], "little")
                entry, at = table.find(h, text)
                if entry < 0:
                    table.insert(h, text, at)
                    shas.append(sha)
                    ids.append([doc_id])
                else:
                    ids[entry].append(doc_id)
                held += 1
                if table.bytes > budget or held >= RECORD_IDS:
                    yield flush()
                    table, shas, ids = OpenTable(), [], []
        if table.texts:
            yield flush()

    return run


def _resolve(budget: int):
    """Give records of this bucket their class key; hand back, with their text, those beyond the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys, ordinals = OpenTable(), [], {}
        for batch in batches:
            out, left = [], []
            for h, sha, text in zip(column(batch, "h").to_pylist(), column(batch, "sha").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                h &= (1 << 64) - 1
                entry, at = table.find(h, text)
                if entry < 0 and (not table.texts or table.bytes + len(text) <= budget):
                    # texts that differ under one digest count up, so that their keys differ
                    nth = ordinals[sha] = ordinals.get(sha, -1) + 1
                    entry = table.insert(h, text, at)
                    keys.append(sha + (nth.to_bytes(4, "big") if nth else b""))
                out.append(keys[entry] if entry >= 0 else None)
                left.append(None if entry >= 0 else text)
            columns = [pa.array(left, pa.binary()) if n == "text" else column(batch, n) for n in _RECORD.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=[*_RECORD.names, "key"])

    return run


def _buckets(spark: SparkSession, size: int, table_bytes: int) -> int:
    return min(MOST_BUCKETS, max(default_partitions(spark), size // table_bytes))


def grace_records(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Records with their class key: equal texts, and they alone, share one."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    pending = rows.mapInArrow(_combine(table_bytes), RECORD)
    buckets = _buckets(spark, 4 * size_hint(docs), table_bytes)
    done, level = [], 0
    while True:
        dealt = pending.repartition(buckets, F.xxhash64("h", F.lit(level)))
        spill = checkpointed(dealt.mapInArrow(_resolve(table_bytes), SPILLED))
        done.append(spill.where("key IS NOT NULL").drop("text"))
        rest = spill.where("key IS NULL").drop("key")
        left = rest.agg(F.sum(F.length("text") + ENTRY_BYTES)).first()[0]
        if not left:
            break
        pending, level = rest, level + 1
        buckets = _buckets(spark, 2 * left, table_bytes)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of docs, dropped ones too.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest doc_id stays; a null doc_id is the
    smallest; among rows that tie on the largest, exactly one stays. Columns
    other than doc_id and text are not read. An empty table gives no rows.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    records = grace_records(docs, table_bytes)
    classes = records.groupBy("key").agg(
        F.sum("rows").alias("group_size"),
        F.max(F.struct("max_id", "uid")).alias("top"),
    )
    return (
        records.join(classes, "key")
        .select("top", "group_size", "uid", "at", F.lower(F.hex("sha")).alias("text_sha256"), F.posexplode("ids").alias("pos", "doc_id"))
        .select(
            "doc_id",
            F.col("top.max_id").alias("keep_id"),
            "group_size",
            ((F.col("uid") == F.col("top.uid")) & (F.col("pos") == F.col("at"))).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact_copies(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """docs, all columns, less the rows whose text another row keeps.

    Rows alike in both doc_id and normalised text are one document: one of them stays.
    """
    copies = exact_groups(docs, table_bytes).where("group_size > 1").groupBy(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_of"))
    told = checkpointed(copies.agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1"))
    gone, again = told.where("NOT stays").select("_id", "_of"), told.where("stays").select("_id", "_of")
    own = F.unhex(F.sha2(F.encode(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "UTF-8"), 256))
    rows, names = masked(docs)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_of"))
    left = rows.withColumn("_sha", own).join(broadcast_if_small(gone), same, "left_anti")
    if not again.isEmpty():  # rows alike in doc_id and text
        again = broadcast_if_small(again)
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "_sha"]))
    return left.drop("_sha").toDF(*names)
