"""Near-duplicates by MinHash: banded minima find them, signatures and whole sets confirm.

Every set of two-word shingles gets 160 minima of universal hash functions
(multiply-shift over 64 bits), in 32 bands of 5. Sets that agree in a band meet
there; a pair of similarity 0.8 has no band in common once in 300,000 times.
Of every minimum a byte is kept as signature. Pairs that meet and whose
signatures agree in at least 100 places (a pair at 0.8 falls short once in ten
million times) join their sets into clusters, where each band sends on a
spanning forest, not its pairs. A cluster's task goes through what bands and
signatures let by, nearest first, confirms links on whole sets, skips what is
linked already and returns a spanning forest of the links; clusters that are
too large for a task are dealt in blocks, as for the n-gram join. Components of
the links come from alternating large and small stars.

Copies are one set from the start. A band that very many sets share joins them
into one cluster without a look at signatures: a cluster only says what may link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import checkpointed, column, default_partitions, slices, stored, texts, told_back
from tidewatch.llm.components import connected
from tidewatch.llm.near_dedup import CLUSTER_TEXTS, cluster_links, component_ids, digest_of, spread_tokens, whole_sets
from tidewatch.llm.shingles import WordHashes, mix64, shingle_set

SHINGLE_WORDS = 2
BANDS, BAND_ROWS = 32, 5
#: Places in which signatures of a pair agree, at least.
AGREE = 100
SEED = 20_240_229
#: Shingles that are hashed at once, and texts of a batch.
AT_ONCE, BATCH_TEXTS = 60_000, 200
#: Sets that share a band and whose signatures are compared with each other in one task.
BAND_SETS = 1000

_random = np.random.default_rng(SEED)
_A = _random.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
_B = _random.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) << np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of every hash function over each set (none empty), sets by functions."""
    out = np.full((len(sets), len(_A)), np.iinfo(np.uint64).max)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= AT_ONCE):
            held += len(sets[end])
            end += 1
        flat, starts = np.concatenate(sets[at:end]), np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        for low in range(0, len(flat), AT_ONCE):  # more than one part only of a single long set
            part = flat[low : low + AT_ONCE]
            places = starts if end - at > 1 else np.zeros(1, np.int64)
            value = np.empty_like(part)
            for i in range(len(_A)):
                np.multiply(part, _A[i], out=value)
                value += _B[i]
                out[at:end, i] = np.minimum(out[at:end, i], np.minimum.reduceat(value, places))
        at = end
    return out >> np.uint64(32)


def bands(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of the minima, sets by bands."""
    keys = np.tile(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(low), 1))
    parts = low.reshape(len(low), BANDS, BAND_ROWS)
    for i in range(BAND_ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys


_SIGNED = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("prefix", pa.binary()), ("sketch", pa.binary())])
_SIGNED_DDL = "doc_id long, th long, n long, digest binary, prefix binary, sketch binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, digest, bands and signature of each text's set."""
    hashes = WordHashes()
    for batch in slices(batches, BATCH_TEXTS):
        sets = [shingle_set(t, hashes, SHINGLE_WORDS) for t in texts(batch)]
        full = [i for i, s in enumerate(sets) if len(s)]
        keys, sketch = [None] * len(sets), [None] * len(sets)
        if full:
            low = minima([sets[i] for i in full])
            for i, own, byte in zip(full, bands(low), low.astype(np.uint8), strict=True):
                keys[i], sketch[i] = own.tobytes(), byte.tobytes()
        rows = [column(batch, "doc_id"), column(batch, "th"), [len(s) for s in sets], [digest_of(s) for s in sets], keys, sketch]
        yield pa.RecordBatch.from_arrays([r if isinstance(r, pa.Array) else pa.array(r, k) for r, k in zip(rows, _SIGNED.types, strict=True)], schema=_SIGNED)


def agreeing(sketch: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose signatures agree and whose sizes allow a similarity of 0.8."""
    root, pairs = np.arange(len(n)), []
    for i in range(1, len(n)):
        near = ((sketch[:i] == sketch[i]).sum(1) >= AGREE) & (10 * np.minimum(n[:i], n[i]) >= 8 * np.maximum(n[:i], n[i]))
        for j in np.flatnonzero(near & (root[:i] != root[i])):
            if root[j] != root[i]:
                pairs.append((int(j), i))
                root[root == root[j]] = root[i]
    return pairs


_EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _meet(table: pa.Table) -> pa.Table:
    """Edges within each of a group's bands."""
    table = table.sort_by("token")
    token, n = table.column("token").to_numpy(), table.column("n").to_numpy()
    digest = table.column("digest").to_pylist()
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(n), -1)
    cuts = np.flatnonzero(np.diff(token)) + 1
    out = {(digest[s + i], digest[s + j]) for s, e in zip([0, *cuts], [*cuts, len(n)], strict=True) for i, j in agreeing(sketch[s:e], n[s:e])}
    return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())}, schema=_EDGES)


def minhash_links(docs: DataFrame, cluster_texts: int = CLUSTER_TEXTS, band_sets: int = BAND_SETS) -> tuple[DataFrame, DataFrame]:
    """(sets, links): doc_id, th, n, digest of every row, and digests a, b that link different sets, a spanning forest of all links."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th"))
    signed = stored(rows.mapInArrow(_sign, _SIGNED_DDL))
    one = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("row"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    one = stored(one.select("digest", "row.doc_id", "row.th", "n", "prefix", "sketch"))

    # bands that sets share; the rest of a set's bands lead nowhere
    spread = one.select("digest", "prefix").mapInArrow(spread_tokens, "token long, digest binary")
    shared = checkpointed(told_back(spread, "token", ["digest"], [F.min("digest").alias("leader"), F.count("*").alias("sets")], "sets > 1"))
    few = shared.where(F.col("sets") <= band_sets).select("token", "digest").join(one.select("digest", "n", "sketch"), "digest")
    groups = 4 * default_partitions(docs.sparkSession)
    met = few.groupBy(F.pmod(F.xxhash64("token"), F.lit(groups)).alias("group")).applyInArrow(lambda t: _meet(t), "a binary, b binary")
    many = shared.where((F.col("sets") > band_sets) & (F.col("digest") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("digest").alias("b"))
    cluster = checkpointed(connected(met.unionByName(many)).withColumnsRenamed({"node": "digest", "root": "cluster"}))

    # whole sets of those in a cluster
    chosen = cluster.join(one.select("digest", "doc_id", "th"), "digest").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    left = rows.join(chosen.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(F.col("_id")) & rows["th"].eqNullSafe(F.col("_th")))
    full = checkpointed(left.select("doc_id", "text", "th").dropDuplicates(["doc_id", "th"]).mapInArrow(whole_sets(SHINGLE_WORDS), "chunk long, digest binary, tokens binary"))
    held = one.select("digest", "prefix", "sketch", F.lit(1).alias("match"))
    links = cluster_links(cluster, held, full.select("digest", "tokens").dropDuplicates(["digest"]), cluster_texts, AGREE)
    return signed.select("doc_id", "th", "n", "digest"), links


def minhash_groups(docs: DataFrame, cluster_texts: int = CLUSTER_TEXTS, band_sets: int = BAND_SETS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, digest, th.

    Sets are distinct two-word shingles of the words of the text, A-Z lowered; of
    a single word the word itself. Sets link at a Jaccard similarity of 0.8 or
    more. component_id is the smallest doc_id that links reach; kept says that it
    is the row's own. Null and wordless texts have the empty set and link with
    nothing, not even with each other. Rows with a null doc_id carry links on; a
    component of such rows alone has a null id and keeps them. Repeated rows are
    members like others, and kept alike. An empty table gives no rows. Columns
    other than doc_id and text are not read.
    """
    groups = component_ids(*minhash_links(docs, cluster_texts, band_sets))
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "digest", "th")
