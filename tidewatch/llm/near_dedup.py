"""Near-duplicates by an exact n-gram Jaccard join with adaptive multi-match prefixes.

Two sets with Jaccard similarity of 0.8 or more share l of their first
n - ceil(0.8 n) + l shingles under any common order, for every l up to the least
overlap. A first round takes a cheap order (by hash) and short prefixes, and
keeps only texts of which enough prefix shingles occur elsewhere; the others
link with nothing. Over what is left, shingles are ordered by rarity, and each
text picks the l whose estimated cost (postings to scan, candidates to verify)
is least: its prefix grows, and so does the number of shared prefix shingles
that a partner must show. Pairs are never listed: texts that may be linked
through any prefix shingle form a cluster, and a cluster's task counts matches,
verifies candidates by exact intersection, skips pairs that are linked already
and returns a spanning forest. Clusters too large for a task are dealt in blocks
by least hash, where near copies meet; after that, a text travels to those other
blocks alone that hold a text of another component and as many of its prefix
shingles as a match asks for.

Document frequencies travel as packed arrays: each chunk of texts sends every
distinct shingle once, so a shingle that all texts hold weighs no more than one
entry a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import broadcast_if_small, checkpointed, column, masked, size_hint, slices, texts, told_back
from tidewatch.llm.components import connected
from tidewatch.llm.shingles import SHINGLE_WORDS, WordHashes, shingle_set

#: Similarity of 80 / 100, in whole numbers.
PART, WHOLE = 80, 100
CHUNK_ROWS, CHUNK_TOKENS = 2000, 1_000_000
BUCKETS, BUCKET_TOKENS = 512, 1_000_000
SCAN_COST, VERIFY_COST = 1.0, 40.0
CLUSTER_TEXTS, GROUP_TEXTS = 4000, 400

_FULL = "chunk long, digest binary, tokens binary"
_ROUND = "bucket int, chunk long, tokens binary, owners binary, idx int, doc_id long, th long, n long, least int, digest binary, local int"
_TOLD = "chunk long, owners binary, idx int, doc_id long, th long, n long, least int, digest binary, local int"
_MET = "doc_id long, th long, n long, digest binary, alive boolean"
MANY = 0xFFFF


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any partner, at least."""
    return -(-PART * n // WHOLE)


def first_match(n: int) -> int:
    """Matches asked for in the first round, where the order is by hash."""
    return max(1, min(least_overlap(n), 1 + n // 16))


def _pack(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8", copy=False).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8")


def digest_of(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(_pack(tokens), digest_size=16).digest() if len(tokens) else None


def _first_round(bits: int):
    """Of each chunk of texts, its distinct prefix shingles with their one owner (or MANY), dealt by leading bits; and a row on each text."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    names = [x.split()[0] for x in _ROUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        chunk = TaskContext.get().partitionId() << 32
        for batch in slices(batches, CHUNK_ROWS):
            seen: dict[bytes | None, int] = {}
            idx, counts, digests, prefixes = [], [], [], []
            for text in texts(batch):
                own = shingle_set(text, hashes)
                n, digest = len(own), digest_of(own)
                if digest not in seen:
                    seen[digest] = len(prefixes)
                    prefixes.append(own[: n - least_overlap(n) + first_match(n)] if n else own)
                idx.append(seen[digest])
                counts.append(n)
                digests.append(digest)
            owner = np.repeat(np.arange(len(prefixes), dtype=np.uint16), [len(p) for p in prefixes])
            tokens, first, inverse, times = np.unique(np.concatenate([*prefixes, np.empty(0, np.uint64)]), return_index=True, return_inverse=True, return_counts=True)
            local = np.bincount(owner[times[inverse] > 1], minlength=len(prefixes))
            owners = np.where(times > 1, MANY, owner[first]).astype("<u2")
            cuts = [0, *np.searchsorted(tokens, edges), len(tokens)]
            parts = [(b, s, e) for b, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)) if e > s]
            told = {"bucket": [b for b, _, _ in parts], "chunk": [chunk] * len(parts), "tokens": [_pack(tokens[s:e]) for _, s, e in parts], "owners": [owners[s:e].tobytes() for _, s, e in parts]}
            rows = {"bucket": [-1 - (chunk ^ chunk >> 32) % BUCKETS] * len(idx), "chunk": [chunk] * len(idx), "idx": idx, "n": counts, "least": [first_match(n) for n in counts], "digest": digests, "local": local[idx].tolist()}
            rows |= {"doc_id": column(batch, "doc_id"), "th": column(batch, "th")}
            for made in (told, rows):
                size = len(made["bucket"])
                yield pa.RecordBatch.from_arrays([made[c] if isinstance(made.get(c), pa.Array) else pa.array(made.get(c, [None] * size), k) for c, k in zip(names, _kinds(_ROUND), strict=True)], names=names)
            chunk += 1

    return run


def _kinds(schema: str) -> list[pa.DataType]:
    known = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return [known[x.split()[1]] for x in schema.split(", ")]


def _tell(table: pa.Table) -> pa.Table:
    """To each chunk, the owners of its shingles that another chunk holds too; rows on texts pass."""
    names = [x.split()[0] for x in _TOLD.split(", ")]
    if table.column("bucket")[0].as_py() < 0:
        return table.select(names)
    blobs = table.column("tokens").to_pylist()
    tokens, owners = _unpack(b"".join(blobs)), np.frombuffer(b"".join(table.column("owners").to_pylist()), "<u2")
    _, inverse = np.unique(tokens, return_inverse=True)
    shared = (np.bincount(inverse) + np.bincount(inverse, owners == MANY))[inverse] > 1
    shared &= owners != MANY
    out, at = [], 0
    for blob in blobs:
        own = slice(at, at + len(blob) // 8)
        at = own.stop
        out.append(owners[own][shared[own]].tobytes())
    made = {"chunk": table.column("chunk"), "owners": pa.array(out, pa.binary())}
    told = pa.table([made.get(c, pa.nulls(len(out), k)) for c, k in zip(names, _kinds(_TOLD), strict=True)], names=names)
    return told.filter(pa.array([len(x) > 0 for x in out]))


def _count(table: pa.Table) -> pa.Table:
    """Which of a chunk's texts have enough prefix shingles that others hold."""
    is_text = pa.compute.is_valid(table.column("idx"))
    rows = table.filter(is_text)
    owners = np.frombuffer(b"".join(table.filter(pa.compute.invert(is_text)).column("owners").to_pylist()), "<u2")
    met = np.bincount(owners, minlength=MANY)[rows.column("idx").to_numpy()] + rows.column("local").to_numpy()
    alive = met >= rows.column("least").to_numpy()
    return rows.select(["doc_id", "th", "n", "digest"]).append_column("alive", pa.array(alive))


def whole_sets(k: int = SHINGLE_WORDS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work: whole shingle sets of its texts, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        chunk = TaskContext.get().partitionId() << 32
        for batch in slices(batches, CHUNK_ROWS):
            chunks, digests, tokens, held = [], [], [], 0
            for text in texts(batch):
                own = shingle_set(text, hashes, k)
                digests.append(digest_of(own))
                tokens.append(_pack(own))
                held += len(own)
                if held > CHUNK_TOKENS:
                    chunk, held = chunk + 1, len(own)
                chunks.append(chunk)
            chunk += 1
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.binary())], names=["chunk", "digest", "tokens"])

    return run


def _send(bits: int):
    """Each chunk's distinct shingles with the number of its sets that hold them, dealt by their leading bits."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_chunk: dict[int, dict[bytes, bytes]] = {}
            for chunk, digest, blob in zip(column(batch, "chunk").to_pylist(), column(batch, "digest").to_pylist(), column(batch, "tokens").to_pylist(), strict=True):
                if digest is not None:
                    by_chunk.setdefault(chunk, {})[digest] = blob
            for chunk, sets in by_chunk.items():
                tokens, counts = np.unique(_unpack(b"".join(sets.values())), return_counts=True)
                cuts = [0, *np.searchsorted(tokens, edges), len(tokens)]
                rows = [(b, chunk, _pack(tokens[s:e]), counts[s:e].astype("<u4").tobytes()) for b, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)) if e > s]
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "chunk", "tokens", "counts"), r, strict=True)) for r in rows[at : at + 256]], schema=_SENT)

    return run


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int64()), ("tokens", pa.binary()), ("df", pa.binary())])


def _reply(table: pa.Table) -> pa.Table:
    """To each chunk, those of its shingles that two sets or more hold, with their number."""
    chunks, blobs = table.column("chunk").to_pylist(), table.column("tokens").to_pylist()
    tokens = _unpack(b"".join(blobs))
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4")
    _, inverse = np.unique(tokens, return_inverse=True)
    df = np.bincount(inverse, counts)[inverse]
    out, at = [], 0
    for chunk, blob in zip(chunks, blobs, strict=True):
        own = slice(at, at + len(blob) // 8)
        at = own.stop
        shared = df[own] >= 2
        if shared.any():
            out.append({"chunk": chunk, "tokens": _pack(tokens[own][shared]), "df": df[own][shared].astype("<u4").tobytes()})
    return pa.Table.from_pylist(out, schema=_REPLY)


def with_frequencies(sets: DataFrame, use: Callable[[np.ndarray, np.ndarray, dict], dict | None], schema: str) -> DataFrame:
    """use(tokens, df, row) of every set, whose result, if any, is a row; sets must be checkpointed."""
    total = (sets.agg(F.sum(F.length("tokens"))).first()[0] or 0) // 8
    bits = max(BUCKETS, total // BUCKET_TOKENS).bit_length() - 1
    sent = sets.mapInArrow(_send(bits), "bucket int, chunk long, tokens binary, counts binary")
    replies = sent.groupBy("bucket").applyInArrow(_reply, "chunk long, tokens binary, df binary")

    names = [x.split()[0] for x in schema.split(",")]

    def meet(own: pa.Table, told: pa.Table) -> pa.Table:
        tokens = _unpack(b"".join(told.column("tokens").to_pylist()))
        df = np.frombuffer(b"".join(told.column("df").to_pylist()), "<u4")
        # the parts of one chunk that were sent apart name a shingle more than once
        tokens, first = np.unique(tokens, return_index=True)
        df = df[first].astype(np.int64)
        out = []
        for row in own.to_pylist():
            mine = _unpack(row["tokens"])
            place = np.searchsorted(tokens, mine)
            found = np.ones(len(mine), np.int64)
            met = place < len(tokens)
            met[met] = tokens[place[met]] == mine[met]
            found[met] = df[place[met]]
            if (result := use(mine, found, row)) is not None:
                out.append(result)
        return pa.table({n: pa.array([r[n] for r in out], kinds[n]) for n in names})

    kinds = {x.split()[0]: {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(",")}
    return sets.where("digest IS NOT NULL").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(meet, schema)


def adaptive_prefix(tokens: np.ndarray, df: np.ndarray) -> tuple[int, np.ndarray]:
    """(l, shared shingles of the prefix for l), of least estimated cost; l is 0 if no partner is possible.

    A prefix of df postings scans them all; of the texts met there, at most the
    postings divided by l can be met l times and must be verified.
    """
    n = len(tokens)
    need = least_overlap(n)
    order = np.lexsort((tokens, df))
    postings = np.cumsum(df[order] - 1)
    reach = postings[n - need : n]  # with l = 1, 2, ..., need
    if np.count_nonzero(df >= 2) < need or not len(reach):
        return 0, tokens[:0]
    ls = np.arange(1, len(reach) + 1)
    if not reach.all():  # some l has a prefix that nobody shares
        return 0, tokens[:0]
    cost = SCAN_COST * reach + VERIFY_COST * reach / ls
    best = int(np.argmin(cost))
    prefix = order[: n - need + best + 1]
    return best + 1, tokens[prefix][df[prefix] >= 2]


def _prefix(tokens: np.ndarray, df: np.ndarray, row: dict) -> dict | None:
    match, prefix = adaptive_prefix(tokens, df)
    return {"digest": row["digest"], "match": match, "prefix": _pack(prefix)} if match else None


def spread_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix shingle."""
    for batch in slices(batches, 200):
        blobs = column(batch, "prefix").to_pylist()
        owner = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
        yield pa.RecordBatch.from_arrays([pa.array(_unpack(b"".join(blobs)).view(np.int64)), column(batch, "digest").take(pa.array(owner))], names=["token", "digest"])


def linked(sets: list[np.ndarray], prefixes: list[np.ndarray], match: np.ndarray, group: list[bytes], block: np.ndarray, across: bool, sketches: np.ndarray | None = None, agree: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of different groups; with across, of links between blocks alone (but for what is skipped as linked already).

    With sketches (sets by places), a pair that agrees in fewer places is no candidate.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), [len(p) for p in prefixes])
    _, token = np.unique(np.concatenate(prefixes), return_inverse=True)
    by_token = np.argsort(token, kind="stable")
    holders, start = owner[by_token], np.concatenate([[0], np.cumsum(np.bincount(token))])
    first = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
    known: dict[bytes, int] = {}
    root = np.array([known.setdefault(g, len(known)) for g in group], np.int64)
    links = []
    for i in range(1, m):
        own = token[first[i] : first[i + 1]]
        met = np.concatenate([holders[start[t] : start[t + 1]] for t in own]) if len(own) else np.empty(0, np.int64)
        shared = np.bincount(met[met < i], minlength=i)
        fits = (shared > 0) & (shared >= np.minimum(match[:i], match[i]))
        fits &= WHOLE * np.minimum(n[:i], n[i]) >= PART * np.maximum(n[:i], n[i])
        if across:
            fits &= block[:i] != block[i]
        todo = np.flatnonzero(fits)
        if sketches is not None and len(todo):
            todo = todo[root[todo] != root[i]]
            todo = todo[(sketches[todo] == sketches[i]).sum(1) >= agree]
        todo = todo[np.argsort(-shared[todo], kind="stable")]
        at = 0
        while at < len(todo):
            some = todo[at : at + (4 if at == 0 else 256)]
            at += len(some)
            some = some[root[some] != root[i]]
            if not len(some):
                continue
            flat = np.concatenate([sets[j] for j in some])
            place = np.searchsorted(sets[i], flat)
            place[place == len(sets[i])] = 0
            same = sets[i][place] == flat
            overlap = np.add.reduceat(same, np.concatenate([[0], np.cumsum(n[some])[:-1]]), dtype=np.int64)
            for j in some[WHOLE * overlap >= PART * (n[some] + n[i] - overlap)]:
                if root[j] != root[i]:
                    links.append((int(j), i))
                    root[root == root[j]] = root[i]
    return links


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _verify(table: pa.Table, agree: int) -> pa.Table:
    """The links within each cluster of a group, or between two of its blocks; rows may have signatures."""
    out, signed = [], "sketch" in table.column_names
    rows = sorted(table.to_pylist(), key=lambda r: (r["cluster"], len(r["tokens"]), r["digest"]))
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end]["cluster"] == rows[at]["cluster"]:
            end += 1
        own, at = rows[at:end], end
        if len(own) > 1:
            sketches = np.frombuffer(b"".join(r["sketch"] for r in own), np.uint8).reshape(len(own), -1) if signed else None
            found = linked([_unpack(r["tokens"]) for r in own], [_unpack(r["prefix"]) for r in own], np.array([r["match"] for r in own]), [r["group"] for r in own], np.array([r["block"] for r in own]), own[0]["low"] != own[0]["high"], sketches, agree)
            out += [{"a": own[i]["digest"], "b": own[j]["digest"]} for i, j in found]
    return pa.Table.from_pylist(out, schema=_LINKS)


def _blocked(member: DataFrame, most: int) -> DataFrame:
    """member with block: texts of a cluster by the least hash of their set, so that near copies share one; what too many share is dealt further."""
    member = member.withColumn("_least", F.substring("tokens", 1, 8))
    alike = member.groupBy("cluster", "_least").agg(F.count("*").alias("_alike"))
    texts = alike.groupBy("cluster").agg(F.sum("_alike").alias("_texts"))
    own = F.concat_ws("/", F.hex("_least"), F.pmod(F.xxhash64("digest"), F.ceil(F.col("_alike") / most)).cast("string"))
    shared = F.pmod(F.xxhash64("_least"), F.ceil(F.col("_texts") / most)).cast("string")
    return member.join(alike, ["cluster", "_least"]).join(texts, "cluster").withColumn("block", F.when(F.col("_alike") > most, own).otherwise(shared)).drop("_least", "_alike", "_texts")


def _verified(paired: DataFrame, groups: int, agree: int = 0) -> DataFrame:
    """Links among rows of (cluster, digest, block, group, match, prefix, tokens, low, high) that meet: one task for all with the same many, low, high."""
    many = F.when(F.col("texts") > GROUP_TEXTS, F.hex("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(groups)).cast("string"))
    kept = ["low", "high", "cluster", "digest", "group", "block", "match", "prefix", "tokens", *(c for c in paired.columns if c == "sketch")]
    return paired.select(many.alias("many"), *kept).groupBy("many", "low", "high").applyInArrow(lambda t: _verify(t, agree), "a binary, b binary")


def _grouped(member: DataFrame, links: DataFrame) -> DataFrame:
    """member with the component that links give each text as its group."""
    root = connected(links).withColumnsRenamed({"node": "digest", "root": "_root"})
    return checkpointed(member.drop("group").join(root, "digest", "left").withColumn("group", F.coalesce("_root", "digest")).drop("_root"))


def _large_links(member: DataFrame, cluster_texts: int, agree: int = 0) -> DataFrame:
    """Links of clusters too large for a task.

    First inside blocks, then among one text of each group so found, blocked anew:
    that joins most near copies. What is left are texts that share enough prefix
    shingles with a text of another block and another group: a text travels to
    those blocks alone. A shingle whose holders are one group by now leads
    nowhere; of any other, the texts of its commonest group look only at blocks
    that hold it in another group.
    """
    most = max(1, cluster_texts // 2)
    member = checkpointed(_blocked(member.withColumn("group", F.col("digest")), most))
    inside = lambda rows: checkpointed(_verified(rows.withColumns({"low": F.col("block"), "high": F.col("block"), "texts": F.lit(GROUP_TEXTS + 1)}), 1, agree))
    links = inside(member)
    heads = _grouped(member, links).where(F.col("digest") == F.col("group"))
    links = checkpointed(links.unionByName(inside(_blocked(heads.drop("block"), most))))
    member = _grouped(member, links)
    placed = member.select("digest", "prefix").mapInArrow(spread_tokens, "token long, digest binary").join(member.select("digest", "block", "match", "group"), "digest")
    there = placed.groupBy("token", "block", "group").agg(F.count("*").alias("own"), F.min("match").alias("asked"))
    there = checkpointed(there)
    common = there.groupBy("token", "group").agg(F.sum("own").alias("own")).groupBy("token").agg(F.max_by("group", "own").alias("common"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    placed = told_back(placed, "token", ["digest"], [F.min("group").alias("least"), F.max("group").alias("most")], "least <> most").drop("least", "most").join(common, "token")
    there = there.join(common, "token").groupBy("token", F.col("block").alias("other"), "common").agg(F.min("asked").alias("asked"), F.min("group").alias("one"), F.max("group").alias("another"))
    pure = (F.col("one") == F.col("common")) & (F.col("another") == F.col("common"))
    usual, rest = placed.where("group = common").drop("common"), placed.where("group <> common").drop("common")
    met = usual.join(there.where(~pure).drop("common"), "token").unionByName(rest.join(there.drop("common"), "token"))
    met = met.where((F.col("block") != F.col("other")) & ((F.col("one") != F.col("group")) | (F.col("another") != F.col("group"))))
    met = met.groupBy("digest", "other").agg(F.count("*").alias("held"), F.min(F.least("match", "asked")).alias("asked")).where("held >= asked").select("digest", "other")
    apart = member.join(met, "digest").withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "texts": F.lit(GROUP_TEXTS + 1)})
    return links.unionByName(_verified(apart, 1, agree))


def cluster_links(cluster: DataFrame, held: DataFrame, content: DataFrame, cluster_texts: int = CLUSTER_TEXTS, agree: int = 0) -> DataFrame:
    """Links of the sets in each cluster: cluster (digest, cluster), held (digest, match, prefix and perhaps sketch), content (digest, tokens)."""
    sizes = cluster.groupBy("cluster").agg(F.count("*").alias("texts"))
    total = cluster.count()
    member = cluster.join(sizes, "cluster").join(held, "digest").join(content, "digest")
    small = member.where(F.col("texts") <= cluster_texts).withColumns({"group": F.col("digest"), "block": F.lit(""), "low": F.lit(""), "high": F.lit("")})
    links = _verified(small, max(1, total // GROUP_TEXTS), agree)
    if not sizes.where(F.col("texts") > cluster_texts).isEmpty():
        links = links.unionByName(_large_links(member.where(F.col("texts") > cluster_texts).drop("texts"), cluster_texts, agree))
    return links


def near_links(docs: DataFrame, cluster_texts: int = CLUSTER_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(sets, links): doc_id, th, n, digest of every row, and digests a, b that link different sets, a spanning forest of all links."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th"))
    size = size_hint(docs) or docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # counted where unknown
    bits = max(BUCKETS, 2 * size // (8 * BUCKET_TOKENS)).bit_length() - 1
    told = rows.mapInArrow(_first_round(bits), _ROUND).groupBy("bucket").applyInArrow(_tell, _TOLD)
    sets = checkpointed(told.groupBy("chunk").applyInArrow(_count, _MET))

    # whole sets of one row for each shingle set that is left
    holder = sets.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("row"), F.max("alive").alias("alive")).where("alive")
    chosen = holder.select(F.col("row.doc_id").alias("_id"), F.col("row.th").alias("_th"))
    left = rows.join(chosen.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(F.col("_id")) & rows["th"].eqNullSafe(F.col("_th")))
    left = left.select("doc_id", "text", "th").dropDuplicates(["doc_id", "th"])
    full = checkpointed(left.mapInArrow(whole_sets(), _FULL))
    prefixes = checkpointed(with_frequencies(full, _prefix, "digest binary, match int, prefix binary"))

    # clusters: all texts that any prefix shingle brings together
    spread = prefixes.mapInArrow(spread_tokens, "token long, digest binary")
    shared = told_back(spread, "token", ["digest"], [F.min("digest").alias("leader"), F.count("*").alias("texts")], "texts > 1")
    stars = shared.where("digest != leader").select(F.col("leader").alias("a"), F.col("digest").alias("b"))
    cluster = checkpointed(connected(stars).withColumnsRenamed({"node": "digest", "root": "cluster"}))
    links = cluster_links(cluster, prefixes, full.select("digest", "tokens").dropDuplicates(["digest"]), cluster_texts)
    return sets.drop("alive"), links


def near_groups(docs: DataFrame, cluster_texts: int = CLUSTER_TEXTS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, digest, th.

    Sets are distinct five-word shingles, of fewer words the whole sequence; sets
    link at a Jaccard similarity of 0.8 or more. component_id is the smallest
    doc_id that links reach. Null and wordless texts have the empty set and link
    with nothing, not even with each other. Rows with a null doc_id carry links
    on; a component of such rows alone has a null id. Repeated rows are members
    like others. An empty table gives no rows. Columns other than doc_id and text
    are not read. digest names the shingle set, th hashes the text.
    """
    return component_ids(*near_links(docs, cluster_texts))


def component_ids(sets: DataFrame, links: DataFrame) -> DataFrame:
    """sets (doc_id, th, n, digest) with the smallest doc_id that links between digests reach."""
    component = connected(checkpointed(links))
    least = sets.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"))
    least = least.join(component, least["digest"] == component["node"], "left").select("digest", "least", F.coalesce("root", "digest").alias("root"))
    by_set = told_back(least, "root", ["digest"], [F.min("least").alias("component")]).select(F.col("digest").alias("_digest"), "component")
    return sets.join(by_set, F.col("digest") == F.col("_digest"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "digest", "th")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, less all but one row of each component: the one with the smallest doc_id.

    Rows of a component that agree on that doc_id are told apart by their text;
    rows alike in both are one document and stay together.
    """
    groups = checkpointed(near_groups(docs))
    # an empty set links with nothing, so its row stays
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    members = groups.where("digest IS NOT NULL").select("component_id", row.alias("own"))
    first = checkpointed(members.groupBy(F.col("component_id").alias("_component")).agg(F.min("own").alias("first"), F.max("own").alias("last")).where("first <> last"))
    gone = members.join(broadcast_if_small(first), F.col("component_id").eqNullSafe(F.col("_component"))).where("own <> first")
    gone = checkpointed(gone.select(F.col("own.doc_id").alias("_gone_id"), F.col("own.th").alias("_gone_th")).distinct())
    docs, names = masked(docs)
    kept = docs.join(broadcast_if_small(gone), docs["doc_id"].cast("long").eqNullSafe(F.col("_gone_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("_gone_th")), "left_anti")
    return kept.toDF(*names)
