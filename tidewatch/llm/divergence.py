"""How the sources of a language differ in their words: exact pair sums by a heavy-light split.

A group is a (lang, source); p of a group and term is one plus the term's share
of the group's words in billionths, smoothed by one. Every pair of groups of a
language needs f = (p - q)^2 div q summed over all terms that the language keeps,
most of which either group lacks. So for each pair the sum starts at V times the
f of two absent terms, and tiles of terms add what differs from that: terms that
many groups have are dense numpy tiles, groups by terms; of rare ones only the
postings count: a posting differs from absence in the same way for all groups
without the term, so equal ones are counted and weighed once, and pairs that both
hold the term get a correction. All numbers are whole, and all sums exact.

Terms lie in tiles by hash and groups in blocks of at most some hundred, so a
task holds one tile of two blocks, whatever a language's or a source's share is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import broadcast_if_small, checkpointed, column, stored, texts

#: Documents of its language that a kept term is in, at least; ranks of terms that are returned.
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
SCALE = 1_000_000_000
#: Entries of a partial count that a task holds before it passes them on.
HELD_TERMS = 400_000
TILE_POSTINGS, BLOCK_GROUPS = 150_000, 256
#: A term is heavy if at least this share of a block's groups holds it (and so at least two).
HEAVY_SHARE = 0.25
#: Corrections of pairs that are worked out at once, and groups by terms of a dense part.
AT_ONCE = 1_000_000
SALTS = 16

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
#: A-Z lowered; what is no letter of ASCII nor beyond it becomes a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each group's terms, in parts."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for key, own in n.items():
            has = docs[key]
            for at in range(0, len(terms := list(own)), 50_000):
                some = terms[at : at + 50_000]
                rows = [[key[0]] * len(some), [key[1]] * len(some), pa.array(some, pa.binary()).cast(pa.string()), [own[t] for t in some], [has[t] for t in some]]
                yield pa.RecordBatch.from_arrays([pa.array(r, k) if isinstance(r, list) else r for r, k in zip(rows, _COUNTED.types, strict=True)], schema=_COUNTED)
        n.clear()
        docs.clear()

    for batch in batches:
        for text, lang, source in zip(texts(batch), column(batch, "lang").to_pylist(), column(batch, "source").to_pylist(), strict=True):
            words = Counter(text.translate(_WORDS).split()) if text else Counter()
            if words:
                n.setdefault((lang, source), Counter()).update(words)
                docs.setdefault((lang, source), Counter()).update(words.keys())
        if sum(map(len, n.values())) > HELD_TERMS:
            yield from told()
    yield from told()


def _share(count: str, total: str, terms: str) -> F.Column:
    """p, exact beyond 64 bits on the way."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(19, 0))) div CAST({total} + {terms} AS DECIMAL(19, 0))")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def sparse_sums(g: np.ndarray, term: np.ndarray, p: np.ndarray, h: np.ndarray, term_h: np.ndarray, p_h: np.ndarray, p0: np.ndarray, q0: np.ndarray) -> np.ndarray:
    """Sums over rare terms of f less the f of absence, left groups by right ones, from postings (group, term, p) of either side, right ones by term."""
    out = np.zeros((len(p0), len(q0)), np.int64)
    base = _f(p0[:, None], q0[None, :])
    for own, mass, of, right in ((g, p, p0, False), (h, p_h, q0, True)):
        (group, value), times = np.unique(np.stack([own, mass]), axis=1, return_counts=True)
        for i in range(len(of)):
            mine = group == i
            if not mine.any():
                continue
            v, t = value[mine][:, None], times[mine][:, None]
            if right:
                out[:, i] += ((_f(p0[None, :], v) - base[:, i][None, :]) * t).sum(0)
            else:
                out[i] += ((_f(v, q0[None, :]) - base[i][None, :]) * t).sum(0)
    # both hold the term: what the two sides added apart gives way to the pair's own f
    first, last = np.searchsorted(term_h, term, "left"), np.searchsorted(term_h, term, "right")
    met = last - first
    ends = np.cumsum(met)
    at = 0
    while at < len(term):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        left = np.repeat(np.arange(at, end), met[at:end])
        right = np.arange(len(left)) - np.repeat(ends[at:end] - met[at:end] - done, met[at:end]) + np.repeat(first[at:end], met[at:end])
        a, b = g[left], h[right]
        fix = _f(p[left], p_h[right]) - _f(p[left], q0[b]) - _f(p0[a], p_h[right]) + base[a, b]
        np.add.at(out, (a, b), fix)
        at = end
    return out


def dense_sums(g: np.ndarray, term: np.ndarray, p: np.ndarray, h: np.ndarray, term_h: np.ndarray, p_h: np.ndarray, p0: np.ndarray, q0: np.ndarray) -> np.ndarray:
    """The same over heavy terms, from full tiles."""
    out = np.zeros((len(p0), len(q0)), np.int64)
    base = _f(p0[:, None], q0[None, :])
    terms = np.unique(np.concatenate([term, term_h]))
    step = max(1, AT_ONCE // max(len(p0), len(q0), 1))
    for low in range(0, len(terms), step):
        some = terms[low : low + step]
        a, b = np.repeat(p0[:, None], len(some), 1), np.repeat(q0[:, None], len(some), 1)
        for own, word, mass, tile in ((g, term, p, a), (h, term_h, p_h, b)):
            place = np.searchsorted(some, word)
            here = (word >= some[0]) & (word <= some[-1])
            tile[own[here], place[here]] = mass[here]
        for i in range(len(p0)):
            out[i] += _f(a[i][None, :], b).sum(1) - len(some) * base[i]
    return out


def _tile(table: pa.Table) -> pa.Table:
    """Part sums of the pairs of two blocks over a tile's terms; of tile -1, over absent terms alone."""
    side, source = (table.column(c).to_numpy(zero_copy_only=False) for c in ("side", "source"))
    # terms by number within the task; absent ones, which only name their group, are -1
    term = table.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    p, p0, heavy = (table.column(c).to_numpy(zero_copy_only=False) for c in ("p", "p0", "heavy"))
    first = table.slice(0, 1).to_pylist()[0]
    named, parts = [], []
    for s in (0, 1):
        own = (side == s) | (side == 2)
        names, inverse = np.unique(source[own].astype(object), return_inverse=True)
        zero = np.zeros(len(names), np.int64)
        zero[inverse] = p0[own]
        named.append((names, zero))
        held = term[own] >= 0
        order = np.argsort(term[own][held], kind="stable")
        parts.append((inverse[held][order], term[own][held][order], p[own][held][order], heavy[own][held][order]))
    (left, left0), (right, right0) = named
    if first["tile"] < 0:
        sums = first["terms"] * _f(left0[:, None], right0[None, :])
    else:
        sums = np.zeros((len(left), len(right)), np.int64)
        for is_heavy, way in ((True, dense_sums), (False, sparse_sums)):
            (g, t, v, w), (h, u, x, y) = parts
            a, b = w == is_heavy, y == is_heavy
            if a.any() or b.any():
                sums += way(g[a], t[a], v[a], h[b], u[b], x[b], left0, right0)
    i, j = np.nonzero((left[:, None] != right[None, :]) & ((sums != 0) | (first["tile"] < 0)))
    return pa.table({"lang": pa.array([first["lang"]] * len(i), pa.string()), "source": pa.array(left[i], pa.string()), "item": pa.array(right[j], pa.string()), "value": pa.array(sums[i, j], pa.int64())})


def source_divergence(docs: DataFrame, top_terms: int = TOP_TERMS, heavy_share: float = HEAVY_SHARE, tile_postings: int = TILE_POSTINGS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group is from the language's other groups, and by which terms.

    Part `pair` has every other source of the language, with f summed over all
    kept terms; part `term` the group's terms whose share exceeds the language's,
    with f against that, up to top_terms of them. Ranks go by value, descending,
    then by item as UTF-8. Null text, lang and source are ''; a text without terms
    still makes its group occur; in a language without kept terms all pair values
    are 0. A language with one source has no pairs. Repeated rows count like
    others. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    # one shuffle: a term's groups lie together, so counting, what the language has of it, and the choice need no other
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counts = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    held = counts.withColumns({"docs": F.sum("docs").over(term), "n_lang": F.sum("n").over(term), "groups": F.count("*").over(term), "head": F.col("source") == F.min("source").over(term)})
    postings = stored(held.where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"))

    by_lang = postings.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("postings"), F.count_if("head").alias("terms"))
    names = rows.select("lang", "source").distinct()
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = names.groupBy("lang").agg(F.count("*").alias("sources"))
    langs = sizes.join(by_lang, "lang", "left").na.fill(0, ["total", "postings", "terms"])
    langs = checkpointed(langs.withColumns({"tiles": F.ceil(F.col("postings") / tile_postings), "blocks": F.ceil(F.col("sources") / block_groups)}))
    # a language without kept terms has no shares, only pairs of value 0
    whole = names.join(own, ["lang", "source"], "left").na.fill(0, ["total"]).join(broadcast_if_small(langs.drop("total", "postings")), "lang")
    whole = whole.withColumn("p0", F.when(F.col("terms") > 0, _share("0L", "total", "terms")).otherwise(1))
    groups = checkpointed(whole.withColumn("block", F.pmod(F.xxhash64("source", F.lit(1)), "blocks")))

    shared = broadcast_if_small(groups.select("lang", "source", F.col("total").alias("own"), "terms", "sources", "tiles", "blocks", "block", "p0"))
    known = postings.join(shared, ["lang", "source"]).withColumn("p", _share("n", "own", "terms"))
    known = known.join(broadcast_if_small(langs.select("lang", F.col("total").alias("all"))), "lang").withColumn("q", _share("n_lang", "all", "terms"))

    top = known.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    top = top.withColumn("_s", F.pmod(F.xxhash64("item"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "_s").orderBy(*order))).where(F.col("rank") <= top_terms)
    top = top.drop("_s").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top_terms)

    # every posting to the pairs of blocks that its group is in, as left (0), right (1) or both (2); each group to all of them
    heavy = (F.col("groups") >= F.greatest(F.lit(2), F.ceil(F.col("sources") * F.lit(heavy_share)))).alias("heavy")
    tile = F.pmod(F.xxhash64("term"), "tiles").cast("int").alias("tile")
    cells = known.select("lang", tile, "source", "term", "p", "p0", heavy, "terms", "block", "blocks")
    absent = groups.where("blocks > 0").withColumn("tile", F.explode(F.expr("sequence(-1, CAST(tiles AS INT) - 1)")))
    cells = cells.unionByName(absent.select("lang", "tile", "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "p0", F.lit(False).alias("heavy"), "terms", "block", "blocks"))
    to = F.transform(F.expr("sequence(0L, blocks - 1)"), lambda x: F.when(x == F.col("block"), F.array(F.struct(F.lit(2).alias("side"), x.alias("i"), x.alias("j")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("block").alias("i"), x.alias("j")), F.struct(F.lit(1).alias("side"), x.alias("i"), F.col("block").alias("j")))))
    dealt = cells.withColumn("_to", F.explode(F.flatten(to))).select("*", "_to.*").drop("_to")
    parts = dealt.drop("block", "blocks").groupBy("lang", "tile", "i", "j").applyInArrow(_tile, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    made = [x.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for x, part in ((pairs, "pair"), (top, "term"))]
    return made[0].unionByName(made[1])
