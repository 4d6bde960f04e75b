"""Density clusters, their distinctive keywords, and the stories behind them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.checkpoints import broadcast_if_small, checkpointed
from tidewatch.functions.text import tokens
from tidewatch.functions.vocabulary import LONE_CLUSTER_STOPWORDS
from tidewatch.operators.crosschannel import components

#: Clustering and keyword defaults.
EPS, MIN_SAMPLES, TOP_KEYWORDS = 0.5, 5, 8
BLOCK_POINTS = 4000
#: Pivots that split a large cell, about; rows that meet them in a task; splits of splits at most.
PIVOTS, PART_ROWS, LEVELS = 48, 20_000, 6
#: Cells that a point of a cell is in after a split, on average and at most; points whose distances to others are held at once.
MOST_COPIES, CHUNK = 4, 128
SPIKE, LEAST_BUCKETS, BASELINE_SECONDS = 2.0, 24, 7 * 86400


def close_to(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which points of a lie within eps of which of b."""
    return distance_sides(a)[0] @ distance_sides(b)[1] <= eps * eps + 1e-9


def distance_sides(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns): a row of some points times a column of others is their squared distance, in one product."""
    squares = (points * points).sum(axis=1)[:, None]
    ones = np.ones_like(squares)
    return np.hstack([points, squares, ones]), np.ascontiguousarray(np.hstack([-2 * points, ones, squares]).T)


def density_labels(points: np.ndarray, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> np.ndarray:
    """Cluster of each point, -1 for noise.

    Points with min_samples neighbours within eps, themselves included, are core;
    clusters are components of core points, numbered by their first; other points
    join the first cluster with a core point near.
    """
    n = len(points)
    # a bit a pair
    rows, columns = distance_sides(points)
    near = np.concatenate([np.packbits(rows[at : at + CHUNK] @ columns <= eps * eps + 1e-9, axis=1) for at in range(0, n, CHUNK)]) if n else np.zeros((0, 0), np.uint8)
    met = lambda i: np.unpackbits(near[i], count=n).view(bool)
    core = np.array([np.count_nonzero(met(i)) >= min_samples for i in range(n)], bool)
    labels, found = np.full(n, -1), 0
    for i in np.flatnonzero(core):
        if labels[i] >= 0:
            continue
        labels[i], todo = found, [i]
        while todo:
            fresh = np.flatnonzero(met(todo.pop()) & (labels < 0))
            labels[fresh] = found
            todo += fresh[core[fresh]].tolist()
        found += 1
    return labels


def cluster(points: DataFrame, by: str, key: str, vector: str, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """by, key, cluster_id of points by density_labels' rules, however large a group is; key is unique in its group.

    Groups of BLOCK_POINTS at most are a task's each; larger ones go by blocks.
    """
    kinds = dict(points.dtypes)
    counts = points.groupBy(by).agg(F.count("*").alias("_n"))
    large = counts.where(F.col("_n") > BLOCK_POINTS)
    any_large = not large.isEmpty()
    small = points.join(large.select(by), by, "left_anti") if any_large else points

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        labels = density_labels(np.stack(pdf[vector].to_numpy()).astype(np.float64), eps, min_samples)
        return pd.DataFrame({by: pdf[by], key: pdf[key], "cluster_id": labels})

    out = small.select(by, key, vector).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {key} {kinds[key]}, cluster_id long")
    return out.unionByName(block_clusters(points.join(large.select(by), by, "left_semi"), by, key, vector, eps, min_samples)) if any_large else out


def cell_halo(points: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot of each point, points by pivots: whether the point may lie within eps of a point of the pivot's cell).

    A cell is what its pivot is nearest to. A point of cell p that is within eps of
    one of cell q is within eps of the plane half way between p and q.
    """
    squares = np.maximum((points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * points @ pivots.T, 0)
    nearest = squares.argmin(axis=1)
    apart = np.sqrt(np.maximum((pivots * pivots).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * pivots @ pivots.T, 0))[nearest]
    past = squares - squares[np.arange(len(points)), nearest][:, None]
    inside = past <= 2 * apart * (eps + 1e-9) + 1e-9
    inside[np.arange(len(points)), nearest] = True
    return nearest, inside


def metric_cells(rows: DataFrame, eps: float, cell_points: int = BLOCK_POINTS, pivots: int = PIVOTS) -> DataFrame:
    """rows (g, k, v) dealt into cells: (cell, g, k, v, own), each row once as own, and a copy (not own) in every other cell that may hold a point within eps of it.

    A group is a cell to begin with. Cells of more than cell_points own points are
    split by pivots, a seeded sample of their points, and what of it is too
    large is split again. A cell whose points lie too close together to be split
    stays as it is, and so does one whose split would copy a point to more than
    MOST_COPIES cells: eps is wide there, as it is in many dimensions. Points and
    their cell's pivots meet in parts of a bounded number of rows; a point comes
    back once, with its cells, and Spark makes the copies.
    """
    names = ["cell", "g", "k", "v", "own"]
    kinds = dict(rows.dtypes)
    schema = f"cell string, g {kinds['g']}, k {kinds['k']}, v array<double>, own boolean"
    todo = rows.select(F.concat(F.lit("c"), F.hex(F.xxhash64("g"))).alias("cell"), "g", "k", "v", F.lit(True).alias("own"))
    done = None
    for level in range(LEVELS):
        todo = checkpointed(todo)
        sizes = checkpointed(todo.groupBy("cell").agg(F.count_if("own").alias("_own"), F.count("*").alias("_all")))
        if level:  # a split that leaves most of a cell in one piece leads nowhere
            above = was.select(F.col("cell").alias("_up"), F.col("_own").alias("_was"))
            sizes = checkpointed(sizes.withColumn("_up", F.substring_index("cell", "/", level)).join(above, "_up").drop("_up"))
        else:
            sizes = sizes.withColumn("_was", F.lit(None).cast("long"))
        large = (F.col("_own") > cell_points) & F.coalesce(F.col("_own") < 0.9 * F.col("_was"), F.lit(True))
        split = sizes.where(large).select("cell", "_own", "_all")
        ready = todo.join(sizes.where(~large).select("cell"), "cell", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        if split.isEmpty():
            return done.select(names)
        was = checkpointed(split)
        held = todo.join(was, "cell")
        lots = F.xxhash64(F.lit(level), "k")
        # about pivots of each cell, by lot: no order over a cell's points
        chosen = held.where("own").where(F.pmod(lots, F.lit(1 << 30)) < F.lit(1 << 30) * F.least(F.lit(1.0), pivots * 1.0 / F.col("_own")))
        parts = F.ceil(F.col("_all") / PART_ROWS)
        dealt = held.withColumn("_part", F.pmod(F.xxhash64("k"), parts)).drop("_own", "_all")
        sent = chosen.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select(F.col("cell").alias("_of"), F.col("_part").alias("_to"), F.col("k").alias("pk"), F.col("v").alias("pv"))

        def assign(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
            own = own[names].copy()
            if own.empty or given.empty:  # no lot fell on the cell: it comes again, under other lots
                return own.assign(to=[[0]] * len(own))
            given = given.sort_values("pk")
            nearest, inside = cell_halo(np.stack(own["v"].to_numpy()), np.stack(given["pv"].to_numpy()), eps)
            inside[np.arange(len(own)), nearest] = False
            own["to"] = [[first, *np.flatnonzero(row).tolist()] for first, row in zip(nearest.tolist(), inside, strict=True)]
            return own

        placed = checkpointed(dealt.groupBy("cell", "_part").cogroup(sent.groupBy("_of", "_to")).applyInPandas(assign, f"{schema}, to array<int>"))
        wide = checkpointed(placed.groupBy("cell").agg((F.sum(F.size("to")) > MOST_COPIES * F.count("*")).alias("_wide")).where("_wide").drop("_wide"))
        done = done.unionByName(placed.drop("to").join(wide, "cell", "left_semi"))
        copies = placed.join(wide, "cell", "left_anti").select("*", F.posexplode("to").alias("_at", "_q"))
        todo = copies.select(F.concat_ws("/", "cell", F.col("_q").cast("string")).alias("cell"), "g", "k", "v", (F.col("own") & (F.col("_at") == 0)).alias("own"))
    return done.unionByName(todo).select(names)


def block_clusters(points: DataFrame, by: str, key: str, vector: str, eps: float = EPS, min_samples: int = MIN_SAMPLES, cell_points: int | None = None) -> DataFrame:
    """cluster() for groups of any size.

    Equal points are one with a weight. Points lie in metric cells, with copies of
    near ones from other cells, so that a point meets all its neighbours in its own
    cell; a cell that could not be split small is met in pairs of blocks. A first
    round counts neighbours, which makes core points; a second finds per task a
    spanning forest of core points and each other point's core neighbours.
    Components of the forests are the clusters.
    """
    kinds, cell_points = dict(points.dtypes), cell_points or BLOCK_POINTS
    key_kind, group_kind = kinds[key], kinds[by]
    given = points.select(F.col(by).alias("g"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    single = checkpointed(given.groupBy("g", "v").agg(F.min("k").alias("k"), F.count("*").alias("w")))
    cells = checkpointed(metric_cells(single.drop("w"), eps, cell_points))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / (3 * cell_points)).alias("blocks"))
    placed = cells.join(sizes, "cell").join(single.select("g", "k", "w"), ["g", "k"]).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")))

    def paired(rows: DataFrame) -> DataFrame:
        other = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return other.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")

    def sides(pdf: pd.DataFrame) -> list[tuple[pd.DataFrame, pd.DataFrame, bool]]:
        """Own points, those that they meet, and whether those are own points that meet the first here too."""
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        pdf = pdf.sort_values("k")
        a, b = pdf[pdf["block"] == low], pdf[pdf["block"] == high]
        if low == high:
            pairs = [(a[a["own"]], b, False)]
        elif pdf["own"].all():
            pairs = [(a, b, True)]
        else:
            pairs = [(a[a["own"]], b, False), (b[b["own"]], a, False)]
        return [p for p in pairs if len(p[0]) and len(p[1])]

    def near_rows(x: np.ndarray, y: np.ndarray):
        """Which points of y lie near each of some points of x, whose slice comes first."""
        rows, columns = distance_sides(x)[0], distance_sides(y)[1]
        for at in range(0, len(x), CHUNK):
            yield slice(at, at + CHUNK), rows[at : at + CHUNK] @ columns <= eps * eps + 1e-9

    def vectors(rows: pd.DataFrame) -> np.ndarray:
        return np.stack(rows["v"].to_numpy())

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"g": pdf["g"].iloc[:0], "k": pdf["k"].iloc[:0], "n": np.zeros(0, np.int64)})]
        for a, b, both in sides(pdf):
            found, back = np.zeros(len(a)), np.zeros(len(b))
            weigh, met = a["w"].to_numpy(np.float64), b["w"].to_numpy(np.float64)
            for part, near in near_rows(vectors(a), vectors(b)):
                near = near.astype(np.float64)
                found[part] = near @ met
                if both:
                    back += weigh[part] @ near
            out += [pd.DataFrame({"g": x["g"], "k": x["k"], "n": n.astype(np.int64)}) for x, n in ((a, found), (b, back))[: 1 + both]]
        return pd.concat(out)

    counts = paired(placed).groupBy("g", "cell", "low", "high").applyInPandas(count, f"g {group_kind}, k {key_kind}, n long")
    core = counts.groupBy("g", "k").agg((F.sum("n") >= min_samples).alias("core"))
    known = checkpointed(placed.join(core, ["g", "k"]))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        keys = pdf["k"].to_numpy()
        names, place = np.unique(keys, return_inverse=True)
        root, out = np.arange(len(names)), []
        here = pd.Series(place, index=pdf.index)
        for core_now in (True, False):  # the others once components of this task's core points are known
            ends = [(a, b) for a, b, _ in sides(pdf)] + [(b, a) for a, b, both in sides(pdf) if both and not core_now]
            for a, b in ends:
                a, b = a[a["core"].to_numpy(bool) == core_now], b[b["core"].to_numpy(bool)]
                if not len(a) or not len(b):
                    continue
                mine, theirs = here[a.index].to_numpy(), here[b.index].to_numpy()
                for part, near in near_rows(vectors(a), vectors(b)):
                    if core_now:
                        near &= root[theirs] != root[mine[part]][:, None]
                        for i, row in zip(mine[part], near, strict=True):
                            others = np.unique(root[theirs[row]]) if row.any() else ()
                            if len(others):
                                into = np.arange(len(names))
                                into[others] = root[i]
                                root = into[root]
                    else:
                        at, met = np.nonzero(near)
                        i, j = mine[part][at], theirs[met]
                        out += [(names[i[f]], names[j[f]], False) for f in np.unique(i * len(names) + root[j], return_index=True)[1]]
            if core_now:  # a component as a star around its first point
                first = np.full(len(names), len(names))
                np.minimum.at(first, root, np.arange(len(names)))
                out += [(names[i], names[j], True) for i, j in enumerate(first[root]) if i != j]
        found = pd.DataFrame(out, columns=["k", "core_k", "both"])
        found.insert(0, "g", pdf["g"].iloc[0])
        return found

    links = checkpointed(paired(known).groupBy("g", "cell", "low", "high").applyInPandas(join, f"g {group_kind}, k {key_kind}, core_k {key_kind}, both boolean"))
    node = lambda k: F.struct("g", F.col(k).alias("k"))
    labels = components(links.where("both").select(node("k").alias("a"), node("core_k").alias("b")))
    core_points = known.where("core AND own").select(node("k").alias("id"))
    roots = core_points.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("root"))
    # clusters by the first core point of each
    numbers = roots.select("root").distinct().select("root", (F.row_number().over(Window.partitionBy("root.g").orderBy("root.k")) - 1).cast("long").alias("cluster_id"))
    inner = roots.join(numbers, "root").select("id", "cluster_id")
    border = links.where("NOT both").select(node("k").alias("point"), node("core_k").alias("id")).join(inner, "id").groupBy(F.col("point").alias("id")).agg(F.min("cluster_id").alias("cluster_id"))
    found = inner.unionByName(border).select("id.g", "id.k", "cluster_id")
    labelled = single.join(found, ["g", "k"], "left").select(F.col("g").alias("_g"), F.col("v").alias("_v"), F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id"))
    same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("v") == F.col("_v"))
    return given.join(labelled, same).select(F.col("g").alias(by), F.col("k").alias(key), "cluster_id")


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A stand-in where no embedding column exists: unit-length counts of hashed tokens."""
    slots = F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def class_tfidf(words: DataFrame, by: list[str], top: int = TOP_KEYWORDS, usual: DataFrame | None = None) -> DataFrame:
    """by, cluster_id, token, n, tf, df, score, place: the distinctive tokens of each cluster.

    words: by, cluster_id, token, and optionally first (a tie goes to the token
    seen first, then by spelling). Score is frequency in the cluster times
    ln((clusters + 1) / (clusters with it + 1)) + 1, damped by `usual` (by, token,
    base, buckets) where given. Where a group has a single cluster its further
    stop words go from the top, unless that would leave nothing.
    """
    group = [*by, "cluster_id"]
    first = F.min("first") if "first" in words.columns else F.lit(0)
    # words are read once: all that follows works on counts
    counts = checkpointed(words.where("cluster_id >= 0").groupBy(*group, "token").agg(F.count("*").alias("n"), first.alias("first")))
    totals = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    sizes = totals.groupBy(*by).agg(F.count("*").alias("clusters"))
    totals = checkpointed(totals.join(sizes, by) if by else totals.crossJoin(F.broadcast(sizes)))  # one row
    df = F.count("*").over(Window.partitionBy(*by, "token"))
    met = counts.withColumn("df", df).join(broadcast_if_small(totals), group)
    tf = F.col("n") / F.col("total")
    scored = met.withColumn("tf", tf).withColumn("score", tf * (F.log((F.col("clusters") + 1) / (F.col("df") + 1)) + 1))
    if usual is not None:
        scored = scored.join(usual.select(*by, "token", "base", "buckets"), [*by, "token"], "left")
        scored = scored.withColumn("score", penalised(F.col("score"), F.col("n"), F.coalesce("base", F.lit(0)), F.coalesce("buckets", F.lit(0))))
    # rounded beforehand, or a sort rounds both sides of every comparison
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_near"), "first", "token"))
    best = scored.withColumn("_near", F.round("score", 12)).withColumn("place", place).where(F.col("place") <= top)
    plain = ~F.col("token").isin(*sorted(LONE_CLUSTER_STOPWORDS))
    any_plain = F.max(plain.cast("int")).over(Window.partitionBy(*group)) == 1
    return best.withColumn("_any", any_plain).where((F.col("clusters") > 1) | ~F.col("_any") | plain).select(*group, "token", "n", "tf", "df", "score", "place")


def penalised(score: Column, n: Column, base: Column, buckets: Column, spike: float = SPIKE, least: int = LEAST_BUCKETS) -> Column:
    """A keyword's score against its usual rate: kept where it spikes or history is short, else damped."""
    rate = base / F.greatest(buckets, F.lit(1))
    return F.when((buckets < least) | (n / F.greatest(F.lit(0.1), rate) >= spike), score).otherwise(score / (1 + F.log(rate + 1)))


def token_baseline(calls: DataFrame, seconds: int = BASELINE_SECONDS) -> DataFrame:
    """calls (call_id, window_start, token, n) with base, the token's count over the calls of the last `seconds`, this one included, and buckets, their number."""
    frame = lambda *p: Window.partitionBy(*p).orderBy("window_start").rangeBetween(-seconds, 0)
    calls = checkpointed(calls)  # counted once
    starts = calls.select("call_id", "window_start").distinct().groupBy("window_start").agg(F.count("*").alias("own"))
    buckets = starts.select("window_start", F.sum("own").over(Window.orderBy("window_start").rangeBetween(-seconds, 0)).alias("buckets"))
    return calls.withColumn("base", F.sum("n").over(frame("token"))).join(buckets, "window_start")


def attribute(members: DataFrame, by: list[str], top_domains: int = 5) -> DataFrame:
    """by, size, top_story_id, top_story_pct, top_story_title, unique_story_count, story_ids, top_domains of each cluster.

    members: by, story_id, story_title, domain, pos (order seen). Members whose
    story_id is 0 are unknown: they count in size alone. The top story is the most
    frequent, of equal ones the first seen; its share is of the known.
    """
    known = members.where("story_id <> 0")
    stories = known.groupBy(*by, "story_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"), F.min_by("story_title", "pos").alias("title"))
    top = stories.groupBy(*by).agg(
        F.max_by(F.struct("story_id", "n", "title"), F.struct("n", -F.col("pos"))).alias("top"), F.sum("n").alias("known"), F.count("*").alias("unique_story_count"), F.array_sort(F.collect_list("story_id")).alias("story_ids"),
    )
    hosts = members.where("domain <> ''").groupBy(*by, "domain").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "pos", "domain"))
    hosts = hosts.withColumn("place", place).where(F.col("place") <= top_domains).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "domain"))), lambda x: x["domain"]).alias("hosts"))
    sizes = members.groupBy(*by).agg(F.count("*").alias("size"))
    met = sizes.join(top, by, "left").join(hosts, by, "left")
    none = F.array().cast("array<string>")
    return met.select(
        *by, "size", F.coalesce("top.story_id", F.lit(0)).alias("top_story_id"), F.round(F.coalesce(F.col("top.n") / F.col("known"), F.lit(0.0)), 3).alias("top_story_pct"), F.coalesce("top.title", F.lit("")).alias("top_story_title"),
        F.coalesce("unique_story_count", F.lit(0)).cast("long").alias("unique_story_count"), F.coalesce("story_ids", F.array().cast("array<bigint>")).alias("story_ids"), F.when(F.col("known") > 0, F.coalesce("hosts", none)).otherwise(none).alias("top_domains"),
    )


def collect_texts(items: DataFrame, windows: DataFrame, most: int = 500, width: int = 120, bucket: int = 3600) -> DataFrame:
    """window_id, id, text: items of a window's channel with window_start <= sec <= window_end, a reproducible sample of `most` each.

    The range join runs on (channel, bucket of time): a window is listed under
    every bucket it touches, an item under its own.
    """
    reach = F.explode(F.sequence(F.floor(F.col("window_start") / bucket), F.floor(F.col("window_end") / bucket))).alias("bucket")
    spread = windows.select("window_id", F.col("channel").alias("c"), "window_start", "window_end", reach)
    own = items.withColumn("b", F.floor(F.col("sec") / bucket))
    met = own.join(spread, (F.col("channel") == F.col("c")) & (F.col("b") == F.col("bucket")) & F.col("sec").between(F.col("window_start"), F.col("window_end")))
    rank = F.row_number().over(Window.partitionBy("window_id").orderBy(F.xxhash64("id"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= most).select("window_id", "id", F.substring("body", 1, width).alias("text"))


def reduced(points: DataFrame, vector: str, axes: int = 2) -> DataFrame:
    """points with `reduced`, their vectors on the main axes: a linear stand-in for a learned projection.

    One task a partition sums vectors and products; the axes come from the d x d
    sums alone. Signs are fixed by each axis's largest part.
    """
    size = len(points.select(vector).first()[0])

    def sums(batches):
        n, total, products = 0, np.zeros(size), np.zeros((size, size))
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        yield pd.DataFrame({"n": [n], "total": [total.tolist()], "products": [products.ravel().tolist()]})

    parts = points.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(sums, "n long, total array<double>, products array<double>")
    cell = parts.select("n", F.posexplode(F.concat("total", "products")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()  # d + d * d numbers
    n, flat = cell[0]["n"], np.array([r["x"] for r in cell])
    mean = flat[:size] / n
    _, vectors = np.linalg.eigh(flat[size:].reshape(size, size) / n - np.outer(mean, mean))
    main = vectors[:, ::-1][:, :axes]
    main = main * np.sign(main[np.abs(main).argmax(axis=0), np.arange(main.shape[1])])
    on = lambda axis: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(a)).alias("a")) for m, a in zip(mean, axis, strict=True)]), lambda x, p: (x - p["m"]) * p["a"]), F.lit(0.0), lambda s, x: s + x)
    return points.withColumn("reduced", F.array(*[on(main[:, k]) for k in range(main.shape[1])]))
