"""A neighbour-graph projection of a window's vectors, for density clusters in few dimensions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.checkpoints import checkpointed
from tidewatch.operators.embedding import _dropped, _numbers, _pieces, _written

#: Neighbours of a point, axes of the projection, rounds of the layout, points that a task lays out (a window's sample has 500), rounds between which the parts of a larger group tell each other their places.
NEIGHBOURS, AXES, ROUNDS, MOST_POINTS, TURNS = 15, 2, 200, 5000, 5
SEED = 42
#: The curve 1 / (1 + A d^2B) that stays near 1 up to a distance of 0.1 and fades beyond.
A, B = 1.577, 0.895


def nearest(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of each point's k nearest others, ties by place."""
    squares, places, apart = (points * points).sum(axis=1), [], []
    for at in range(0, len(points), 512):
        d = np.sqrt(np.maximum(squares[at : at + 512, None] + squares - 2 * points[at : at + 512] @ points.T, 0))
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        best = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :k]
        places.append(best)
        apart.append(np.take_along_axis(d, best, axis=1))
    return np.concatenate(places), np.concatenate(apart)


def sureness(apart: np.ndarray) -> np.ndarray:
    """How sure points are of their nearest ones, by distance: the nearest is sure, the others fade."""
    n, k = apart.shape
    beyond = np.maximum(apart - apart[:, :1], 0)
    low, high, wanted = np.zeros(n), np.full(n, np.inf), np.log2(k) if k > 1 else 1.0
    scale = np.ones(n)
    for _ in range(48):
        short = np.exp(-beyond / scale[:, None]).sum(axis=1) < wanted
        low, high = np.where(short, scale, low), np.where(short, high, scale)
        scale = np.where(np.isinf(high), scale * 2, (low + np.where(np.isinf(high), 0, high)) / 2)
    scale = np.maximum(scale, 1e-3 * max(apart.mean(), 1e-9))
    return np.exp(-beyond / scale[:, None])


def edge_weights(places: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one end, a later one, how sure they are to be neighbours) of each pair, in order.

    A point's nearest neighbour is sure; the others fade at the scale at which the
    weights of its k neighbours sum to log2 k. Either side's word counts:
    a + b - a b.
    """
    n, k = places.shape
    key = np.repeat(np.arange(n), k) * n + places.ravel()
    value = sureness(apart).ravel()
    order = np.argsort(key)
    key, value = key[order], value[order]
    pair = np.unique(np.minimum(key, key % n * n + key // n))
    head, tail = pair // n, pair % n

    def said(wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        return np.where(key[at] == wanted, value[at], 0.0)

    a, b = said(pair), said(tail * n + head)
    weight = a + b - a * b
    there = weight > 0
    return head[there], tail[there], weight[there]


def main_directions(products: np.ndarray, axes: int) -> np.ndarray:
    """The main axes of centred points by the sums of their products, signs fixed; zeros beyond as many as there are."""
    _, main = np.linalg.eigh(products)
    main = main[:, ::-1][:, :axes]
    main = main * np.where(main[np.abs(main).argmax(axis=0), np.arange(main.shape[1])] < 0, -1, 1)
    return np.pad(main, ((0, 0), (0, axes - main.shape[1])))


def pulls(way: np.ndarray) -> np.ndarray:
    """How far a round draws an edge's end to the other, by the way from that one."""
    squares = (way * way).sum(axis=1)
    pull = np.clip((-2 * A * B * squares ** np.maximum(B - 1, -1) / (1 + A * squares**B))[:, None] * way, -4, 4) if len(way) else way
    pull[squares == 0] = 0
    return pull


def pushes(way: np.ndarray) -> np.ndarray:
    """How far a round pushes a point off another, by the way from that one."""
    squares = (way * way).sum(axis=1)
    return np.clip((2 * B / ((0.001 + squares) * (1 + A * squares**B)))[:, None] * way, -4, 4)


def start(points: np.ndarray, axes: int, rng: np.random.Generator) -> np.ndarray:
    """The points on their main axes, signs fixed, with a little noise that parts equal points."""
    plain = points - points.mean(axis=0)
    place = plain @ main_directions(plain.T @ plain, axes)
    return 10 * place / max(np.abs(place).max(), 1e-9) + rng.normal(0, 1e-4, place.shape)


def project(points: np.ndarray, axes: int = AXES, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """points laid out in few axes, so that graph neighbours lie together; the same at every run.

    In each round an edge pulls its ends together as often as its weight says, and
    each point is pushed off from random others.
    """
    n, rng = len(points), np.random.default_rng(seed)
    if n <= axes + 1:
        return np.pad(np.asarray(points, float), ((0, 0), (0, max(0, axes - points.shape[1]))))[:, :axes]
    head, tail, weight = edge_weights(*nearest(points, min(neighbours, n - 1)))
    place = start(points, axes, rng)
    keep = weight >= weight.max() / rounds
    head, tail, weight = head[keep], tail[keep], weight[keep] / weight.max()
    for turn in range(rounds):
        step = 1 - turn / rounds
        due = np.floor((turn + 1) * weight) > np.floor(turn * weight)
        a, b = head[due], tail[due]
        pull = pulls(place[a] - place[b])
        move = np.zeros_like(place)
        np.add.at(move, a, pull)
        np.add.at(move, b, -pull)
        ends = np.concatenate([a, b])
        for _ in range(5):
            other = rng.integers(0, n, len(ends))
            push = pushes(place[ends] - place[other])
            push[other == ends] = 0
            np.add.at(move, ends, push)
        place = place + step * np.clip(move, -4, 4)
    return place


def nearest_of_parts(points: np.ndarray, own: int, parts: Iterator[tuple[int, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts, places, distances) of each point's k nearest others of all parts, of which its own is one; ties by part and place."""
    m, squares = len(points), (points * points).sum(axis=1)
    part, place, apart = np.full((m, k), -1), np.full((m, k), -1), np.full((m, k), np.inf)
    for q, others in parts:
        theirs = (others * others).sum(axis=1)
        for at in range(0, m, 256):
            rows = slice(at, min(at + 256, m))
            d = np.round(np.sqrt(np.maximum(squares[rows, None] + theirs - 2 * points[rows] @ others.T, 0)), 9)
            if q == own:
                d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            limit = apart[rows, -1:]
            if d.shape[1] > k:
                limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1 : k])
            i, j = np.nonzero((d <= limit) & np.isfinite(d))
            row = np.concatenate([np.repeat(np.arange(len(d)), k), i])
            far, of, to = np.concatenate([apart[rows].ravel(), d[i, j]]), np.concatenate([part[rows].ravel(), np.full(len(i), q)]), np.concatenate([place[rows].ravel(), j])
            order = np.lexsort((to, of, far, row))
            best = order[np.arange(len(order)) - np.searchsorted(row[order], np.arange(len(d)))[row[order]] < k]
            part[rows], place[rows], apart[rows] = of[best].reshape(-1, k), to[best].reshape(-1, k), far[best].reshape(-1, k)
    return part, place, apart


_EDGES = "cell string, parts int, i binary, part binary, j binary, w binary"


def _edges(cell: str, parts: int, i: np.ndarray, part: np.ndarray, j: np.ndarray, w: np.ndarray) -> dict:
    """A part's points, the parts and places of others that they are near to, and how sure that is."""
    return {"cell": cell, "parts": parts} | {c: v.astype("<i4").tobytes() for c, v in (("i", i), ("part", part), ("j", j))} | {"w": w.astype("<f8").tobytes()}


def _part_of(folder: str, cell: str, column: str, width: int) -> np.ndarray:
    """The numbers of one of a group's parts; none where no point fell on it."""
    found = [_numbers(r[column]).reshape(-1, width) for piece in _pieces(f"{folder}/cell={cell}", [column]) for r in piece.to_pylist()]
    return found[0] if found else np.zeros((0, width))


def whole_layout(wide: DataFrame, by: list[str], key: str, vector: str, axes: int, neighbours: int, most: int, rounds: int = ROUNDS, turns: int = TURNS, seed: int = SEED) -> DataFrame:
    """projected() of groups of any size, whose sizes are in _n: project()'s method in parts of about `most` points, by lot of their keys.

    A part's task looks for its points' nearest ones in all parts, one after
    another; edges are told to the parts of both ends. A task moves its part's
    points for a few rounds, by all their edges and off others drawn from the
    whole group, whose places (16 bytes a point for two axes) it reads; then the
    parts' new places are stored. Every point takes part in all of it.
    """
    kinds, spark, names = dict(wide.dtypes), wide.sparkSession, [f"_by{at}" for at in range(len(by))]
    group = F.concat(F.lit("c"), F.hex(F.xxhash64(*by) if by else F.lit(0)))
    dealt = wide.withColumn("_parts", F.ceil(F.col("_n") / most).cast("int")).withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), key), F.col("_parts")).cast("int")).withColumn("_g", group)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        points = np.stack(pdf[vector].to_numpy()).astype("<f8")
        out = pdf[by].iloc[:1].set_axis(names, axis=1)
        return out.assign(g=pdf["_g"].iloc[0], part=pdf["_part"].iloc[0], parts=pdf["_parts"].iloc[0], n=pdf["_n"].iloc[0], width=points.shape[1], keys=[pdf[key].to_numpy()], v=[points.tobytes()], cell=f"{pdf['_g'].iloc[0]}_{pdf['_part'].iloc[0]}")

    schema = ", ".join([*(f"{a} {kinds[c]}" for a, c in zip(names, by, strict=True)), f"g string, part int, parts int, n long, width int, keys array<{kinds[key]}>, v binary, cell string"])
    given = _written(dealt.groupBy(*by, "_g", "_parts", "_part", "_n").applyInPandas(pack, schema), "cell")
    packed = spark.read.schema(schema).parquet(given)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                g, own, parts, width = r["g"], r["part"], r["parts"], r["width"]
                others = ((q, _part_of(given, f"{g}_{q}", "v", width)) for q in range(parts))
                part, place, apart = nearest_of_parts(_numbers(r["v"]).reshape(-1, width), own, others, min(neighbours, r["n"] - 1))
                i, part, place, w = np.repeat(np.arange(len(part)), part.shape[1]), part.ravel(), place.ravel(), sureness(apart).ravel()
                told = [_edges(f"{g}_{own}", parts, i, part, place, w)]
                for q in np.unique(part).tolist():
                    to = part == q
                    told.append(_edges(f"{g}_{q}", parts, place[to], np.full(to.sum(), own), i[to], w[to]))
                yield from pa.Table.from_pylist(told, pa.schema([("cell", pa.string()), ("parts", pa.int32()), *((c, pa.binary()) for c in ("i", "part", "j", "w"))])).to_batches()

    def united(table: pa.Table) -> pa.Table:
        """a + b - a b of an edge that both ends told, as in edge_weights()."""
        rows = table.to_pylist()
        i, part, j = (np.concatenate([np.frombuffer(r[c], "<i4") for r in rows]) for c in ("i", "part", "j"))
        w = np.concatenate([_numbers(r["w"]) for r in rows])
        order = np.lexsort((w, j, part, i))
        i, part, j, w = i[order], part[order], j[order], w[order]
        first = np.flatnonzero(np.append(True, (np.diff(i) != 0) | (np.diff(part) != 0) | (np.diff(j) != 0)))
        w = 1 - np.multiply.reduceat(1 - w, first)
        keep = w >= 1 / rounds
        return pa.Table.from_pylist([_edges(rows[0]["cell"], rows[0]["parts"], i[first][keep], part[first][keep], j[first][keep], w[keep])], table.schema)

    total = packed.count()  # a row for each part
    edges = checkpointed(packed.mapInArrow(near, _EDGES).groupBy("cell").applyInArrow(united, _EDGES).repartition(total, "cell"))

    # the start: main axes by sums, of which a group has one row for each part
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = _numbers(r["v"]).reshape(-1, r["width"])
                yield pa.RecordBatch.from_arrays([pa.array([r["g"]]), pa.array([len(v)]), pa.array([v.sum(axis=0).tolist()]), pa.array([(v.T @ v).ravel().tolist()])], names=["g", "n", "total", "products"])

    def directions(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "total"], key=lambda c: c if c.name == "n" else c.map(lambda x: x[0]))
        mean, products = np.stack(pdf["total"].to_numpy()).sum(axis=0) / pdf["n"].sum(), np.stack(pdf["products"].to_numpy()).sum(axis=0)
        main = main_directions(products.reshape(len(mean), -1) - pdf["n"].sum() * np.outer(mean, mean), axes)
        return pd.DataFrame({"g": pdf["g"].iloc[:1].to_numpy(), "mean": [mean], "main": [main.ravel()]})

    main = packed.mapInArrow(sums, "g string, n long, total array<double>, products array<double>").groupBy("g").applyInPandas(directions, "g string, mean array<double>, main array<double>")

    def first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                place = (_numbers(r["v"]).reshape(-1, r["width"]) - np.array(r["mean"])) @ np.array(r["main"]).reshape(-1, axes)
                yield pa.RecordBatch.from_arrays([pa.array([r["cell"]]), pa.array([r["g"]]), pa.array([place.tobytes()], pa.binary()), pa.array([float(np.abs(place).max())])], names=["cell", "g", "place", "most"])

    plain = checkpointed(packed.select("cell", "g", "width", "v").join(main, "g").mapInArrow(first_places, "cell string, g string, place binary, most double"))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                place = _numbers(r["place"]).reshape(-1, axes)
                place = 10 * place / max(r["_most"], 1e-9) + np.random.default_rng([seed, zlib.crc32(r["cell"].encode())]).normal(0, 1e-4, place.shape)
                yield pa.RecordBatch.from_arrays([pa.array([r["cell"]]), pa.array([place.tobytes()], pa.binary())], names=["cell", "place"])

    places = _written(plain.join(plain.groupBy("g").agg(F.max("most").alias("_most")), "g").mapInArrow(scaled, "cell string, place binary"), "cell")

    def moved(before: str, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    g, own = r["cell"].rsplit("_", 1)
                    held = [_part_of(before, f"{g}_{q}", "place", axes) for q in range(r["parts"])]
                    offsets = np.cumsum([0, *(len(x) for x in held)])
                    place, low, high = np.concatenate(held), offsets[int(own)], offsets[int(own) + 1]
                    i, part, j = (np.frombuffer(r[c], "<i4").astype(np.int64) for c in ("i", "part", "j"))
                    i, j, w = i + low, offsets[part] + j, _numbers(r["w"])
                    rng = np.random.default_rng([seed, zlib.crc32(r["cell"].encode()), turn])
                    for now in range(turn, min(turn + turns, rounds)):
                        due = np.floor((now + 1) * w) > np.floor(now * w)
                        a, b, move = i[due], j[due], np.zeros((high - low, axes))
                        np.add.at(move, a - low, pulls(place[a] - place[b]))
                        for _ in range(5):
                            other = rng.integers(0, len(place), len(a))
                            push = pushes(place[a] - place[other])
                            push[other == a] = 0
                            np.add.at(move, a - low, push)
                        place[low:high] += (1 - now / rounds) * np.clip(move, -4, 4)
                    yield pa.RecordBatch.from_arrays([pa.array([r["cell"]]), pa.array([place[low:high].tobytes()], pa.binary())], names=["cell", "place"])

        return run

    for turn in range(0, rounds, turns):
        places, before = _written(edges.mapInArrow(moved(places, turn), "cell string, place binary"), "cell"), places
        _dropped(before)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, cell in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                place = _part_of(places, cell, "place", axes)
                laid = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1) * axes, pa.int32()), pa.array(place.ravel()))
                rows = batch.slice(at, 1)
                same = pa.array(np.zeros(len(place), np.int64))
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(same) for c in range(len(by))), rows.column(len(by)).flatten(), laid], names=[*by, key, "projected"])

    return packed.select(*names, "keys", "cell").mapInArrow(listed, ", ".join(f"{c} {kinds[c]}" for c in [*by, key]) + ", projected array<double>")


def projected(points: DataFrame, by: list[str], key: str, vector: str, axes: int = AXES, neighbours: int = NEIGHBOURS, most: int = MOST_POINTS) -> DataFrame:
    """by, key, projected (array of axes numbers): each group's vectors laid out by their neighbour graph.

    A layout of at most `most` points is a single task's work; a larger group is
    laid out whole too, in parts (whole_layout). Rows go by key within a group or
    part, so the result does not depend on how they lie. A group of few points
    keeps its vectors' first axes.
    """
    kinds = dict(points.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, key])
    points = points.select(*by, key, vector)
    sizes = points.groupBy(*by).agg(F.count("*").alias("_n"))
    large = checkpointed(sizes.where(F.col("_n") > most))
    same = lambda rows: reduce(lambda a, b: a & b, [rows[c].eqNullSafe(large[c]) for c in by], F.lit(True))
    small = points.join(large, same(points), "left_anti")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        out = pdf[[*by, key]].copy()
        out["projected"] = list(project(np.stack(pdf[vector].to_numpy()).astype(np.float64), axes, neighbours))
        return out

    out = small.groupBy(*by).applyInPandas(run, f"{schema}, projected array<double>")
    if large.isEmpty():
        return out
    wide = points.join(large, same(points)).select(*[points[c] for c in [*by, key, vector]], "_n")
    return out.unionByName(whole_layout(wide, by, key, vector, axes, neighbours, most))


def trustworthiness(before: np.ndarray, after: np.ndarray, k: int = 10) -> float:
    """How far the k nearest of the layout are near in the vectors too: 1 where all are among the k nearest there."""
    n = len(before)
    order = nearest(before, n - 1)[0]
    rank = np.empty((n, n), np.int64)
    rank[np.arange(n)[:, None], order] = np.arange(1, n)
    squares = ((after[:, None] - after[None]) ** 2).sum(axis=2)
    np.fill_diagonal(squares, np.inf)
    near = np.argsort(squares, axis=1, kind="stable")[:, :k]
    late = np.maximum(np.take_along_axis(rank, near, axis=1) - k, 0).sum()
    return float(1 - late * 2 / (n * k * (2 * n - 3 * k - 1)))
