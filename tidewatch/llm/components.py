"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import checkpointed, told_back

#: Edges that a task holds at once.
HELD_EDGES = 500_000


def least_reached(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches by edges u, v."""
    least = np.arange(n)
    while True:
        a, b = least[u], least[v]
        apart = a != b
        if not apart.any():
            return least
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := least[least], least):
            least = further


def _own_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (u, v) as stars that join the same nodes; no more edges than came, each node to a least one."""

    def stars(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        ends = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks]).combine_chunks().dictionary_encode()
        order = pa.compute.sort_indices(ends.dictionary)
        names, rank = ends.dictionary.take(order), np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        codes = rank[ends.indices.to_numpy()]
        least = least_reached(codes[: len(table)], codes[len(table) :], len(names))
        lower = np.flatnonzero(least != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(lower)), names.take(pa.array(least[lower]))], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD_EDGES:
            yield from stars(held)
            held = []
    if sum(b.num_rows for b in held):
        yield from stars(held)


def contracted(edges: DataFrame) -> DataFrame:
    """edges (u, v) with each task's own components made stars."""
    return edges.mapInArrow(_own_stars, edges.schema)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one lower neighbour at most, and none if it is one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    seen = ends.groupBy("node").agg(F.sum("as_u").alias("ups"), F.max("as_v").alias("centre"))
    return not seen.where("ups > 1 OR (ups = 1 AND centre = 1)").agg(F.count("*")).first()[0]


def with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least v of each u; a hub's edges are no single task's."""
    return told_back(edges, "u", ["v"], [F.min("v").alias("m")])


def connected(edges: DataFrame) -> DataFrame:
    """node, root of every node that edges (a, b) names; root is the least node it reaches.

    Each round hooks a node's larger neighbours to its least one, then its
    smaller ones; edges never grow in number and end as a star per component.
    Tasks first join what their own edges connect, which spares rounds, and with
    each round plans that the driver would keep. Null ends and loops are no edges.
    Every round is cut off by a checkpoint.
    """
    held = checkpointed(contracted(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct())
    while not _are_stars(held):
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least("u", "m")
        large = with_least(both).where("v > u").where(F.col("v") != least).select(F.col("v").alias("u"), least.alias("v"))
        # a node keeps its least neighbour, which its other smaller ones then take
        small = with_least(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        held = checkpointed(contracted(small).distinct())
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
