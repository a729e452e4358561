"""Connected components of a graph held as a DataFrame of edges.

Rounds of large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014) turn the edges into stars around
each component's smallest vertex.  A vertex's neighbours are never gathered:
each step takes minima, which aggregate before the shuffle, and joins them to
the edges, where Spark can split a hot vertex.  Each round is written to the
shared folder.  A graph of at most ``FEW`` edges, which are counted, is solved
by one task instead; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise

FEW = 10_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v: link neighbours to the smallest one around them."""
    if large:
        around = edges.select(F.col("u").alias("c"), F.col("v").alias("n")).unionByName(edges.select(F.col("v").alias("c"), F.col("u").alias("n")))
        least = around.groupBy("c").agg(F.min("n").alias("m")).select(F.col("c").alias("k"), F.least("c", "m").alias("m"))
        moved = around.join(least, F.col("c") == F.col("k")).filter("n > c")
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        moved = edges.join(least, F.col("u") == F.col("k")).select("v", "m", F.col("u").alias("n"))
        moved = moved.select("n", "m").unionByName(moved.select(F.col("v").alias("n"), "m"))
    return moved.filter("n > m").select(F.col("n").alias("u"), F.col("m").alias("v")).distinct()


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v): the stars of all edges of the batches."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    stars = [(x, find(x)) for x in root if find(x) != x]
    yield pd.DataFrame(stars, columns=["u", "v"], dtype="int64")


def _components(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def connected_components(edges: DataFrame, rounds: int = 50, few: int = FEW) -> DataFrame:
    """(id, component) of each vertex of the edges (a, b).

    ``component`` is the smallest id reachable.  Edges may repeat, in either
    direction, and loops are ignored; a vertex with loops only has no row.  It
    stops when a round changes nothing, and fails after ``rounds``.
    """
    current = materialise(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "component-edges"
    )
    if current.count() <= few:
        return _components(materialise(current.coalesce(1).mapInPandas(_solved, "u long, v long"), "component-edges"))
    mark = None
    for _ in range(rounds):
        # In stars, no smaller end of an edge is the larger end of another, and each larger end has one edge.
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            return _components(current)
        mark = tuple(state)
        current = materialise(_star(_star(current, True), False), "component-edges")
    raise RuntimeError(f"components have not settled after {rounds} rounds")
