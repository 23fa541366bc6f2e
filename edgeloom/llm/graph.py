"""Connected components by alternating large-star and small-star (Kiveris et al., 2014).

Edges are pairs of integers in a stored table. Large-star links each larger neighbour of a vertex to the smallest
vertex of its neighbourhood; small-star does so for the vertex and its smaller neighbours. When neither changes the
edges, each component is a star around its smallest vertex. Minima are partial aggregates, and the vertices with
very many edges (the centres of the stars) are broadcast, so no task gets the edges of a hot vertex. Tables of up to
SMALL edges (a few MB) are taken by one task, without shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, stored

#: Edges that one task takes.
SMALL = 200_000


def _state(edges: DataFrame) -> tuple:
    """Count and order-free sums of hashes: equal exactly (but for 2^-64) if the edges are equal."""
    wide = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(wide), F.bit_xor(F.xxhash64("v", "u"))).first())


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """One step on edges (u, v), u < v."""
    pair = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    if large:  # each vertex and all of its neighbours
        both = edges.select(F.explode(F.array(F.struct("u", "v"), pair)).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        low = low.select("u", F.least("m", "u").alias("m"), "n")
        out = _joined(both.where("v > u"), low, 2 * total).select(F.col("m").alias("u"), "v")
    else:  # each vertex and its smaller neighbours
        down = edges.select(pair.alias("e")).select("e.*")
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        out = _joined(down, low, total).select(F.col("m").alias("u"), "v").unionByName(low.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return _together(out.where("u < v"), total).distinct()


def _joined(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    return edges.join(low, "u") if total <= 2 * SMALL else join_groups(edges, low, ["u"], "n", total)


def _together(edges: DataFrame, total: int) -> DataFrame:
    """Few edges in one partition: then no step on them needs a shuffle."""
    return edges.coalesce(1) if total <= SMALL else edges


def components(links: DataFrame) -> DataFrame:
    """(id, root) of each vertex of links (a, b), which are counted and read; root is the smallest vertex of its
    component, with itself."""
    total = links.count()
    edges = _together(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v"), total).distinct()
    edges = stored(edges, "edges", None if total <= SMALL else total)
    state = _state(edges)
    while state[0]:
        large = _star(_together(edges, state[0]), state[0], True)
        if state[0] > SMALL:
            large = stored(large, "large-star", state[0])
        edges = stored(_star(large, state[0], False), "small-star", None if state[0] <= SMALL else 2 * state[0])
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
