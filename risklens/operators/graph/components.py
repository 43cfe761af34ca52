"""GR12: connected components, labelled by the smallest vertex id, by contraction.

Each round every vertex points at the smallest id among itself and its
neighbours, then at what that one points at; edges are replaced by those
between the pointed-at vertices, without loops and repeats, until none is left.
Pointers stay inside a component and never rise, and replacing both ends of all
edges by pointers keeps connected what was connected, so the last vertex left
of a component is its smallest. The edge table shrinks from round to round;
pointers of each round are kept, and at the end they are followed from the last
round back to the first, again over tables that shrink geometrically.

A vertex's smallest neighbour is a grouped minimum, combined map-side. Joins on
a pointer or an edge's end, which for the hub of a star are most of all rows,
are spread (``spread_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens.operators.graph.blocks import Blocks, block_least, block_pairs
from risklens.operators.joins import PLAIN_ROWS, spread_join
from risklens.session import cut_lineage, release


def _edges(df: DataFrame) -> DataFrame:
    """Each undirected edge once, ``u > v``, without loops."""
    return (df.where(F.col("src") != F.col("dst"))
            .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())


def pointers(edges: DataFrame) -> DataFrame:
    """``id, to`` of every vertex of ``edges(u, v)``: two steps along smallest neighbours."""
    least = cut_lineage(
        edges.select(F.col("u").alias("id"), "v").unionByName(edges.select(F.col("v").alias("id"), "v"))
        .groupBy("id").agg(F.min("v").alias("to")))
    out = _two_steps(least)
    release(least)
    return out


def _two_steps(least: DataFrame) -> DataFrame:
    # a smallest neighbour is a vertex too, so it has a row
    on = least.select(F.col("id").alias("to"), F.col("to").alias("next"))
    return cut_lineage(spread_join(least, on, "to").select("id", F.col("next").alias("to")))


def contracted(edges: DataFrame, to: DataFrame, rows: int) -> DataFrame:
    """The edges, ``rows`` before, between the vertices that the ends of ``edges(u, v)`` point at."""
    first = spread_join(edges, to.select(F.col("id").alias("u"), F.col("to").alias("src")), "u", rows=rows).select("src", "v")
    if rows > PLAIN_ROWS:
        first = cut_lineage(first)
    return _edges(spread_join(first, to.select(F.col("id").alias("v"), F.col("to").alias("dst")), "v", rows=rows))


def packed_components(blocks: Blocks, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of the subgraph between ``vertices(id)``, the first round by
    blocks of packed ends; and ``(id, least, ends)`` of it (``block_least``)."""
    near = cut_lineage(block_least(blocks, vertices.select("id").distinct()))
    to = _two_steps(near.select("id", F.least("id", "least").alias("to")))
    pairs = block_pairs(blocks, to)
    if blocks.hubs is not None:
        pairs = pairs.unionByName(contracted(blocks.hubs.select(F.col("id").alias("u"), F.col("nbr").alias("v")), to, blocks.hub_ends))
    return _components(cut_lineage(pairs.distinct()), [to], vertices), near


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """``(id, component)`` for every endpoint of ``edges`` (and every row of
    ``vertices``, isolated ones forming their own component)."""
    return _components(cut_lineage(_edges(edges)), [], vertices, max_rounds)


def _components(left: DataFrame, rounds: list[DataFrame], vertices: DataFrame | None, max_rounds: int = 1000) -> DataFrame:
    """Rounds on the edges ``left`` after ``rounds`` of pointers, then labels."""
    while n := left.count():
        if len(rounds) == max_rounds:
            raise RuntimeError("connected components did not converge")
        rounds.append(pointers(left))
        fewer = cut_lineage(contracted(left, rounds[-1], n))
        release(left)
        left = fewer
    release(left)
    labels = left.sparkSession.createDataFrame([], "id long, component long")
    for i, to in enumerate(reversed(rounds)):
        if i == 0:
            labels = to.select("id", F.col("to").alias("component"))
            continue
        # a vertex that is pointed at but has no edges any more is the last of its component
        final = labels.select(F.col("id").alias("to"), "component")
        followed = cut_lineage(spread_join(to, final, "to", "left").select("id", F.coalesce("component", "to").alias("component")))
        release(labels)
        release(to)
        labels = followed
    if vertices is None:
        return labels
    alone = vertices.select("id").distinct().join(labels, on="id", how="left_anti")
    return labels.unionByName(alone.select("id", F.col("id").alias("component")))
