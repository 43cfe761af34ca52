"""GR5 / GR6: label propagation, plain and probabilistic with clamped seeds.

Both are synchronous: every round, each directed edge sends the state of
each endpoint to the other endpoint, so parallel edges and both stored
directions add up. Rounds run exactly ``max_steps`` times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens import defaults as D
from risklens.operators.graph.blocks import Blocks, block_means, packed_graph
from risklens.operators.graph.build import SEED_LABEL, graph_vertices
from risklens.operators.joins import spread_join
from risklens.session import cut_lineage, release


def _both_ways(edges: DataFrame) -> DataFrame:
    """(target, source, weight): both endpoints of every directed edge, with
    parallel edges (including the two stored directions of one pair) summed
    once here, since every message is linear in the edge weight."""
    e = edges.select("src", "dst", "weight")
    return (e.select(F.col("src").alias("target"), F.col("dst").alias("source"), "weight")
            .unionByName(e.select(F.col("dst").alias("target"), F.col("src").alias("source"),
                                  "weight"))
            .groupBy("target", "source").agg(F.sum("weight").alias("weight")))


def label_propagation(edges: DataFrame, vertices: DataFrame | None = None,
                      max_steps: int = D.LABEL_PROPAGATION_STEPS) -> DataFrame:
    """GR5: each vertex takes the label with the largest summed incident
    weight (smallest label on ties); vertices without messages keep theirs.

    ``vertices(id, label)`` gives initial labels; default label = id.
    The argmax is a ``max`` over ``(weight, -label)`` structs, so a vertex
    of huge degree is reduced map-side, never gathered in one task.
    """
    if max_steps <= 0:
        raise ValueError("max_steps must be > 0")
    msgs_edges = cut_lineage(_both_ways(edges))
    if vertices is None:
        labels = graph_vertices(edges).withColumn("label", F.col("id"))
    else:
        labels = vertices.select("id", "label")
    labels = cut_lineage(labels)
    for step in range(max_steps):
        votes = (msgs_edges.join(labels.withColumnRenamed("id", "source"), on="source")
                 .groupBy("target", "label").agg(F.sum("weight").alias("w")))
        best = (votes.groupBy(F.col("target").alias("id"))
                .agg(F.max(F.struct(F.col("w"), (-F.col("label")).alias("neg"))).alias("b"))
                .select("id", (-F.col("b.neg")).alias("new_label")))
        nxt = (labels.join(best, on="id", how="left")
               .select("id", F.coalesce("new_label", "label").alias("label")))
        if step == max_steps - 1:
            return nxt  # the caller's single use needs no table
        nxt = cut_lineage(nxt)
        release(labels)
        labels = nxt
    return labels


def bm_label_propagation(edges: DataFrame, vertices: DataFrame,
                         max_steps: int = D.LABEL_PROPAGATION_STEPS,
                         seed_label: int = SEED_LABEL) -> DataFrame:
    """GR6: label distributions ``(id, label, prob)``.

    Start: ``{label(v): 1.0}`` from ``vertices(id, label)``. Each round
    ``S(v, l) = sum w * P(u, l)`` over incident edges and
    ``P'(v, l) = S(v, l) / sum_l S(v, l)`` (one normalisation). A vertex whose
    seed-label probability is exactly 1.0 keeps its distribution (clamped),
    as does a vertex without messages. Whole distributions are kept.
    """
    if max_steps <= 0:
        raise ValueError("max_steps must be > 0")
    msgs_edges = cut_lineage(_both_ways(edges))
    start = vertices.select("id", "label", F.lit(1.0).alias("prob"))
    # Vertices without edges never receive a message: they keep their
    # start row and need not travel through the rounds.
    ends = msgs_edges.select(F.col("target").alias("id")).distinct()
    isolated = start.join(ends, on="id", how="left_anti")
    dist = cut_lineage(start.join(ends, on="id", how="left_semi"))
    for step in range(max_steps):
        clamped = (dist.where((F.col("label") == seed_label) & (F.col("prob") == 1.0))
                   .select("id").distinct())
        # messages to clamped vertices would be discarded: drop them first
        live = msgs_edges.join(clamped.withColumnRenamed("id", "target"), on="target",
                               how="left_anti")
        contrib = (live.join(dist.withColumnRenamed("id", "source"), on="source")
                   .groupBy(F.col("target").alias("id"), "label")
                   .agg(F.sum(F.col("weight") * F.col("prob")).alias("s")))
        total = contrib.groupBy("id").agg(F.sum("s").alias("z"))
        new = (contrib.join(total, on="id")
               .select("id", "label", (F.col("s") / F.col("z")).alias("prob")))
        kept = dist.join(clamped, on="id", how="left_semi")
        nxt = kept.unionByName(new)
        if step == max_steps - 1:
            return nxt.unionByName(isolated)
        nxt = cut_lineage(nxt)
        release(dist)
        dist = nxt
    return dist.unionByName(isolated)


def _means(held: DataFrame) -> DataFrame:
    """``(id, s, z)``: sums of weight x prob and of weight."""
    return held.groupBy("id").agg(F.sum(F.col("weight") * F.col("prob")).alias("s"), F.sum("weight").alias("z"))


def seed_probability(edges: DataFrame, vertices: DataFrame,
                     max_steps: int = D.LABEL_PROPAGATION_STEPS, blocks: Blocks | None = None) -> DataFrame:
    """The seed-label probability of ``bm_label_propagation`` without the
    rest of each distribution -> ``(id, prob)``.

    Every distribution sums to one, so the normaliser of a receiving vertex
    is its strength and ``P'(v, seed) = sum w * P(u, seed) / sum w`` -- one
    number per vertex and round instead of a whole distribution. Both sums
    come from the same aggregate over the same rows, so a vertex whose
    neighbours are all pure seeds gets exactly 1.0 and is clamped from then
    on, as in the full propagation. Equal to the full form up to floating-point rounding. ``vertices(id, is_seed)``.

    Rounds over a large edge table go by ``blocks`` of packed ends, which are made
    here unless they are given.
    """
    if max_steps <= 0:
        raise ValueError("max_steps must be > 0")
    p = cut_lineage(vertices.select(
        "id", F.when(F.col("is_seed"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("prob")))
    if blocks is None:
        blocks = packed_graph(edges)
    if blocks is not None and not p.groupBy("id").count().where("id is not null and count > 1").isEmpty():
        blocks = None  # a block sends one value a vertex
    w2 = cut_lineage(_both_ways(edges)) if blocks is None else None
    for step in range(max_steps):
        if blocks is None:
            agg = _means(w2.join(p.withColumnRenamed("id", "source"), on="source").withColumnRenamed("target", "id"))
        else:
            agg = block_means(blocks, p)
            if blocks.hubs is not None:
                agg = agg.unionByName(_means(spread_join(blocks.hubs, p.withColumnRenamed("id", "nbr"), "nbr", rows=blocks.hub_ends)))
        nxt = (p.join(agg, on="id", how="left")
               .select("id", F.when((F.col("prob") == 1.0) | F.col("z").isNull(), F.col("prob"))
                       .otherwise(F.col("s") / F.col("z")).alias("prob")))
        if step == max_steps - 1:
            return nxt
        nxt = cut_lineage(nxt)
        release(p)
        p = nxt
    return p
