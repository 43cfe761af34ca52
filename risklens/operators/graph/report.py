"""Fraud community report (GR14, GR15, AG22, J12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens.operators.graph.build import SEED_LABEL
from risklens.operators.graph.blocks import Blocks
from risklens.operators.graph.components import connected_components, packed_components
from risklens.operators.graph.lpa import seed_probability
from risklens.session import cut_lineage


def vertex_verdict(dist: DataFrame, seed_label: int = SEED_LABEL) -> DataFrame:
    """Per vertex: the seed label with its probability when that is
    positive, else the most probable label (smallest label on ties).
    One aggregate, combined map-side."""
    v = dist.groupBy("id").agg(
        F.max(F.struct("prob", (-F.col("label")).alias("neg"))).alias("b"),
        F.max(F.when(F.col("label") == seed_label, F.col("prob"))).alias("sp"))
    is_seed = F.coalesce(F.col("sp"), F.lit(0.0)) > 0
    return v.select("id",
                    F.when(is_seed, F.lit(seed_label)).otherwise(-F.col("b.neg")).alias("label"),
                    F.when(is_seed, F.col("sp")).otherwise(F.col("b.prob")).alias("prob"))


def grey_list(dist: DataFrame, seed_label: int = SEED_LABEL) -> DataFrame:
    """GR14: vertices whose verdict is the seed label -> ``(id, prob)``."""
    v = vertex_verdict(dist, seed_label)
    return v.where(F.col("label") == seed_label).select("id", "prob")


def grey_list_from_seeds(edges: DataFrame, labels: DataFrame, max_steps: int, blocks: Blocks | None = None) -> DataFrame:
    """GR14 grey list straight from seeds: vertices whose seed probability
    after ``max_steps`` rounds of seeded propagation is positive."""
    p = seed_probability(edges, labels.select("id", "is_seed"), max_steps, blocks)
    return p.where(F.col("prob") > 0)


def grey_subgraph(grey: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends on the grey list (two semi joins)."""
    ids = grey.select("id")
    return (edges.join(ids.withColumnRenamed("id", "src"), on="src", how="left_semi")
            .join(ids.withColumnRenamed("id", "dst"), on="dst", how="left_semi")
            .select("src", "dst", "weight"))


def community_density(edges: DataFrame, components: DataFrame) -> DataFrame:
    """GR15: per component, vertices, stored edges and edges per vertex."""
    return _density(components, edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")))


def _density(components: DataFrame, counts: DataFrame) -> DataFrame:
    """``community_density`` from numbers of edges a vertex, ``counts(id, n)``."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n_vertices"))
    ecount = (counts.join(components.select("id", "component"), on="id")
              .groupBy("component").agg(F.sum("n").alias("n_edges")))
    return (sizes.join(ecount, on="component", how="left")
            .select("component", "n_vertices",
                    F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
            .withColumn("density", F.col("n_edges") / F.col("n_vertices")))


def fraud_groups(grey: DataFrame, edges: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """GR14: connected groups of the grey subgraph with size and density;
    returns ``(id, component)`` membership and the per-group table.
    ``blocks``: the packed ends of ``edges``, if there are many."""
    grey = cut_lineage(grey.select("id"))  # used by both semi joins and as vertices
    if blocks is not None:
        cc, near = packed_components(blocks, grey)
        cc = cut_lineage(cc)
        per_group = _density(cc, near.select("id", F.col("ends").alias("n")))
        n_edges = (F.col("n_edges") / 2).cast("long")  # every edge has two ends
        return cc, (per_group.withColumn("n_edges", n_edges).withColumn("density", F.col("n_edges") / F.col("n_vertices")))
    sub = cut_lineage(grey_subgraph(grey, edges))
    cc = connected_components(sub, vertices=grey)
    return cc, community_density(sub, cc)


def fraud_summary(cc: DataFrame, counts: DataFrame) -> DataFrame:
    """AG22 / GR14 totals: groups, blacklist rows, seeded vertices, grey
    vertices and the seeded share of the grey list (one row)."""
    grey_n = cc.agg(F.count("*")).scalar()
    groups = cc.agg(F.count_distinct("component")).scalar()
    return counts.select(
        groups.alias("n_groups"), "black_num", "seeded", grey_n.alias("grey_num"),
        F.try_divide(F.col("seeded").cast("double"), grey_n).alias("seed_share"))


def fraud_members(records: DataFrame, key: str, attrs: list[str], cc: DataFrame) -> DataFrame:
    """J12: distinct (key, attributes, component) of grouped records."""
    k = F.col(key).cast("string").try_cast("bigint")
    return (records.select(k.alias("id"), *attrs)
            .join(cc, on="id").select(F.col("id").alias(key), *attrs, "component").distinct())
