"""The similarity graph by cells instead of pairs.

A cell is one (length, position, value) of the attribute arrays; keys are
neighbours when they share a cell. Pairs grow with the square of a cell's
keys; the (key, cell) table grows with the records. Everything that needs only
sums over a vertex's neighbours, or which keys are connected, is computed
from cells here:

* vertices and connected components: same as those of the bipartite
  (key, cell) graph;
* strength, total weight and seed probability: when every key has one
  record, weight(a, b) = shared cells / length, so a sum over neighbours is
  a sum over the vertex's cells of the cell's total less the vertex's own
  share.

Sums need one record per key: with several, the edge takes the maximum over their
pairs and cells would add up. ``similarity_cells`` counts a key's records, and sums
over a key of several fail; ``record_strength`` sums up any data, by pairs where
such a key takes part and by cells elsewhere. Vertices and components are right
for any data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklens import defaults as D
from risklens.operators.graph.build import similarity_edges, similarity_records
from risklens.operators.graph.components import connected_components
from risklens.session import cut_lineage, release

# Cells take vertex ids from here on, above every key, so that a component's
# smallest id is a key.
CELL_IDS = 1 << 62


def _cells_of(rec: DataFrame) -> DataFrame:
    return (rec.select("k", "len", "records", F.posexplode("rec").alias("pos", "value"))
            .where(F.col("value") != "")
            .select("k", "len", (F.pmod(F.xxhash64("len", "pos", "value"), F.lit(CELL_IDS)) + F.lit(CELL_IDS)).alias("cell"), "records")
            .distinct())


def similarity_cells(df: DataFrame, key: str, attrs: list[str], compat: bool = False) -> DataFrame:
    """``(k, len, cell, records)`` of every distinct record; cells of empty values are
    left out. A cell is named by a 64-bit hash moved above ``CELL_IDS``;
    ``records``: number of different records of the key."""
    rec = similarity_records(df, key, attrs, compat)
    return _cells_of(rec.withColumn("records", F.count("*").over(Window.partitionBy("k"))))


def shared_cells(cells: DataFrame) -> DataFrame:
    """``(k, len, cell, n, records)``: the cells held by ``n > 1`` keys."""
    held = cells.groupBy("cell").agg(F.count_distinct("k").alias("n")).where(F.col("n") > 1)
    return cells.join(held, on="cell").select("k", "len", "cell", "n", "records")


def one_record(column: str = "k") -> Column:
    """``column`` of cells, for sums: a key of several records is an error."""
    wrong = F.raise_error(F.concat(F.lit("several records of key "), F.col("k").cast("string")))
    return F.when(F.col("records") == 1, F.col(column)).otherwise(wrong.cast("long")).alias(column)


def cell_vertices(shared: DataFrame) -> DataFrame:
    """GR3: the similarity graph's vertices."""
    return shared.select(F.col("k").alias("id")).distinct()


def cell_components(shared: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """GR12 over the (key, cell) graph -> ``(id, component)`` of keys."""
    edges = shared.select(F.col("k").alias("src"), F.col("cell").alias("dst"))
    return connected_components(edges, vertices=vertices).where(F.col("id") < CELL_IDS)


def cell_strength(shared: DataFrame) -> DataFrame:
    """GR7 for one record per key. Every pair stands in the graph in both
    directions, so each neighbour counts twice."""
    return (shared.select(one_record(), "n", "len").groupBy(F.col("k").alias("id"))
            .agg(F.sum(2 * (F.col("n") - 1) / F.col("len")).alias("degree")))


def record_strength(df: DataFrame, key: str, attrs: list[str], compat: bool = False) -> DataFrame:
    """GR7 for any number of records per key -> ``(id, degree)``.

    A pair with a key of several records takes part with the maximum over their
    pairs of records; these pairs are formed, from that key's side alone. All
    other pairs are summed up by cells."""
    rec = cut_lineage(similarity_records(df, key, attrs, compat))
    several = cut_lineage(rec.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"))
    single = rec.join(several, on="k", how="left_anti").withColumn("records", F.lit(1))
    pairs = cut_lineage(similarity_edges(df, key, attrs, compat, sources=several))
    back = pairs.join(several.withColumnRenamed("k", "dst"), on="dst", how="left_anti")
    # each pair stands in the graph in both directions
    parts = (cell_strength(shared_cells(_cells_of(single)))
             .unionByName(pairs.select(F.col("src").alias("id"), (2 * F.col("weight")).alias("degree")))
             .unionByName(back.select(F.col("dst").alias("id"), (2 * F.col("weight")).alias("degree"))))
    return parts.groupBy("id").agg(F.sum("degree").alias("degree"))


def cell_total_weight(shared: DataFrame) -> DataFrame:
    """AG18 for one record per key: sum over both directions of every pair."""
    return shared.select(one_record("n"), "len").agg(F.sum((F.col("n") - 1) / F.col("len")).alias("total_weight"))


def cell_seed_probability(shared: DataFrame, vertices: DataFrame,
                          max_steps: int = D.LABEL_PROPAGATION_STEPS) -> DataFrame:
    """``seed_probability`` for one record per key -> ``(id, prob)``.

    Per round and cell: the number of pure seeds and the sum of the other
    probabilities; a vertex takes both from its cells, less its own share.
    Counting pure seeds apart keeps a vertex among pure seeds at exactly 1.0,
    which clamps it from then on. ``vertices(id, is_seed)``.
    """
    if max_steps <= 0:
        raise ValueError("max_steps must be > 0")
    shared = cut_lineage(shared.select(one_record(), "cell", "n"))
    p = cut_lineage(vertices.select(
        F.col("id").alias("k"), F.when(F.col("is_seed"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("prob")))
    pure = F.col("prob") == 1.0
    for step in range(max_steps):
        held = shared.join(p, on="k")
        sums = held.groupBy("cell").agg(F.count_if(pure).alias("ones"),
                                        F.sum(F.when(pure, 0.0).otherwise(F.col("prob"))).alias("part"))
        # the others' probabilities; their weights (shared cells / len) have one denominator per vertex
        new = (held.where(~pure).join(sums, on="cell")
               .groupBy("k").agg(((F.sum("ones") + F.sum(F.greatest(F.col("part") - F.col("prob"), F.lit(0.0))))
                                  / F.sum(F.col("n") - 1)).alias("next")))
        nxt = p.join(new, on="k", how="left").select("k", F.coalesce("next", "prob").alias("prob"))
        if step == max_steps - 1:
            return nxt.select(F.col("k").alias("id"), "prob")
        nxt = cut_lineage(nxt)
        release(p)
        p = nxt
    return p.select(F.col("k").alias("id"), "prob")
