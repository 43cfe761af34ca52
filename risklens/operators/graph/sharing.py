"""What keys share, by sets of cells (see ``cells``), for graphs of one record per key.

A key's record has a cell in a few positions only, so it has few sets of cells:
2^positions - 1 non-empty ones. Two keys share s cells when some set of s cells is
a subset of both and none larger is. Grouping keys by such sets therefore
answers questions about pairs without forming any:

* the best neighbour of a key is the best one in its largest set that others have;
* the pairs that share at least one cell are, by inclusion and exclusion, the
  pairs within all sets of one cell, less those within sets of two, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most cells of one key; with more, sets of cells are no way to avoid pairs.
MOST_CELLS = 12


def cell_sets(cells: DataFrame) -> DataFrame:
    """``(k, size, cells_id)``: all non-empty sets of a key's cells, of ``cells(k, cell)``.
    A set is named by a 64-bit hash. Raises for a key of more than ``MOST_CELLS``."""
    own = cells.groupBy("k").agg(F.sort_array(F.collect_set("cell")).alias("own"))
    few = F.when(F.size("own") <= MOST_CELLS, F.col("own")).otherwise(
        F.raise_error(F.lit(f"a key has more than {MOST_CELLS} cells")))
    masks = F.explode(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(few)) - 1))
    subset = F.filter("own", lambda c, i: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    return (own.select("k", "own", masks.alias("mask"))
            .select("k", F.bit_count("mask").alias("size"), F.xxhash64(subset).alias("cells_id")))


def sharing_pairs(cells: DataFrame) -> DataFrame:
    """``(k, pairs)``: for each set of cells that several keys have, one of them, and
    the number of ordered pairs in it with the sign of its size. Summed over a
    group of keys that holds all sharers of its cells, that is the number of
    ordered pairs of its keys that share a cell."""
    n = F.col("n")
    sign = F.when(F.col("size") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
    return (cell_sets(cells).groupBy("size", "cells_id").agg(F.count("*").alias("n"), F.min("k").alias("k"))
            .where(n > 1).select("k", (sign * n * (n - 1)).alias("pairs")))


def cell_density(cells: DataFrame, components: DataFrame) -> DataFrame:
    """GR15 without pairs: per component of ``components(id, component)``,
    vertices, stored edges (both directions of every pair) and edges per vertex.
    ``cells(k, cell)``: the cells of the keys in question, which lie in one
    component with all other keys of the cell."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n_vertices"))
    edges = (sharing_pairs(cells).groupBy("k").agg(F.sum("pairs").alias("pairs"))
             .join(components.select(F.col("id").alias("k"), "component"), on="k")
             .groupBy("component").agg(F.sum("pairs").alias("n_edges")))
    return (sizes.join(edges, on="component", how="left")
            .select("component", "n_vertices", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
            .withColumn("density", F.col("n_edges") / F.col("n_vertices")))
