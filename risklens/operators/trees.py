"""Decision trees as tables (ML5-ML7): nodes as rows, rows routed by joins, and the
best split of a set found by sums over sorted values."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = ("node long, feature int, threshold double, left long, right long, prediction double, impurity double, gain double, "
         "n long, ones long, n_left long, n_right long")
#: Value ranges that the sorted values of a feature are cut into, so that no task sorts all of them.
CHUNKS = 64


def tree_nodes(spark: SparkSession, model) -> DataFrame:
    """A fitted tree with continuous splits and two classes, one row a node: root
    1, children 2i and 2i + 1 of node i; ``x[feature] <= threshold`` goes left;
    leaves have no feature. A tree has at most 2^(depth + 1) nodes."""
    def walk(java, node):
        stats = java.impurityStats().stats()
        inner = java.getClass().getSimpleName() == "InternalNode"
        count = lambda j: int(sum(j.impurityStats().stats()))
        row = (node, None, None, None, None, java.prediction(), java.impurity(), None, int(sum(stats)), int(stats[1]), None, None)
        if not inner:
            return [row]
        left, right, split = java.leftChild(), java.rightChild(), java.split()
        row = (node, split.featureIndex(), split.threshold(), 2 * node, 2 * node + 1, *row[5:7], java.gain(), *row[8:10], count(left), count(right))
        return [row, *walk(left, 2 * node), *walk(right, 2 * node + 1)]

    return spark.createDataFrame(walk(model._java_obj.rootNode(), 1), NODES)


def routed(points: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """``points`` (with ``x``, an array) and the ``leaf`` that each row ends in:
    one join with the node table, which is small, for every level."""
    at = points.withColumn("leaf", F.lit(1).cast("long"))
    step = F.broadcast(nodes.where(F.col("feature").isNotNull()).select(
        F.col("node").alias("leaf"), "feature", "threshold", "left", "right"))
    for _ in range(depth):
        value = F.get("x", F.coalesce("feature", F.lit(0)))
        down = F.when(F.col("feature").isNull(), F.col("leaf")).when(value <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = at.join(step, on="leaf", how="left").select(*points.columns, down.alias("leaf"))
    return at


def best_split(points: DataFrame) -> DataFrame:
    """``feature, threshold, gain, n_left, n_right`` (one row) of the cut between two
    neighbouring values that lowers the Gini impurity of ``label`` (0 or 1) most,
    over all features of ``x`` (ties: first feature, least threshold).

    Rows become counts by (feature, value); sums up to a value are those of the
    chunks before plus a window inside the value's chunk.
    """
    counts = (points.select(F.posexplode("x").alias("feature", "value"), "label")
              .groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum("label").alias("ones")))
    ends = counts.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                         F.sum("n").alias("all_n"), F.sum("ones").alias("all_ones"))
    share = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    chunk = F.coalesce(F.least(F.floor(share * CHUNKS), F.lit(CHUNKS - 1)), F.lit(0)).cast("int")
    placed = counts.join(F.broadcast(ends), on="feature").withColumn("chunk", chunk)
    before = Window.partitionBy("feature").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("feature").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    sums = (placed.groupBy("feature", "chunk").agg(F.sum("n").alias("c_n"), F.sum("ones").alias("c_ones"), F.min("value").alias("least"))
            .select("feature", "chunk", F.coalesce(F.sum("c_n").over(before), F.lit(0)).alias("n_before"),
                    F.coalesce(F.sum("c_ones").over(before), F.lit(0.0)).alias("ones_before"), F.min("least").over(after).alias("next_chunk")))
    inside = Window.partitionBy("feature", "chunk").orderBy("value")
    cut = (placed.join(F.broadcast(sums), on=["feature", "chunk"])
           .select("feature", "all_n", "all_ones",
                   ((F.col("value") + F.coalesce(F.lead("value").over(inside), "next_chunk")) / 2).alias("threshold"),
                   (F.col("n_before") + F.sum("n").over(inside)).alias("l"), (F.col("ones_before") + F.sum("ones").over(inside)).alias("l1"))
           .where(F.col("threshold").isNotNull()))

    def gini(ones, n):
        return 2 * (ones / n) * (1 - ones / n)

    n, ones, left, left1 = F.col("all_n"), F.col("all_ones"), F.col("l"), F.col("l1")
    gain = gini(ones, n) - left / n * gini(left1, left) - (n - left) / n * gini(ones - left1, n - left)
    best = F.max(F.struct(gain.alias("gain"), (-F.col("feature")).alias("minus_feature"), (-F.col("threshold")).alias("minus_threshold"),
                          left.alias("l"), n.alias("n")))
    return cut.agg(best.alias("b")).where(F.col("b").isNotNull()).select(
        (-F.col("b.minus_feature")).alias("feature"), (-F.col("b.minus_threshold")).alias("threshold"), F.col("b.gain").alias("gain"),
        F.col("b.l").alias("n_left"), (F.col("b.n") - F.col("b.l")).alias("n_right"))


def tree_checks(model, scored: DataFrame, least_rows: int) -> DataFrame:
    """``(item, ok)`` of a fitted tree and its training rows ``scored``
    (``indexedFeatures``, ``indexedLabel``, ``prediction``), from the rows routed
    through the table of nodes: every row's prediction is its leaf's; every
    leaf's counts are those of the rows that reach it; no leaf has fewer than
    ``least_rows``; a leaf predicts a class that most of its rows have."""
    nodes = tree_nodes(scored.sparkSession, model)
    rows = routed(scored.select(vector_to_array("indexedFeatures").alias("x"), "indexedLabel", "prediction"), nodes, model.depth)
    reached = rows.groupBy("leaf").agg(F.count("*").alias("got"), F.sum("indexedLabel").alias("got_ones"),
                                       F.min("prediction").alias("lo"), F.max("prediction").alias("hi"))
    leaves = nodes.where(F.col("feature").isNull()).join(reached, F.col("node") == F.col("leaf"), "left")
    own = F.when(F.col("prediction") == 1.0, F.col("ones")).otherwise(F.col("n") - F.col("ones"))
    checks = {"predictions": (F.col("lo") == F.col("prediction")) & (F.col("hi") == F.col("prediction")),
              "counts": (F.col("got") == F.col("n")) & (F.col("got_ones") == F.col("ones")),
              "least rows": F.col("got") >= least_rows, "majority": 2 * own >= F.col("n")}
    return (leaves.agg(F.array(*[F.struct(F.lit(k).alias("item"), F.bool_and(F.coalesce(c, F.lit(False))).alias("ok"))
                                 for k, c in checks.items()]).alias("c"))
            .select(F.explode("c").alias("c")).select("c.item", "c.ok"))
