"""GR5 / GR6 on the similarity graph by cells, without pairs.

For one record per key: weight(a, b) = shared cells / number of attributes, so
what reaches a vertex is, cell by cell, what the cell's keys send together less
its own part. Messages are cells x labels, fanned out once to the cell's keys,
instead of pairs x labels. A cell of many keys is summed map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens import defaults as D
from risklens.operators.graph.build import SEED_LABEL
from risklens.operators.graph.cells import cell_components, one_record
from risklens.operators.graph.groups import group_bm_label_propagation
from risklens.operators.graph.sharing import cell_sets
from risklens.operators.joins import shuffled, spread_join
from risklens.session import cut_lineage, release


def _votes_of_unique_labels(sets: DataFrame, labels: DataFrame, unique: DataFrame) -> DataFrame:
    """``(k, best)``: the largest vote that a label of a single vertex gets, with
    the negated label. Such a label's vote is the cells shared with its vertex:
    in each set of cells the smallest label but the key's own one counts."""
    held = sets.join(unique.select("k", "label"), on="k")
    least = held.groupBy("cells_id").agg(F.min("label").alias("least"))
    second = (held.join(least, on="cells_id").where(F.col("label") != F.col("least"))
              .groupBy("cells_id").agg(F.min("label").alias("second")))
    two = least.join(second, on="cells_id", how="left")
    own = labels.join(unique.select("label", F.lit(True).alias("unique")), on="label", how="left")
    other = F.when(F.col("unique") & (F.col("least") == F.col("label")), F.col("second")).otherwise(F.col("least"))
    return (sets.join(two, on="cells_id").join(own.select("k", "label", "unique"), on="k")
            .select("k", "size", other.alias("to")).where(F.col("to").isNotNull())
            .groupBy("k").agg(F.max(F.struct(F.col("size").cast("long").alias("votes"), (-F.col("to")).alias("neg"))).alias("best")))


def _votes_of_common_labels(shared: DataFrame, labels: DataFrame, common: DataFrame) -> DataFrame:
    """``(k, best)`` among labels that several vertices have, from counts by (cell, label)."""
    held = shared.join(labels.join(common, on="label", how="left_semi"), on="k")
    counts = held.groupBy("cell", "label").agg(F.count("*").alias("c"))
    own = held.groupBy("k", "label").agg(F.count("*").alias("own"))
    votes = shared.join(counts, on="cell").groupBy("k", "label").agg(F.sum("c").alias("c"))
    left = F.col("c") - F.coalesce("own", F.lit(0))
    return (votes.join(own, on=["k", "label"], how="left").select("k", left.alias("votes"), "label").where("votes > 0")
            .groupBy("k").agg(F.max(F.struct("votes", (-F.col("label")).alias("neg"))).alias("best")))


def cell_label_propagation(shared: DataFrame, labels: DataFrame | None = None,
                           max_steps: int = D.LABEL_PROPAGATION_STEPS) -> DataFrame:
    """GR5 -> ``(id, label)``: ``max_steps`` synchronous rounds in which every vertex
    takes the label of the largest summed weight, the smallest on ties.

    ``shared``: see ``shared_cells``; ``labels(id, label)``: start, by default the
    own id. Labels that one vertex alone has (in the first round usually all)
    vote through sets of cells; the others through sums by (cell, label).
    """
    if max_steps <= 0:
        raise ValueError("max_steps must be > 0")
    shared = cut_lineage(shared.select(one_record(), "cell"))
    sets = cell_sets(shared)
    several = sets.groupBy("cells_id").agg(F.count("*").alias("n")).where("n > 1").select("cells_id")
    sets = cut_lineage(sets.join(several, on="cells_id"))
    if labels is None:
        state = shared.select("k", F.col("k").alias("label")).distinct()
    else:
        state = labels.select(F.col("id").alias("k"), "label")
    state = cut_lineage(state)
    for step in range(max_steps):
        held = cut_lineage(state.groupBy("label").agg(F.count("*").alias("n"), F.min("k").alias("k")))
        kinds = held.agg(F.count_if(F.col("n") == 1).alias("unique"), F.count_if(F.col("n") > 1).alias("common")).first()
        votes = [_votes_of_unique_labels(sets, state, held.where("n = 1"))] if kinds["unique"] else []
        if kinds["common"]:
            votes.append(_votes_of_common_labels(shared, state, held.where("n > 1").select("label")))
        if not votes:
            break  # no vertices
        best = votes[0] if len(votes) == 1 else votes[0].unionByName(votes[1]).groupBy("k").agg(F.max("best").alias("best"))
        nxt = cut_lineage(state.join(best, on="k", how="left").select("k", F.coalesce(-F.col("best.neg"), "label").alias("label")))
        release(held)
        release(state)
        state = nxt
    release(shared)
    release(sets)
    return state.select(F.col("k").alias("id"), "label")


#: Keys of a connected group that one task may propagate by itself, and probabilities that a task makes, about.
GROUP_KEYS = 1_000
GROUP_ROWS = 2_000_000


def cell_bm_label_propagation(shared: DataFrame, vertices: DataFrame, max_steps: int = D.LABEL_PROPAGATION_STEPS,
                              seed_label: int = SEED_LABEL) -> DataFrame:
    """GR6 -> ``(id, label, prob)``, as ``bm_label_propagation`` over the pairs.

    Distributions of a connected group of at most ``GROUP_KEYS`` keys are worked
    out in the task that gets the group (``groups``), so rounds write nothing;
    those of larger groups go round by round through sums by (cell, label).
    """
    if max_steps <= 0:
        raise ValueError("max_steps must be > 0")
    shared = cut_lineage(shared.select(one_record(), "cell", "n"))
    start = vertices.select(F.col("id").alias("k"), "label", F.lit(1.0).alias("prob"))
    member = cut_lineage(cell_components(shared).select(F.col("id").alias("k"), "component"))
    sizes = cut_lineage(member.groupBy("component").agg(F.count("*").alias("size")))
    small = F.col("size") <= GROUP_KEYS
    found = sizes.agg(F.sum(F.when(small, F.col("size") * F.col("size"))).alias("rows"), F.count_if(~small).alias("large")).first()
    out = cut_lineage(start.join(shuffled(member), on="k", how="left_anti"))
    of = cut_lineage(spread_join(member, sizes, "component").select("k", "component", "size"))
    if found["rows"]:
        held = shared.groupBy("k").agg(F.collect_list("cell").alias("cells"))
        rows = (of.where(small).join(shuffled(held), on="k").join(shuffled(start.select("k", "label")), on="k", how="left")
                .select("component", "k", "label", "cells"))
        out = out.unionByName(group_bm_label_propagation(rows, max_steps, seed_label, -(-found["rows"] // GROUP_ROWS)))
    if found["large"]:
        keys = of.where(~small).select("k")
        out = out.unionByName(_by_sums(shared.join(shuffled(keys), on="k", how="left_semi"),
                                       start.join(shuffled(keys), on="k", how="left_semi"), max_steps, seed_label))
    for old in (member, sizes):
        release(old)
    return out.select(F.col("k").alias("id"), "label", "prob")


def _by_sums(shared: DataFrame, start: DataFrame, max_steps: int, seed_label: int) -> DataFrame:
    """``(k, label, prob)`` of groups of any size, from ``start(k, label, prob)``.

    A distribution sums to one, so what a vertex receives sums to the number of
    other keys in its cells, a constant. Probabilities of exactly 1 are counted
    apart from the sums of the others: taking the own share off a count is exact,
    so a vertex among pure neighbours gets exactly 1, and a label that only the
    vertex itself sends is known by a count of zero and not by a small remainder.
    """
    shared = cut_lineage(shared)
    keys = cut_lineage(shared.groupBy("k").agg(F.count("*").alias("m"), F.sum(F.col("n") - 1).alias("others")))
    dist = cut_lineage(start)
    pure = F.col("prob") == 1.0
    for step in range(max_steps):
        sums = (shared.select("k", "cell").join(dist, on="k").groupBy("cell", "label")
                .agg(F.count_if(pure).alias("ones"), F.count_if(~pure).alias("parts"),
                     F.sum(F.when(pure, 0.0).otherwise(F.col("prob"))).alias("part")))
        clamped = dist.where((F.col("label") == seed_label) & pure).select("k")
        open_keys = keys.join(clamped, on="k", how="left_anti")
        got = (shared.select("k", "cell").join(clamped, on="k", how="left_anti").join(sums, on="cell").groupBy("k", "label")
               .agg(F.sum("ones").alias("ones"), F.sum("parts").alias("parts"), F.sum("part").alias("part")))
        own = F.coalesce("prob", F.lit(0.0))
        ones = F.col("ones") - F.when(own == 1.0, F.col("m")).otherwise(0)
        parts = F.col("parts") - F.when(F.col("prob").isNotNull() & (own < 1.0), F.col("m")).otherwise(0)
        rest = F.when(own < 1.0, F.greatest(F.col("part") - F.col("m") * own, F.lit(0.0))).otherwise(F.col("part"))
        new = (got.join(dist, on=["k", "label"], how="left").join(open_keys, on="k")
               .where(ones + parts > 0)
               .select("k", "label", ((ones + F.when(parts > 0, rest).otherwise(0.0)) / F.col("others")).alias("prob")))
        nxt = cut_lineage(dist.join(clamped, on="k", how="left_semi").unionByName(new))
        release(dist)
        dist = nxt
    release(shared)
    release(keys)
    return dist
