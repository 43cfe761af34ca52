"""Louvain community detection with synchronous moves (GR8-GR11b, GR13).

State per level: ``nodes(id, comm, degree, inner_degree)`` and weighted ``edges``;
``membership(vertex, node)`` maps every original vertex to its node at the
current level, so all vertices are carried through every level (isolated
super-nodes included).

Gain of moving node v into neighbouring community c::

    q = k_in(v, c) - (resolution / 2) * tot'(c) * k_v / m

with ``k_v = degree + inner_degree``, ``tot(c)`` the sum of ``k`` over c's members
(``tot' = tot - k_v`` for v's own community), ``k_in`` the weight between v
and c counting both edge directions, and ``m`` the total weight of the
original edges (not recomputed after coarsening). A node moves to its best
candidate when that gain is positive (ties: smallest community id). All nodes
move at once; chains and swaps are resolved by connected components over
(node, target) pairs, each component taking its smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens import defaults as D
from risklens.operators.graph.blocks import Blocks, block_moves, packed_ends
from risklens.operators.graph.build import edge_ends, vertex_strength
from risklens.operators.joins import PLAIN_ROWS, shuffled, spread_join
from risklens.session import append_table, cut_lineage, new_table_path, read_table, release


def louvain_init(edges: DataFrame) -> DataFrame:
    """Level-0 nodes: every endpoint in its own community, degree = strength."""
    return vertex_strength(edges).select(
        "id", F.col("id").alias("comm"), "degree", F.lit(0.0).alias("inner_degree"))


def _triplets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select("id", "comm")
    return (edges.select("src", "dst", "weight")
            .join(shuffled(n.select(F.col("id").alias("src"), F.col("comm").alias("cs"))), on="src")
            .join(shuffled(n.select(F.col("id").alias("dst"), F.col("comm").alias("cd"))), on="dst"))


def neighbour_communities(nodes: DataFrame, ends: DataFrame, n_nodes: int | None = None,
                          n_ends: int | None = None) -> DataFrame:
    """GR8: ``(id, comm, k_in, tot)`` for every node of ``ends`` and neighbouring
    community. A giant community's ``tot`` and a hub's community reach the rows
    that need them by spread joins."""
    tot = (nodes.groupBy(F.col("comm").alias("c"))
           .agg(F.sum(F.col("degree") + F.col("inner_degree")).alias("tot")))
    info = spread_join(nodes.select(F.col("id").alias("nbr"), F.col("comm").alias("c")), tot, "c", rows=n_nodes)
    return (spread_join(ends, info.select("nbr", "c", "tot"), "nbr", rows=n_ends)
            .groupBy("id", F.col("c").alias("comm"), "tot").agg(F.sum("weight").alias("k_in"))
            .select("id", "comm", "k_in", "tot"))


def best_moves(nodes: DataFrame, ends: DataFrame, m: float, resolution: float = D.LOUVAIN_RESOLUTION,
               n_nodes: int | None = None, n_ends: int | None = None, info: DataFrame | None = None) -> DataFrame:
    """GR9: ``(id, comm, target, gain)`` for every node of ``ends``; ``info``: its
    neighbouring communities, where they are written already."""
    if m <= 0:
        raise ValueError("total weight must be positive")
    if info is None:
        info = neighbour_communities(nodes, ends, n_nodes, n_ends)
    me = nodes.select("id", F.col("comm").alias("own"),
                      (F.col("degree") + F.col("inner_degree")).alias("k_v"))
    cand = spread_join(info, me, "id", rows=n_ends)
    tot = F.col("tot") - F.when(F.col("comm") == F.col("own"), F.col("k_v")).otherwise(0.0)
    q = F.col("k_in") - F.lit(resolution / 2.0) * tot * F.col("k_v") / F.lit(float(m))
    best = (cand.groupBy("id", "own")
            .agg(F.max(F.struct(q.alias("q"), (-F.col("comm")).alias("neg"))).alias("b")))
    move = F.col("b.q") > 0
    return best.select(
        "id", F.col("own").alias("comm"),
        F.when(move, -F.col("b.neg")).otherwise(F.col("own")).alias("target"),
        F.when(move, F.col("b.q")).otherwise(F.lit(0.0)).alias("gain"))


def packed_moves(nodes: DataFrame, blocks: Blocks, m: float, resolution: float = D.LOUVAIN_RESOLUTION,
                 n_nodes: int | None = None) -> DataFrame:
    """``best_moves`` of all nodes by ``blocks`` of packed ends; by rows for nodes of too many ends."""
    tot = (nodes.groupBy("comm").agg(F.sum(F.col("degree") + F.col("inner_degree")).alias("tot")))
    k_v = F.col("degree") + F.col("inner_degree")
    values = (spread_join(nodes.select("id", "comm", k_v.alias("k_v")), tot, "comm", rows=n_nodes)
              .select("id", "comm", F.coalesce("tot", F.lit(0.0)).alias("tot"), F.coalesce("k_v", F.lit(0.0)).alias("k_v")))
    moves = block_moves(blocks, values, m, resolution)
    if blocks.hubs is None:
        return moves
    return moves.unionByName(best_moves(nodes, blocks.hubs, m, resolution, n_nodes, blocks.hub_ends))


def target_groups(moves: DataFrame) -> DataFrame:
    """``(id, component)`` of the graph in which every ``src`` points at its one ``dst``:
    ids that lead into the same cycle (or the same resting target) get the same value.

    Pointer doubling: after k rounds an id knows the node 2^k steps ahead and the
    smallest id on the way. Rounds stop when pointers reach no fewer nodes than
    before (then all of them lie on cycles) and no smallest id changes; the group
    is named by the smallest id of the cycle. One join per round instead of a
    components loop, since every node has a single outgoing edge.
    """
    rest = (moves.select(F.col("dst").alias("id"))
            .join(shuffled(moves.select(F.col("src").alias("id"))), on="id", how="left_anti").distinct())
    state = cut_lineage(moves.select(F.col("src").alias("id"), F.col("dst").alias("ahead"), F.least("src", "dst").alias("low"))
                        .unionByName(rest.select("id", F.col("id").alias("ahead"), F.col("id").alias("low"))))
    reached = None
    while True:
        there = state.select(F.col("id").alias("ahead"), F.col("ahead").alias("next"), F.col("low").alias("next_low"))
        joined = state.join(shuffled(there), on="ahead")
        nxt = cut_lineage(joined.select("id", F.col("next").alias("ahead"), F.least("low", "next_low").alias("low"),
                                        F.col("low").alias("old")))
        now = nxt.agg(F.count_distinct("ahead").alias("n"), F.count_if(F.col("low") < F.col("old")).alias("changed")).first()
        release(state)
        state = nxt.select("id", "ahead", "low")
        if now["n"] == reached and now["changed"] == 0:
            break
        reached = now["n"]
    root = state.select(F.col("id").alias("ahead"), F.col("low").alias("component"))
    return state.select("id", "ahead").join(shuffled(root), on="ahead").select("id", "component")


def relabel(nodes: DataFrame, moves: DataFrame, reps_move: bool | None = None, n_nodes: int | None = None):
    """GR10 step: every node with a move row takes the smallest id of its
    connected component in the graph of (node, target) pairs; the others
    keep their community. Returns ``(nodes, component_table)``.

    Targets are always community representatives (a representative's
    community id is its own id), so a node that is not a representative is a
    leaf hanging off exactly one representative: its target, or its own
    community when it stays. Components are therefore computed over the
    representatives that move -- a graph that shrinks as communities form --
    and the smallest id per component is one aggregate over all nodes.
    """
    reps = nodes.where(F.col("id") == F.col("comm")).select("id")
    rep_moves = (moves.join(shuffled(reps), on="id", how="left_semi")
                 .where(F.col("target") != F.col("id"))
                 .select(F.col("id").alias("src"), F.col("target").alias("dst")))
    if reps_move is None:
        reps_move = not rep_moves.isEmpty()
    if not reps_move:  # no representative moves: every node is a leaf
        rc = moves.sparkSession.createDataFrame([], "id long, component long")
    else:
        rc = target_groups(rep_moves)
    anchor = (moves.join(shuffled(reps.withColumn("is_rep", F.lit(True))), on="id", how="left")
              .select("id", F.when(F.col("is_rep"), F.col("id"))
                      .otherwise(F.col("target")).alias("anchor")))
    placed = (anchor.join(shuffled(rc.withColumnRenamed("id", "anchor")), on="anchor", how="left")
              .select("id", F.coalesce("component", "anchor").alias("k")))
    smallest = placed.groupBy("k").agg(F.min("id").alias("label"))
    cc = spread_join(placed, smallest, "k", rows=n_nodes).select("id", F.col("label").alias("component"))
    out = (nodes.join(shuffled(cc), on="id", how="left")
           .select("id", F.coalesce("component", "comm").alias("comm"), "degree", "inner_degree"))
    return out, rc


#: A round looks at all nodes again if more than one in so many moved in the round before.
FEW_MOVES = 4


def touched_nodes(nodes: DataFrame, moves: DataFrame, n_nodes: int | None = None) -> DataFrame:
    """``(id, comm)`` of all members of the communities that a move leaves or enters."""
    away = moves.where(F.col("target") != F.col("comm"))
    comms = away.select("comm").unionByName(away.select(F.col("target").alias("comm"))).distinct()
    return (spread_join(nodes.select("id", "comm"), comms.withColumn("touched", F.lit(True)), "comm", rows=n_nodes)
            .select("id", "comm"))


def louvain_local(nodes: DataFrame, edges: DataFrame, m: float,
                  max_iter: int = D.LOUVAIN_MAX_ITER,
                  resolution: float = D.LOUVAIN_RESOLUTION) -> tuple[DataFrame, int]:
    """GR10: up to ``max_iter`` rounds of synchronous moves; stops after a
    round without changes. Returns the nodes and the number of rounds that
    changed something.

    After a round of few moves, only a part of the graph is looked at: a node's
    best move depends on its own and its neighbours' communities alone, so it
    can't have changed unless one of these lost or got a member. The active
    nodes of the next round are therefore the members of the touched communities
    and their neighbours, and only members of touched communities are relabelled.

    The ends of a large edge table are packed once (``blocks``), and rounds that look
    at all nodes go by these. Where the touched nodes are many too, so are all nodes
    with their neighbours, and all are looked at.
    """
    rounds = 0
    own = None  # node tables written here are released once superseded
    ends = cut_lineage(edge_ends(edges))
    n_nodes, n_ends = nodes.count(), ends.count()
    blocks = packed_ends(ends, n_ends) if n_ends > PLAIN_ROWS else None
    active, looked_at = None, ends
    while rounds < max_iter:
        if blocks is not None and active is None:
            moves = cut_lineage(packed_moves(nodes, blocks, m, resolution, n_nodes))
        else:
            info = neighbour_communities(nodes, looked_at, n_nodes, n_ends)
            held = cut_lineage(info) if n_ends > PLAIN_ROWS else None  # the join with the nodes reads it twice
            moves = cut_lineage(best_moves(nodes, looked_at, m, resolution, n_nodes, n_ends, info if held is None else held))
            release(held)
        reps = nodes.where(F.col("id") == F.col("comm")).select("id", F.lit(True).alias("rep"))
        counts = (moves.join(shuffled(reps), on="id", how="left")
                  .agg(F.count_if(F.col("target") != F.col("comm")).alias("changed"),
                       F.count_if(F.col("rep") & (F.col("target") != F.col("id"))).alias("reps"))
                  .first())
        changed = counts["changed"]
        if changed == 0:
            # every target is the node's own community, whose id is its
            # smallest member: relabelling would change nothing
            release(moves)
            break
        few = changed * FEW_MOVES <= n_nodes
        if few or active is not None:
            touched = cut_lineage(touched_nodes(nodes, moves, n_nodes))
            # a touched node that was not looked at stays where it is
            told = (touched.join(shuffled(moves.select("id", "target")), on="id", how="left")
                    .select("id", "comm", F.coalesce("target", "comm").alias("target")))
        else:
            touched, told = None, moves
        relabelled, cc = relabel(nodes, told, reps_move=counts["reps"] > 0, n_nodes=n_nodes)
        nodes = cut_lineage(relabelled)
        rounds += 1
        for old in (cc, moves, own, active):
            release(old)
        own, active, looked_at = nodes, None, ends
        if few and rounds < max_iter and (blocks is None or touched.count() * FEW_MOVES <= n_nodes):
            near = ends.join(shuffled(touched.select(F.col("id").alias("nbr"))), on="nbr", how="left_semi").select("id")
            active = cut_lineage(near.unionByName(touched.select("id")).distinct())
            looked_at = ends.join(shuffled(active), on="id", how="left_semi")
        release(touched)
    release(active)
    release(ends)
    if blocks is not None:
        blocks.release()
    return nodes, rounds


def louvain_coarsen(nodes: DataFrame, edges: DataFrame,
                    membership: DataFrame | None = None):
    """GR11: one super-node per community.

    Super-edges join different communities, keyed ``(least, greatest)`` with
    summed weight; a super-node's ``inner`` is the members' inner weight
    plus twice the weight of the edges inside the community. Communities
    without outside edges are kept as isolated super-nodes. Returns
    ``(nodes, edges, membership)``.
    """
    # one pass over the edges, written: super-edges and inner weights both read it
    sums = cut_lineage(_triplets(nodes, edges).groupBy(F.least("cs", "cd").alias("src"), F.greatest("cs", "cd").alias("dst"))
                       .agg(F.sum("weight").alias("weight")))
    cross = sums.where(F.col("src") != F.col("dst"))
    intra = sums.where(F.col("src") == F.col("dst")).select(F.col("src").alias("id"), (F.col("weight") * 2).alias("intra"))
    inner0 = nodes.groupBy(F.col("comm").alias("id")).agg(F.sum("inner_degree").alias("inner0"))
    strength = vertex_strength(cross)
    new_nodes = (inner0.join(shuffled(intra), on="id", how="left").join(shuffled(strength), on="id", how="left")
                 .select("id", F.col("id").alias("comm"),
                         F.coalesce("degree", F.lit(0.0)).alias("degree"),
                         (F.col("inner0") + F.coalesce("intra", F.lit(0.0))).alias("inner_degree")))
    new_membership = None
    if membership is not None:
        new_membership = (membership
                          .join(shuffled(nodes.select(F.col("id").alias("node"), "comm")), on="node")
                          .select("vertex", F.col("comm").alias("node")))
    return new_nodes, cross, new_membership


def louvain(edges: DataFrame, max_iter: int = D.LOUVAIN_MAX_ITER,
            layers: int = D.LOUVAIN_LAYERS,
            resolution: float = D.LOUVAIN_RESOLUTION) -> DataFrame:
    """GR11b: local phase, then up to ``layers + 1`` rounds of (coarsen,
    local phase), stopping when a local phase changes nothing.

    Returns ``(vertex, level, community)``: the community of every original
    vertex after each local phase (level 0 = first phase).
    """
    spark = edges.sparkSession
    edges = cut_lineage(edges.select("src", "dst", "weight"))
    m = edges.agg(F.sum("weight")).first()[0]
    schema = "vertex long, level int, community long"
    if not m:
        release(edges)
        return spark.createDataFrame([], schema)
    nodes = cut_lineage(louvain_init(edges))
    membership = nodes.select(F.col("id").alias("vertex"), F.col("id").alias("node"))
    result_path = new_table_path(spark)

    def snapshot(level, nodes, membership):
        append_table(
            membership.join(shuffled(nodes.select(F.col("id").alias("node"), "comm")), on="node")
            .select("vertex", F.lit(level).alias("level"), F.col("comm").alias("community")),
            result_path)

    start_nodes = nodes
    nodes, rounds = louvain_local(nodes, edges, m, max_iter, resolution)
    snapshot(0, nodes, membership)
    layer = 0
    while rounds != 0 and layer <= layers:
        new_nodes, new_edges, new_membership = louvain_coarsen(nodes, edges, membership)
        sums, new_edges = new_edges, cut_lineage(new_edges)
        new_membership = cut_lineage(new_membership)
        new_nodes = cut_lineage(new_nodes)
        release(sums)
        # level-0 membership reads the initial node table
        for old in (nodes, edges, membership if layer > 0 else start_nodes):
            release(old)
        edges, membership = new_edges, new_membership
        nodes, rounds = louvain_local(new_nodes, edges, m, max_iter, resolution)
        if nodes is not new_nodes:
            release(new_nodes)
        layer += 1
        snapshot(layer, nodes, membership)
    for old in (nodes, edges, membership if layer > 0 else start_nodes):
        release(old)
    from pyspark.sql import types as T  # noqa: PLC0415
    return read_table(spark, result_path, T._parse_datatype_string(schema))


def communities(membership: DataFrame) -> DataFrame:
    """GR13: ``(level, community, size)``; members stay in the long
    ``membership`` table rather than one unbounded array per community."""
    return membership.groupBy("level", "community").agg(F.count("*").alias("size"))


def modularity(edges: DataFrame, assignment: DataFrame, resolution: float = 1.0,
               by: list[str] | None = None) -> DataFrame:
    """Modularity of ``assignment(vertex, community[, *by])`` on the
    undirected view of ``edges``: ``sum_c in_c / 2M - resolution * (tot_c / 2M)^2``,
    one row per ``by`` group (e.g. per Louvain level)."""
    by = list(by or [])
    e = edges.select("src", "dst", "weight")
    two_m = e.agg(F.sum(F.col("weight") * 2)).scalar()
    a = assignment.select(F.col("vertex").alias("v"), F.col("community").alias("c"), *by)
    strength = vertex_strength(e).join(shuffled(a.withColumnRenamed("v", "id")), on="id")
    tot = strength.groupBy(*by, "c").agg(F.sum("degree").alias("tot"))
    ins = (e.join(shuffled(a.select(F.col("v").alias("src"), F.col("c").alias("cs"), *by)), on="src")
           .join(shuffled(a.select(F.col("v").alias("dst"), F.col("c").alias("cd"), *by)), on=["dst", *by])
           .where(F.col("cs") == F.col("cd"))
           .groupBy(*by, F.col("cs").alias("c")).agg(F.sum(F.col("weight") * 2).alias("in_c")))
    per_c = tot.join(shuffled(ins), on=[*by, "c"], how="left").select(
        *by,
        (F.coalesce("in_c", F.lit(0.0)) / two_m
         - F.lit(resolution) * (F.col("tot") / two_m) * (F.col("tot") / two_m)).alias("q"))
    return per_c.groupBy(*by).agg(F.sum("q").alias("modularity"))
