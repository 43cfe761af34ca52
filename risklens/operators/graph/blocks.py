"""Rounds over a large edge table by blocks of vertices.

Vertices are dealt into blocks by a hash. The ends of a block's vertices are
packed once: positions of the vertices, of their neighbours, and weights, as
arrays; and for every other block, the list of its vertices that are neighbours
here. In a round, each block of senders looks up what its vertices have to say
and sends one array to each block that listens; each block of receivers puts
the arrays together and sums up. What is shuffled in a round is one value per
vertex and listening block, not one row per edge, and nothing is sorted by Spark.

A block has about ``BLOCK_ENDS`` ends. Vertices of more than ``MOST_ENDS``, which
would make a block large, take no part as receivers: their ends are kept as
rows (``hubs``), for the caller to join. As senders they count once per block.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklens.operators.graph.build import edge_ends
from risklens.operators.joins import PLAIN_ROWS, shuffled
from risklens.session import cut_lineage, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ends of a block, about, and of a vertex that is packed, at most.
BLOCK_ENDS = 500_000
MOST_ENDS = 100_000

_PACKED = {"ids": np.int64, "at": np.int32, "neighbour": np.int32, "weight": np.float64}


@dataclass
class Blocks:
    """``table``: packed ends and lists of listened-to vertices, ``n`` blocks;
    ``hubs(id, nbr, weight)``: ends of the others, or None, ``hub_ends`` of them."""

    table: DataFrame
    n: int
    hubs: DataFrame | None
    hub_ends: int

    def release(self) -> None:
        release(self.table)
        release(self.hubs)


def _block(vertex: str, n: int) -> Column:
    return F.pmod(F.xxhash64(vertex), F.lit(n)).cast("int")


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _starts(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))


def _packed(ends: pa.Table) -> pa.Table:
    """A block's row (``sender`` -1), and one row for each block that it listens to."""
    of = _array(ends, "sender")
    ids, at = np.unique(_array(ends, "id"), return_inverse=True)
    names, first, place = np.unique(_array(ends, "nbr"), return_index=True, return_inverse=True)
    order = np.argsort(of[first], kind="stable")
    names, senders = names[order], of[first][order]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    starts = _starts(senders)
    own = {"ids": ids, "at": at.astype(np.int32), "neighbour": rank[place], "weight": _array(ends, "weight")}
    lists = [x.tobytes() for x in np.split(names, starts[1:])]
    rows = 1 + len(lists)
    return pa.table({
        "receiver": pa.array([ends.column("receiver")[0].as_py()] * rows, pa.int32()),
        "sender": pa.array([-1, *senders[starts].tolist()], pa.int32()),
        **{c: pa.array([own[c].tobytes(), *(lists if c == "ids" else [None] * len(lists))], pa.binary()) for c in _PACKED}})


def packed_ends(ends: DataFrame, n_ends: int) -> Blocks:
    """Blocks of ``ends(id, nbr, weight)``, a written table. Ends without id or
    neighbour meet nothing; a missing weight adds nothing."""
    ends = ends.where(F.col("id").isNotNull() & F.col("nbr").isNotNull()).select("id", "nbr", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    n = -(-n_ends // BLOCK_ENDS)
    many = cut_lineage(ends.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ENDS))
    hub_ends = many.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hubs = None
    if hub_ends:  # no more than n_ends / MOST_ENDS of them
        names = F.broadcast(many.select("id"))
        hubs = cut_lineage(ends.join(names, on="id", how="left_semi"))
        ends = ends.join(names, on="id", how="left_anti")
    rows = ends.select(_block("id", n).alias("receiver"), _block("nbr", n).alias("sender"), "id", "nbr", F.col("weight").cast("double").alias("weight"))
    table = cut_lineage(rows.groupBy("receiver").applyInArrow(
        _packed, "receiver int, sender int, " + ", ".join(f"{c} binary" for c in _PACKED)))
    release(many)
    return Blocks(table, n, hubs, hub_ends)


def packed_graph(edges: DataFrame) -> Blocks | None:
    """Blocks of ``edges(src, dst, weight)`` from both ends; None for few edges."""
    ends = cut_lineage(edge_ends(edges))
    n_ends = ends.count()
    blocks = packed_ends(ends, n_ends) if n_ends > PLAIN_ROWS else None
    release(ends)
    return blocks


def exchanged(blocks: Blocks, values: DataFrame, sent: dict, own: dict, work, schema: str) -> DataFrame:
    """One round. ``values(id, ...)`` has one row a vertex; ``sent`` and ``own`` name
    its columns, with numpy types, that neighbours and the vertex itself get.

    ``work(ids, at, neighbour, weight, sent, own) -> arrays of schema`` gets a
    block: end i is that of vertex ``ids[at[i]]``, its neighbour's values are
    ``sent[name][neighbour[i]]``, the vertex's are ``own[name][at[i]]``. Ends
    whose neighbour, or with ``own`` whose vertex, has no row in ``values`` are left out."""
    kinds = sent | own
    fields = ["receiver", "sender", "ids", "found", *kinds]
    names = [f.split()[0] for f in schema.split(", ")]

    def send(nodes: pa.Table, lists: pa.Table) -> pa.Table:
        ids = _array(nodes, "id")
        order = np.argsort(ids)
        ids = ids[order]
        has = {c: _array(nodes, c).astype(t, copy=False)[order] for c, t in kinds.items()}
        out = []
        if own and len(ids):
            out.append([nodes.column("block")[0].as_py(), -1, ids.tobytes(), None, *(has[c].tobytes() if c in own else None for c in kinds)])
        for receiver, sender, asked in zip(*(lists.column(c).to_pylist() for c in ("receiver", "sender", "ids"))):
            asked = np.frombuffer(asked, np.int64)
            place = np.minimum(np.searchsorted(ids, asked), max(len(ids) - 1, 0))
            found = ids[place] == asked if len(ids) else np.zeros(len(asked), bool)
            out.append([receiver, sender, None, found.tobytes(),
                        *((has[c][place] if len(ids) else np.zeros(len(asked), t)).tobytes() if c in sent else None for c, t in kinds.items())])
        types = [pa.int32(), pa.int32()] + [pa.binary()] * (len(fields) - 2)
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=fields)

    def receive(got: pa.Table, block: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({c: [] for c in names})
        packed = {c: np.frombuffer(block.column(c)[0].as_py(), t) for c, t in _PACKED.items()}
        got = got.sort_by("sender")
        mine, others = got.filter(pa.compute.equal(got.column("sender"), -1)), got.filter(pa.compute.not_equal(got.column("sender"), -1))

        def joined(column, kind):
            return np.concatenate([np.frombuffer(x, kind) for x in others.column(column).to_pylist()] or [np.empty(0, kind)])

        ids, at, neighbour, weight = packed.values()
        told, taken, known = {c: joined(c, t) for c, t in sent.items()}, joined("found", bool)[neighbour], {}
        if own:
            of = np.frombuffer(mine.column("ids")[0].as_py(), np.int64) if mine.num_rows else np.empty(0, np.int64)
            place = np.minimum(np.searchsorted(of, ids), max(len(of) - 1, 0))
            here = of[place] == ids if len(of) else np.zeros(len(ids), bool)
            known = {c: np.frombuffer(mine.column(c)[0].as_py(), t)[place] if len(of) else np.zeros(len(ids), t) for c, t in own.items()}
            taken = taken & here[at]
        if not taken.all():
            at, neighbour, weight = at[taken], neighbour[taken], weight[taken]
        return pa.table(dict(zip(names, map(pa.array, work(ids, at, neighbour, weight, told, known)))))

    nodes = values.where(F.col("id").isNotNull()).select(_block("id", blocks.n).alias("block"), "id", *kinds)
    lists = blocks.table.where("sender >= 0").select("receiver", "sender", "ids")
    messages = nodes.groupBy("block").cogroup(lists.groupBy("sender")).applyInArrow(
        send, "receiver int, sender int, " + ", ".join(f"{c} binary" for c in fields[2:]))
    return (messages.groupBy("receiver").cogroup(blocks.table.where("sender = -1").groupBy("receiver"))
            .applyInArrow(receive, schema))


def block_moves(blocks: Blocks, values: DataFrame, m: float, resolution: float) -> DataFrame:
    """``(id, comm, target, gain)`` as of ``community.best_moves``, from
    ``values(id, comm, tot, k_v)``, for the packed vertices."""
    half, m = resolution / 2.0, float(m)

    def work(ids, at, neighbour, weight, sent, own):
        names, code = np.unique(sent["comm"], return_inverse=True)
        total = np.empty(len(names))
        total[code] = sent["tot"]
        key = at.astype(np.int64) * max(len(names), 1) + code[neighbour]
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        if not len(key):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        starts = _starts(key)
        who, what = np.divmod(key[starts], len(names))
        comm, k_v = own["comm"][who], own["k_v"][who]
        tot = total[what] - np.where(names[what] == comm, k_v, 0.0)
        q = np.add.reduceat(weight, starts) - half * tot * k_v / m
        first = _starts(who)
        top = np.maximum.reduceat(q, first)
        # of equal gains the smallest community, which comes first
        best = np.flatnonzero(q == np.repeat(top, np.diff(np.append(first, len(q)))))
        best = best[_starts(who[best])]
        move = top > 0
        return ids[who[first]], comm[first], np.where(move, names[what[best]], comm[first]), np.where(move, top, 0.0)

    return exchanged(blocks, values, {"comm": np.int64, "tot": np.float64}, {"comm": np.int64, "k_v": np.float64}, work,
                     "id long, comm long, target long, gain double")


def block_means(blocks: Blocks, values: DataFrame) -> DataFrame:
    """``(id, s, z)``: sums of weight x ``prob`` and of weight over a vertex's
    neighbours, from ``values(id, prob)``, for the packed vertices. Both sums
    take the same ends in the same order."""

    def work(ids, at, neighbour, weight, sent, own):
        s, z = (np.bincount(at, w, len(ids)) for w in (weight * sent["prob"][neighbour], weight))
        some = np.bincount(at, minlength=len(ids)) > 0
        return ids[some], s[some], z[some]

    return exchanged(blocks, values, {"prob": np.float64}, {}, work, "id long, s double, z double")


def block_least(blocks: Blocks, vertices: DataFrame) -> DataFrame:
    """``(id, least, ends)`` of the subgraph between ``vertices(id)``: the smallest
    neighbour and the number of ends of every vertex that has one."""

    def work(ids, at, neighbour, weight, sent, own):
        order = np.argsort(at, kind="stable")
        at, to = at[order], sent["name"][neighbour[order]]
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        first = _starts(at)
        return ids[at[first]], np.minimum.reduceat(to, first), np.diff(np.append(first, len(at)))

    name = {"name": np.int64}
    least = exchanged(blocks, vertices.select("id", F.col("id").alias("name")), name, name, work, "id long, least long, ends long")
    if blocks.hubs is None:
        return least
    ids = vertices.select("id")
    inside = (blocks.hubs.join(shuffled(ids.withColumnRenamed("id", "nbr")), on="nbr", how="left_semi")
              .groupBy("id").agg(F.min("nbr").alias("least"), F.count("*").alias("ends")))
    return least.unionByName(inside.join(shuffled(ids), on="id", how="left_semi"))


def block_pairs(blocks: Blocks, pointers: DataFrame) -> DataFrame:
    """``(u, v)``, ``u > v``: edges of the packed vertices between what their ends
    point at by ``pointers(id, to)``, without loops, each once a block."""

    def work(ids, at, neighbour, weight, sent, own):
        a, b = own["to"][at], sent["to"][neighbour]
        apart = a != b
        u, v = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        return u[new], v[new]

    to = {"to": np.int64}
    return exchanged(blocks, pointers.select("id", "to"), to, to, work, "u long, v long")
