"""Vector code compression: product quantisation by cover-tree Lloyd.

Components become integers floor(4096 * x); a vector is cut into equal
consecutive parts, and each part position has a codebook of integer entries,
refined by rounds of Lloyd's algorithm. All arithmetic that decides anything is
on integers, so results are exact and don't depend on how rows are dealt.

Each Spark partition cuts its vectors into blocks and builds, once, a cover
tree a part position and block: a node has a centre, a radius that covers its
points, and children whose centres lie more than half that radius apart and
cover its points within half of it. A node's points stand next to each other,
so cumulative sums give the sum of any subtree. The trees are written to the
shared folder; every round reads them:

* let c be the entry nearest to a node's centre and r its radius. An entry e
  with d(centre, e) - r > d(centre, c) + r is nearest to none of the node's
  points (triangle inequality) and is left out below the node;
* if only c is left, the whole subtree goes to c: one count and one sum;
* else the node's children are looked at, and the points of a leaf that stays
  ambiguous are compared with the entries exactly (ties to the lower index).

The comparison with radii allows for rounding, so a tie is always ambiguous.
Only counts and sums by (part, entry, position) leave the executors.

Edge cases: rows whose vector is null, or holds a null or non-finite component,
are dropped; an empty vector is kept and, like any vector shorter than the
longest, is filled up with zeros, up to a multiple of the number of parts;
components beyond +-2**26 (|x| of 16,384) count as that; fewer vectors than
entries give codebooks of as many entries; repeated ids are rows of their own,
in the first codebook in order of their components; a null id stands last
there; a null label is a label; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.tables import bound_batches, join_small, load, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest component; with it squared distances stay exact in 64 bits up to 256 components a part.
LIMIT = 1 << 26
#: Vectors of a block, and bytes of their components.
BLOCK_VECTORS, BLOCK_BYTES = 2048, 1 << 20
#: Points of a node that isn't divided any more.
LEAF = 16
#: More than the relative rounding error of a distance.
_SLACK = 1e-9


def integers(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, x`` with x = floor(scale * component); rows that take no part are left out."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    held = lambda v: F.greatest(F.least(F.lit(float(scale)) * v, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    return (vectors.where(F.col(vector).isNotNull()).where(finite)
            .select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
                    F.transform(x, lambda v: F.floor(held(v)).cast("int")).alias("x")))


class CoverTree:
    """Cover tree of the rows of ``points``. Node i covers the points
    ``order[start[i]:end[i]]``, the first of them its centre, within
    ``radius[i]``; its children are the nodes ``[child[i], child[i] + children[i])``."""

    def __init__(self, order: np.ndarray, links: np.ndarray, radius: np.ndarray):
        self.order, self.links, self.radius = order, links, radius
        self.start, self.end, self.child, self.children = links

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        points = points.astype(np.float64)
        order = np.arange(len(points), dtype=np.int32)
        away = np.square(points - points[0]).sum(axis=1)
        nodes = [[0, len(points), 0, 0]]
        square = [away.max()]
        for i, node in enumerate(nodes):  # grows on the way
            start, end = node[:2]
            if end - start <= LEAF or square[i] == 0:
                continue
            node[2] = len(nodes)
            rest = order[start:end].copy()
            while len(rest):
                away = np.square(points[rest] - points[rest[0]]).sum(axis=1)
                near = away <= square[i] / 4
                own = rest[near]
                order[start:start + len(own)] = own
                nodes.append([start, start + len(own), 0, 0])
                square.append(away[near].max())
                start += len(own)
                rest = rest[~near]
            node[3] = len(nodes) - node[2]
        return cls(order, np.array(nodes, dtype=np.int32).T.copy(), np.sqrt(square) * (1 + _SLACK))

    def settle(self, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entries of all points: subtrees (nodes, their entries) and single points (numbers, their entries)."""
        nodes, entries, alone = [], [], []
        front, among = np.zeros(1, dtype=np.int64), np.ones((1, len(book)), dtype=bool)
        far = book.astype(np.float64)
        while len(front):
            centres = points[self.order[self.start[front]]].astype(np.float64)
            away = np.sqrt(np.square(centres[:, None, :] - far).sum(axis=2))
            away[~among] = np.inf
            r = self.radius[front]
            among &= away * (1 - _SLACK) - r[:, None] <= (away.min(axis=1) * (1 + _SLACK) + r)[:, None]
            settled = among.sum(axis=1) == 1
            nodes.append(front[settled])
            entries.append(away[settled].argmin(axis=1))
            leaf = ~settled & (self.children[front] == 0)
            alone += [np.arange(self.start[i], self.end[i]) for i in front[leaf]]
            inner = ~settled & ~leaf
            n = self.children[front[inner]]
            first = np.repeat(self.child[front[inner]] - (np.cumsum(n) - n), n)
            front, among = first + np.arange(n.sum()), np.repeat(among[inner], n, axis=0)
        single = self.order[np.concatenate(alone)] if alone else np.zeros(0, dtype=np.int32)
        return np.concatenate(nodes), np.concatenate(entries), single, nearest(points[single], book)

    def sums(self, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and componentwise sum of the points of each entry."""
        count, total = np.zeros(len(book), dtype=np.int64), np.zeros(book.shape, dtype=np.int64)
        nodes, entries, single, own = self.settle(points, book)
        ahead = np.zeros((len(points) + 1, points.shape[1]), dtype=np.int64)
        np.cumsum(points[self.order], axis=0, dtype=np.int64, out=ahead[1:])
        np.add.at(count, entries, self.end[nodes] - self.start[nodes])
        np.add.at(total, entries, ahead[self.end[nodes]] - ahead[self.start[nodes]])
        np.add.at(count, own, 1)
        np.add.at(total, own, points[single])
        return count, total

    def codes(self, points: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Entry of each point."""
        out = np.zeros(len(points), dtype=np.int64)
        nodes, entries, single, own = self.settle(points, book)
        for i, entry in zip(nodes, entries):
            out[self.order[self.start[i]:self.end[i]]] = entry
        out[single] = own
        return out


def nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact: entry of least squared distance, ties to the lower index."""
    best, at = np.full(len(points), np.iinfo(np.int64).max), np.zeros(len(points), dtype=np.int64)
    for j, entry in enumerate(book):
        away = np.square(points.astype(np.int64) - entry).sum(axis=1)
        closer = away < best
        best[closer], at[closer] = away[closer], j
    return at


def plant(rows: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """The blocks of ``vec_id, label, x`` with their trees, written to the shared
    folder: ids, labels, points (int32, row by row) and, one tree after the
    other, order, sizes, links and radii of the trees."""
    label = rows.schema["label"].dataType
    most = max(1, min(BLOCK_VECTORS, BLOCK_BYTES // (4 * width)))

    def block(ids: list, labels: list, points: list) -> pa.RecordBatch:
        ids, labels, x = pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(points)
        trees = [CoverTree.build(p) for p in np.split(x, parts, axis=1)]
        listed = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        whole = lambda a: pa.array([b"".join(y.tobytes() for y in a)], pa.binary())
        return pa.RecordBatch.from_arrays([
            listed(ids), listed(labels), whole([x]), whole([t.order for t in trees]),
            listed(pa.array([len(t.radius) for t in trees], pa.int32())),
            whole([t.links for t in trees]), whole([t.radius for t in trees])],
            names=["ids", "labels", "points", "orders", "sizes", "links", "radii"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, points, n = [], [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                took = min(most - n, batch.num_rows - at)
                piece = batch.slice(at, took)
                x = piece.column("x")
                bounds = x.offsets.to_numpy()
                size, flat = np.diff(bounds), x.values.to_numpy(zero_copy_only=False)[bounds[0]:bounds[-1]]
                filled = np.zeros((took, width), dtype=np.int32)
                filled[np.repeat(np.arange(took), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
                ids.append(piece.column("vec_id"))
                labels.append(piece.column("label"))
                points.append(filled)
                n, at = n + took, at + took
                if n == most:
                    yield block(ids, labels, points)
                    ids, labels, points, n = [], [], [], 0
        if n:
            yield block(ids, labels, points)

    schema = (f"ids array<long>, labels array<{label.simpleString()}>, points binary, orders binary, "
              "sizes array<int>, links binary, radii binary")
    return written(rows.mapInArrow(blocks, schema), "cover-trees")


def _forests(batches: Iterator[pa.RecordBatch], width: int, parts: int):
    """Of each block: its ids, labels, and (points, tree) of every part."""
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["points"], dtype=np.int32).reshape(-1, width)
            orders = np.frombuffer(row["orders"], dtype=np.int32).reshape(parts, -1)
            links, radii = np.frombuffer(row["links"], dtype=np.int32), np.frombuffer(row["radii"], dtype=np.float64)
            ends = np.cumsum(row["sizes"])
            trees = [CoverTree(o, links[4 * (e - n):4 * e].reshape(4, n), radii[e - n:e])
                     for o, e, n in zip(orders, ends, row["sizes"])]
            yield row["ids"], row["labels"], list(zip(np.split(x, parts, axis=1), trees))


def refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one more round of Lloyd. ``books``: parts x entries x components."""
    parts, entries, d = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for _, _, forest in _forests(batches, parts * d, parts):
            for j, (points, tree) in enumerate(forest):
                n, s = tree.sums(points, books[j])
                count[j] += n
                total[j] += s
        cell = np.indices(books.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell[0]), pa.array(cell[1]), pa.array(cell[2]), pa.array(np.repeat(count.ravel(), d)), pa.array(total.ravel())],
            names=["part", "entry", "pos", "held", "total"])

    found = (blocks.select("ids", "labels", "points", "orders", "sizes", "links", "radii")
             .mapInArrow(sums, "part long, entry long, pos long, held long, total long")
             .groupBy("part", "entry", "pos").agg(F.sum("held").alias("held"), F.sum("total").alias("total")))
    out = books.copy()
    for r in found.where(F.col("held") > 0).collect():  # at most one row a component of an entry
        out[r["part"], r["entry"], r["pos"]] = r["total"] // r["held"]
    return out


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every vector: two hex digits a part, and the squared distance."""
    parts, entries, d = books.shape
    if entries > 256:
        raise ValueError("a code has two hex digits a part")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, forest in _forests(batches, parts * d, parts):
            code, error = np.zeros((len(ids), parts), dtype=np.uint8), np.zeros(len(ids), dtype=np.int64)
            for j, (points, tree) in enumerate(forest):
                own = tree.codes(points, books[j])
                code[:, j] = own
                error += np.square(points.astype(np.int64) - books[j][own]).sum(axis=1)
            text = code.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, label_type),
                 pa.array([text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)]), pa.array(error)],
                names=["vec_id", "label", "code", "error"])

    from pyspark.sql.pandas.types import to_arrow_type

    label = blocks.schema["labels"].dataType.elementType
    label_type = to_arrow_type(label)
    return blocks.mapInArrow(codes, f"vec_id long, label {label.simpleString()}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of ``vec_id, label, x``, and the codebooks
    (parts x entries x components) that the codes refer to."""
    bound_batches(rows.sparkSession)
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    d = max(1, -(-longest // parts))
    first = [r["x"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    books = np.zeros((len(first), parts * d), dtype=np.int64)
    for book, x in zip(books, first):
        book[:len(x)] = x
    books = books.reshape(len(first), parts, d).transpose(1, 0, 2).copy()
    blocks = plant(rows, parts * d, parts)
    for _ in range(rounds if len(first) else 0):
        books = refined(blocks, books)
    return written(coded(blocks, books), "vector-codes"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compressed(integers(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"))
    by_label = codes.groupBy(F.col("label").alias("e_label")).agg(F.sum("error").alias("label_error"))
    return (join_small(codes, by_label, F.col("label").eqNullSafe(F.col("e_label")), "inner")
            .select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")))


def _sql() -> str:
    away = "list_sum(list_transform(list_zip(p.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""p AS MATERIALIZED (
  SELECT rid, part, w[part * (len(w) // {PARTS}) + 1:(part + 1) * (len(w) // {PARTS})] AS w
  FROM v, (SELECT unnest(range({PARTS})) AS part))""",
             f"""c0 AS MATERIALIZED (
  SELECT p.part, f.entry, p.w FROM p JOIN (
    SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, w) - 1 AS entry FROM v) f USING (rid) WHERE f.entry < {ENTRIES})"""]
    for t in range(ROUNDS + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
  SELECT p.rid, p.part, any_value(p.w) AS w, min({{'away': {away}, 'entry': c.entry}}) AS best
  FROM p JOIN c{t} c ON p.part = c.part GROUP BY p.rid, p.part)""")
        if t < ROUNDS:
            parts.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.w, c.w) AS w FROM c{t} c LEFT JOIN (
    SELECT part, entry, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY pos) AS w FROM (
      SELECT part, best.entry AS entry, pos, sum(w[pos]) AS s, count(*) AS n
      FROM a{t}, (SELECT unnest(range(1, (SELECT max(len(w)) FROM p) + 1)) AS pos) GROUP BY ALL) GROUP BY part, entry) m
  ON c.part = m.part AND c.entry = m.entry)""")
    return f"""WITH {", ".join(parts)},
e AS (SELECT rid, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.away) AS BIGINT) AS error
      FROM a{ROUNDS} GROUP BY rid)
SELECT v.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM v JOIN e USING (rid)"""


OP12_SQL = _sql()
