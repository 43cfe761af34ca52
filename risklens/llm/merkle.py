"""Merkle manifest of a dataset by nested-struct rollup.

Every row is a leaf; a source's leaves, in order of id, form a tree of arity 3,
and the sources' roots form the tree above. H is the lowercase hex sha256.

A leaf's rank in its source, written in base 3, names its place on every level.
A block is the leaves that share all but the lowest ``DIGITS`` digits: 729 of
them at most. Inside a block the digit columns are grouped away one after the
other, lowest first; each grouping nests the (at most 3) child structs into
their parent's struct, which holds their digest. All groupings of a block run
in one stage, because rows were dealt by block before. What remains is one
nested row a block; the blocks' digests are the leaves of the next tier, until
every source has one block. Proofs go down the same way: in each block a
transform per digit turns a struct into its children, each with its siblings'
digests put before its parent's path, and one explode emits the nodes. No join
takes part: a tier's paths meet the blocks below in a union grouped by block.

Ranks come without sorting a source in one task: leaves are range-partitioned
by source and id, numbered inside their partition, and the partitions' sizes
are summed up per source. Only digests and ids are ever shuffled, never texts.

Edge cases: a null source is a source, first in order; null ids come first in
their source; rows of equal ids stand in order of their leaves (equal leaves
are interchangeable); a null or empty text is a leaf like any other; a source
of one row has that leaf as its root, and a table of one source that root as
its root (the proof then hashes nothing); an empty table gives no rows; other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklens.llm.tables import join_small, load, written

ARITY = 3
#: Digits of a rank that are grouped away inside one block: 3**6 = 729 nodes.
DIGITS = 6

_PATH = "array<struct<left: string, right: string>>"


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def field(col: str | Column) -> Column:
    """A value as part of a leaf: ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return digest(F.concat(field("doc_id"), field("source"), field("lang"), field("n_chars"), field(text)))


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0, by ``order``) in their ``group`` and the group's size ``n``."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                     .withColumn("pos", F.monotonically_increasing_id()), name)
    part = F.shiftright("pos", 33)  # an id's upper bits are its partition
    ends = placed.groupBy(F.col(group).alias("e_group"), part.alias("e_part")).agg(
        F.min("pos").alias("first"), F.count("*").alias("held"))
    of_group = Window.partitionBy("e_group")
    before = of_group.orderBy("e_part").rowsBetween(Window.unboundedPreceding, -1)
    base = written(ends.select("e_group", "e_part", "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"),
                               F.sum("held").over(of_group).alias("n")), f"{name}-parts")
    return (join_small(placed, base, F.col(group).eqNullSafe(F.col("e_group")) & (part == F.col("e_part")), "inner")
            .withColumn("rank", F.col("pos") - F.col("first") + F.col("ahead"))
            .drop("pos", "e_group", "e_part", "first", "ahead"))


def roll_up(nodes: DataFrame, tier: int) -> DataFrame:
    """``grp, n, block, node`` of ``grp, n, rank, h, item``: one nested struct
    (``d, h, kids``) a block, its digits grouped away one by one."""
    digit = lambda j: F.pmod(F.expr(f"rank div {ARITY ** j}"), F.lit(ARITY)).cast("int")
    names = [f"d{j}" for j in range(DIGITS)]
    out = (nodes.select("grp", "n", F.expr(f"rank div {ARITY ** DIGITS}").alias("block"),
                        *[digit(j).alias(names[j]) for j in range(DIGITS)], F.struct(digit(0).alias("d"), "h", "item").alias("node"))
           .repartition("grp", "block"))
    for j in range(DIGITS):
        kids = out.groupBy("grp", "n", "block", *names[j + 1:]).agg(F.array_sort(F.collect_list("node")).alias("kids"))
        hashed = F.col("n") > ARITY ** (tier * DIGITS + j)  # else this is the group's one node already
        h = F.when(hashed, digest(F.array_join(F.col("kids.h"), ""))).otherwise(F.col("kids")[0]["h"])
        own = F.col(names[j + 1]) if j + 1 < DIGITS else F.lit(0)
        out = kids.select("grp", "n", "block", *names[j + 1:], F.struct(own.alias("d"), h.alias("h"), "kids").alias("node"))
    return out


def _children(hashed: Column):
    """Function from a ``node, path`` struct to those of its children; without
    ``hashed``, the one child is the node itself and adds no step."""
    def children(parent: Column) -> Column:
        kids, path = parent["node"]["kids"], parent["path"]

        def child(kid: Column, i: Column) -> Column:
            left = F.array_join(F.slice(kids["h"], F.lit(1), i), "")
            right = F.array_join(F.slice(kids["h"], i + 2, F.lit(ARITY)), "")
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            return F.struct(kid.alias("node"), F.when(hashed, F.concat(step, path)).otherwise(path).alias("path"))

        return F.transform(kids, child)

    return children


def go_down(blocks: DataFrame, tier: int) -> DataFrame:
    """``grp, top, h, item, path`` of every node under ``grp, n, node, top,
    path`` rows: a node's path is its siblings' digests, left and right of it,
    level by level up to the root."""
    nodes = F.array(F.struct(F.col("node").alias("node"), F.array().cast(_PATH).alias("path")))
    for j in reversed(range(DIGITS)):
        hashed = F.col("n") > ARITY ** (tier * DIGITS + j)
        nodes = F.flatten(F.transform(nodes, _children(hashed)))
    return (blocks.select("grp", "top", "path", F.explode(nodes).alias("x"))
            .select("grp", "top", "x.node.h", "x.node.item", F.concat("x.path", "path").alias("path")))


def tiers(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Blocks of every tier over ``grp, n, rank, h, item``; in the last one each group has one block."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = []
    while not out or most > ARITY ** (DIGITS * len(out)):
        out.append(written(roll_up(nodes, len(out)), f"{name}-tier"))
        nodes = out[-1].select("grp", "n", F.col("block").alias("rank"), F.col("node.h").alias("h"),
                               F.struct(F.col("block").alias("block")).alias("item"))
    return out


def descend(blocks: list[DataFrame], paths: DataFrame) -> DataFrame:
    """All leaves below ``blocks`` with their paths, given ``grp, block, top, path`` of the uppermost blocks."""
    for tier in reversed(range(len(blocks))):
        below = blocks[tier].select("grp", "block", "n", "node")
        met = (below.unionByName(paths.select("grp", "block", "top", "path"), allowMissingColumns=True)
               .groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "top", "path")]))
        nodes = go_down(met, tier)
        if tier:
            paths = written(nodes.select("grp", F.col("item.block").alias("block"), "top", "path"), "merkle-paths")
    return nodes


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def manifest(leaves: DataFrame) -> DataFrame:
    """``item, leaf, subroot, root, path`` of ``source, doc_id, leaf, item``."""
    own = written(ranked(leaves.select(F.col("source").alias("grp"), "doc_id", F.col("leaf").alias("h"), "item"),
                         "grp", ["doc_id", "h"], "merkle-leaves").drop("doc_id"), "merkle-ranks")
    by_source = tiers(own, "merkle-source")
    subroots = by_source[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("source"), F.col("node.h").alias("h"))
    above = ranked(subroots, "grp", ["source"], "merkle-subroots").select(
        "grp", "n", "rank", "h", F.struct("source").alias("item"))
    over_all = tiers(above, "merkle-root")
    root = over_all[-1].select("grp", "block", F.struct(F.col("node.h").alias("root")).alias("top"), F.array().cast(_PATH).alias("path"))
    sources = descend(over_all, root)
    tops = written(sources.select(F.col("item.source").alias("grp"), F.lit(0).cast("long").alias("block"),
                                  F.struct(F.col("h").alias("subroot"), F.col("top.root").alias("root")).alias("top"), "path"), "merkle-sources")
    return descend(by_source, tops).select("item", F.col("h").alias("leaf"), "top.subroot", "top.root", "path")


def verified(docs: DataFrame, tampered: Column) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``:
    the manifest of ``docs``, and what the proofs say of the texts ``tampered``."""
    text = F.col("text").cast("string")
    # written before they are dealt by range, which reads its input twice: texts are read and hashed once
    leaves = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", text.alias("text"))
                     .select("source", "doc_id", leaf_digest(F.col("text")).alias("leaf"), leaf_digest(tampered).alias("found"))
                     .select("source", "doc_id", "leaf", F.struct("doc_id", F.nullif("found", "leaf").alias("found")).alias("item")), "merkle-digests")
    steps = F.transform("path", lambda s: F.concat(s["left"], s["right"]))
    return (manifest(leaves)
            .select(F.col("item.doc_id").alias("doc_id"), "leaf", "subroot", "root",
                    digest(F.array_join(steps, "")).alias("proof_sha256"),
                    folded(F.coalesce("item.found", "leaf"), F.col("path")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    stripped = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return verified(load(spark, sf_dir, "documents"), stripped)


def _sql(levels: int, top_levels: int) -> str:
    """The same by windows and groups, level by level; each source up to 3**levels rows."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: f"sha256({' || '.join(map(value, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    # crc32: each byte and then eight shifts, marked by -1
    crc = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
      string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
    parts = [f"""t AS MATERIALIZED (SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM documents)""",
             f"t2 AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('changed')} AS found FROM t)",
             """t3 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY source) AS n FROM t2)""",
             "a0 AS MATERIALIZED (SELECT source AS g, i, n, leaf AS h FROM t3)"]

    def up(a: str, count: int) -> None:
        for k in range(count):
            parts.append(f"""{a}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, n,
  CASE WHEN n > {3 ** k} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {a}{k} GROUP BY g, i // 3, n)""")
            parts.append(f"""p{a}{k} AS MATERIALIZED (SELECT g, i, coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h) OVER w, '') AS l,
  coalesce(lead(h) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS r FROM {a}{k} WINDOW w AS (PARTITION BY g, i // 3 ORDER BY i))""")

    def fold(f: str, a: str, count: int) -> None:
        for k in range(count):
            parts.append(f"""{f}{k + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (i, cur, proof), x.i // 3 AS i,
  CASE WHEN n > {3 ** k} THEN sha256(l || cur || r) ELSE cur END AS cur, proof || l || r AS proof
  FROM {f}{k} x JOIN p{a}{k} p ON x.g IS NOT DISTINCT FROM p.g AND x.i = p.i)""")

    up("a", levels)
    parts.append(f"""b0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, g AS source
  FROM a{levels})""")
    up("b", top_levels)
    parts.append("f0 AS MATERIALIZED (SELECT doc_id, leaf, source, source AS g, n, i, found AS cur, '' AS proof FROM t3)")
    fold("f", "a", levels)
    parts.append(f"""q0 AS MATERIALIZED (SELECT f.doc_id, f.leaf, b.h AS subroot, b.g, b.n, b.i, f.cur, f.proof
  FROM f{levels} f JOIN b0 b ON f.source IS NOT DISTINCT FROM b.source)""")
    fold("q", "b", top_levels)
    return f"""WITH {", ".join(parts)}
SELECT q.doc_id, q.leaf, q.subroot, r.h AS root, sha256(q.proof) AS proof_sha256, q.cur AS folded_root, q.cur = r.h AS verified
FROM q{top_levels} q, b{top_levels} r"""


OP13_SQL = _sql(12, 6)
