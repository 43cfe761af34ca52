"""Graph construction: similarity and co-occurrence edges, vertices,
strength, blacklist seeds (GR1-GR4, GR7, AG11-AG13, AG17, AG18, J2, J3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklens.operators.joins import shuffled

# Seeded vertices carry this reserved label instead of a real vertex id.
SEED_LABEL = -1


def _key_long(c: str) -> Column:
    """Keys arrive as digit strings or integers; anything else becomes NULL."""
    return F.col(c).cast("string").try_cast("bigint")


def _non_empty(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def distinct_focus(df: DataFrame, key: str, focus: list[str]) -> DataFrame:
    """AG11 / PF5: distinct focus rows among records with a non-empty key."""
    return df.where(_non_empty(key)).select(*focus).distinct()


def _attr_array(attrs: list[str], compat: bool) -> Column:
    if not compat:
        # position by position; NULL counts as empty
        return F.array(*[F.coalesce(F.col(a).cast("string"), F.lit("")) for a in attrs])
    # Literal model of the comma-joined form: NULLs vanish from the join,
    # values holding commas split, trailing empties are dropped, and a
    # string made only of commas has no fields at all.
    joined = F.concat_ws(",", *[F.col(a).cast("string") for a in attrs])
    trimmed = F.regexp_replace(joined, ",+$", "")
    parts = F.split(trimmed, ",", -1)
    only_commas = (joined != "") & (trimmed == "")
    return F.when(only_commas, F.array().cast("array<string>")).otherwise(parts)


def similarity_records(df: DataFrame, key: str, attrs: list[str], compat: bool = False) -> DataFrame:
    """Distinct ``(k, rec, len)``: key and attribute array of every record with a key."""
    if not attrs:
        raise ValueError("need at least one attribute")
    rec = (df.where(_non_empty(key))
           .select(_key_long(key).alias("k"), _attr_array(attrs, compat).alias("rec"))
           .where(F.col("k").isNotNull())
           .distinct())
    return rec.withColumn("len", F.size("rec")).where(F.col("len") > 0)


def similarity_edges(df: DataFrame, key: str, attrs: list[str],
                     compat: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """GR1: weighted edges between records with different keys; with
    ``sources(k)``, those that start at one of these keys.

    weight(a, b) = (number of positions where both records hold the same
    non-empty value) / (number of attributes of a), maximised over the record
    pairs of the two keys; only positive weights are kept and both directions
    are emitted. ``compat=True`` scores the comma-joined form literally
    (lengths must agree).

    Any positive score needs one equal non-empty value in the same position,
    so the all-pairs comparison becomes an equi join on (length, position,
    value) of exploded attributes: the work is proportional to the matching
    pairs, not to n^2. A value shared by many records yields all their pairs
    -- that is this operator's output; where only sums over pairs or classes
    of keys are needed, ``graph.cells`` gets them without pairs. A hot join
    value is split by AQE's skew join. Records are reduced to distinct
    (key, attributes) first (the maximum is unaffected), and a record's
    identity in the pair count is its content, so there is no id to collide
    or to change on recompute.
    """
    rec = similarity_records(df, key, attrs, compat)
    cells = (rec.select("k", "rec", "len", F.posexplode("rec").alias("pos", "value"))
             .where(F.col("value") != ""))
    on = ["len", "pos", "value"]
    held = cells if sources is None else cells.join(sources, on="k", how="left_semi")
    a = held.select(F.col("k").alias("src"), F.col("rec").alias("a_rec"), *on)
    b = cells.select(F.col("k").alias("dst"), F.col("rec").alias("b_rec"), *on)
    pairs = (a.join(shuffled(b), on=on, how="inner")
             .where(F.col("src") != F.col("dst")))
    per_record = (pairs.groupBy("src", "a_rec", "dst", "b_rec", "len")
                  .agg(F.count("*").alias("hits")))
    return (per_record
            .groupBy("src", "dst")
            .agg(F.max(F.col("hits") / F.col("len")).alias("weight"))
            .where(F.col("weight") > 0))


def cooccurrence_edges(df: DataFrame, left: str, right: str,
                       left_offset: int = 0, right_offset: int = 0) -> DataFrame:
    """GR2 / AG13: one edge per (left, right) pair, weight = number of rows.

    Both columns share one vertex-id space; offsets keep kinds apart.
    """
    d = df.where(_non_empty(left) & _non_empty(right))
    return (d.groupBy((_key_long(left) + F.lit(left_offset)).alias("src"),
                      (_key_long(right) + F.lit(right_offset)).alias("dst"))
            .agg(F.count("*").cast("double").alias("weight"))
            .where(F.col("src").isNotNull() & F.col("dst").isNotNull()))


def union_edges(*edge_sets: DataFrame) -> DataFrame:
    """GR3 / SO1: bag union of edge sets (parallel edges are kept)."""
    cols = ["src", "dst", "weight"]
    return reduce(lambda x, y: x.unionByName(y), [e.select(*cols) for e in edge_sets])


def edge_ends(edges: DataFrame) -> DataFrame:
    """``(id, nbr, weight)``: every edge from both of its ends."""
    return (edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), "weight")
            .unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("nbr"), "weight")))


def graph_vertices(edges: DataFrame) -> DataFrame:
    """GR3: vertices are the distinct endpoints of the edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def vertex_strength(edges: DataFrame) -> DataFrame:
    """GR7 / AG17: sum of incident edge weights, both endpoints."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight")
    return ends.groupBy("id").agg(F.sum("weight").alias("degree"))


def total_weight(edges: DataFrame) -> DataFrame:
    """AG18: total edge weight ``m``."""
    return edges.agg(F.sum("weight").alias("total_weight"))


def seed_labels(vertices: DataFrame, records: DataFrame, blacklist: DataFrame,
                key: str, black_key: str) -> tuple[DataFrame, DataFrame]:
    """GR4 / J2 / J3: flag blacklisted vertices.

    Returns ``(labels, counts)``: ``labels(id, label, is_seed)`` with the
    reserved seed label for flagged vertices, and one row
    ``(black_num, seeded)`` -- joined rows (duplicates kept) and flagged
    vertices. The blacklist is joined, not collected, so it may be any size.
    """
    hits = (blacklist.select(F.col(black_key).alias("_bk")).where(F.col("_bk").isNotNull())
            .join(records.select(F.col(black_key).alias("_bk"), _key_long(key).alias("id")),
                  on="_bk", how="inner")
            .select("id"))
    black_ids = hits.where(F.col("id").isNotNull()).distinct().withColumn("is_seed", F.lit(True))
    labels = (vertices.select("id").join(black_ids, on="id", how="left")
              .select("id", F.coalesce("is_seed", F.lit(False)).alias("is_seed"))
              .withColumn("label", F.when(F.col("is_seed"), F.lit(SEED_LABEL))
                          .otherwise(F.col("id"))))
    seeded = labels.agg(F.count_if(F.col("is_seed"))).scalar()
    counts = hits.agg(F.count("*").alias("black_num")).select("black_num", seeded.alias("seeded"))
    return labels.select("id", "label", "is_seed"), counts


def entity_graph(records: DataFrame, key: str, focus: list[str], sim: list[str],
                 cust: str | None = None, compat: bool = False,
                 cust_offset: int = 0, links: DataFrame | None = None) -> DataFrame:
    """CJ7: the weighted entity graph of the fraud job.

    Similarity edges between records with different ``key`` (left side: all
    records with a non-empty key; right side: distinct ``focus`` rows), plus,
    when ``cust`` is given, co-occurrence edges ``cust -> key`` weighted by
    the number of records (rows of ``links``, when the links are kept in a
    table of their own with columns ``cust`` and ``key``). ``focus`` must name
    more than one column and include ``key`` and the ``sim`` attributes.
    """
    if len(focus) <= 1:
        raise ValueError("focus needs more than one column")
    missing = [c for c in [key, *sim] if c not in focus]
    if missing:
        raise ValueError(f"focus must include the key and similarity columns: {missing}")
    # Both sides reduce to distinct (key, sim attributes) of records with a
    # non-empty key, which is what similarity_edges scores.
    edges = similarity_edges(distinct_focus(records, key, focus), key, sim, compat=compat)
    if cust:
        edges = union_edges(edges, cooccurrence_edges(records if links is None else links, cust, key, left_offset=cust_offset))
    return edges
