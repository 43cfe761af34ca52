"""N-gram Jaccard join by a grouped prefix join, and its classes.

A document's set is its distinct 5-word shingles (words: runs of bytes other
than space and tab to carriage return, A-Z lower-cased; a text of fewer words is
one shingle; a text without words has none and links with nothing). Documents
link when 100 * intersection >= 80 * union; a class is what links connect.
Shingles and equal sets are told apart by 64-bit hashes (sets also by their
sizes where they are collapsed).

1. Classes of equal sets are collapsed; all later steps see each set once.
2. Screen. In the order of their hashes, the first a(n) = n - ceil(0.8 n) + l(n)
   shingles of two linked sets share at least l of the smaller one, with
   l(n) = floor(f n) + 1. A set with fewer shared shingles than that in its
   first a(n) can have no partner and drops out (f = 0.1).
3. Prefix join. For the sets left, the first a(n) shingles with f = 0.3 are put in
   order of their frequency, rarest first. Linked sets share one of the first
   a(n) - l + 1; those of frequency 1 need no posting. These are the prefix.
4. Grouping. Sets of equal prefix and size form one group. Postings are kept for
   groups only; pairs of groups that share a prefix shingle, pass the size and
   bitmap filters and aren't wholly in one class yet are expanded into their
   members, which are verified exactly.
5. Copies of one text would give all pairs of their prefix's posting list.
   Since classes, not pairs, are the result, members of a class need no more
   comparisons: first every member is compared with the first of its group, and
   every group's first with one of each of its posting lists, twice; only then are
   all pairs of groups taken that share a prefix shingle, and of their members
   those that are still in different classes.
   Pairs are tested inside the join by parity bitmaps: the shingles that only
   one of two sets has are at least the bits in which their bitmaps differ, and
   linked sets have at most (n + n') / 9 of them. Only what passes is
   joined with the sets themselves.

Steps 2 to 5 are exact for any data: no list is cut, and no pair that could link
is left out but those already known to be in one class. Frequent shingles:
the screen sends each of them once per 400,000 shingles; counts, least labels and
the like combine before they are shuffled and are written before they are
joined, so that Spark can broadcast them or split a hot key's rows.

Edge cases: null and empty texts have n_shingles 0 and their own doc_id as
component; repeated rows (same id or same text) are documents like others; a
null doc_id never names a component unless all its class has null; an empty
table gives no rows; other columns are ignored by ``near_duplicates`` and kept
by ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risklens.llm.tables import bound_batches, free_name, load, texts, written
from risklens.llm.words import Slice, mix64, slices

SHINGLE = 5
#: Percent of the union; fixed by the contract.
LEAST = 80
#: Longs of a set's parity bitmap.
BITMAP = 16
SCREEN_TENTHS, PREFIX_TENTHS = 1, 3

#: Shingles that a task of the screen holds at a time.
SCREEN_HELD = 400_000

#: Rows up to which lists of (id, class) are broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_U = np.uint64
_PLACE = mix64(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | _U(1)
_ID_BITS = (1 << 40) - 1


def shingle_sets(s: Slice) -> list[np.ndarray]:
    """Ascending hashes of each row's distinct shingles."""
    starts, ends, rows = s.words()
    words = s.hashes(starts, ends)
    n = max(0, len(words) - SHINGLE + 1)
    grams = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        grams += words[i:i + n] * _PLACE[i]
    grams = mix64(grams)
    out = []
    for lo, hi in zip(rows[:-1], rows[1:]):
        if hi - lo >= SHINGLE:
            out.append(np.unique(grams[lo:hi - SHINGLE + 1]))
        elif hi > lo:
            out.append(mix64((words[lo:hi] * _PLACE[:hi - lo]).sum(keepdims=True) + _U(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _class_id(shingles: np.ndarray) -> int:
    """A set's 64-bit name, from two sums over its shingles and its size."""
    a, b = mix64(shingles ^ _U(0x5BD1E995)).sum(dtype=np.uint64), (shingles * _U(0x9E3779B97F4A7C15) ^ (shingles >> _U(29))).sum(dtype=np.uint64)
    return int(mix64(np.array([mix64(np.array([a]))[0] ^ b + _U(len(shingles))]))[0].view(np.int64))


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    """For each of 64 * BITMAP cells, whether an odd number of shingles falls into it."""
    odd = np.bincount((shingles & _U(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _first(n, tenths: int):
    """a(n)."""
    return n - (4 * n + 4) // 5 + n * tenths // 10 + 1


_BITS = [f"b{k}" for k in range(BITMAP)]


def _columns(bitmaps: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([int(b[k]) for b in bitmaps], pa.int64()) for k in range(BITMAP)]


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, cid, n``: the name and size of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                sets = shingle_sets(s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, s.rows), batch.column("text_hash").slice(s.first, s.rows),
                     pa.array([_class_id(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64())],
                    names=["doc_id", "text_hash", "cid", "n"])

    return texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, cid long, n long")


def _screen_rows(docs: DataFrame) -> DataFrame:
    """``s, id, c``: a shingle of the first a(n) of set ``id``; id -1 instead of the
    sets if several of those at hand have it. They are counted at once: a row
    with c > 0 says that ``id`` has c such shingles."""

    def counted(sh: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(sh, kind="stable")
        sh, ids = sh[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], sh[1:] != sh[:-1]])) if len(sh) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(sh)))
        several = np.repeat(size > 1, size)
        own, c = np.unique(ids[several], return_counts=True)
        marker = first[size > 1]
        out_s = np.concatenate([sh[~several], sh[marker], mix64(own.astype(np.uint64) + _U(len(sh)))])
        out_id = np.concatenate([ids[~several], np.full(len(marker), -1), own])
        out_c = np.concatenate([np.zeros(len(out_s) - len(c), np.int32), c.astype(np.int32)])
        for lo in range(0, len(out_s), 100_000):
            at = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(out_s[at].view(np.int64)), pa.array(out_id[at]), pa.array(out_c[at])],
                                             names=["s", "id", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, s_parts, id_parts, held = set(), [], [], 0
        for batch in batches:
            for s in slices(batch.column("text")):
                for x in shingle_sets(s):
                    if len(x) and (cid := _class_id(x)) not in known:
                        known.add(cid)
                        own = x[:_first(len(x), SCREEN_TENTHS)].copy()
                        s_parts.append(own)
                        id_parts.append(np.full(len(own), cid & _ID_BITS, np.int64))
                        held += len(own)
                if held > SCREEN_HELD:
                    yield from counted(np.concatenate(s_parts), np.concatenate(id_parts))
                    known, s_parts, id_parts, held = set(), [], [], 0
        if held:
            yield from counted(np.concatenate(s_parts), np.concatenate(id_parts))

    return texts(docs).select("text").mapInArrow(run, "s long, id long, c int")


def screened(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes (``cid, n, first``) that may have a partner."""
    of_shingle = Window.partitionBy("s")
    shared = (_screen_rows(docs)
              .withColumn("lo", F.min("id").over(of_shingle)).withColumn("hi", F.max("id").over(of_shingle))
              .where((F.col("id") >= 0) & ((F.col("c") > 0) | (F.col("lo") != F.col("hi"))))
              .groupBy("id").agg(F.sum(F.when(F.col("c") > 0, F.col("c")).otherwise(1)).alias("shared")))
    need = F.expr(f"floor(floor((4 * n + 4) / 5) * {SCREEN_TENTHS} / 10) + 1")
    return (classes.where("n > 0").withColumn("id", F.col("cid").bitwiseAND(F.lit(_ID_BITS)))
            .join(shared, "id").where(F.col("shared") >= need).select("cid", "n", "first"))


def sets_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``cid, n, bits, shingles`` of the chosen classes, from the rows whose id
    and text's hash ``first`` gives: rows of one id meet no more than their own class."""
    names = chosen.select("first", F.col("first.text_hash").alias("want_hash"), F.col("cid").alias("want"))
    small = chosen.count() <= BROADCAST_ROWS
    found = texts(docs).join(F.broadcast(names) if small else names,
                             (F.xxhash64("text") == F.col("want_hash")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, seen = batch.column("want").to_pylist(), set()
            for s in slices(batch.column("text")):
                got = [(cid, x) for i, x in enumerate(shingle_sets(s)) if (cid := _class_id(x)) == want[s.first + i]]
                got = [(cid, x) for cid, x in got if not (cid in seen or seen.add(cid))]
                cut = np.concatenate([[0], np.cumsum([len(x) for _, x in got])]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.uint64), *(x for _, x in got)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in got], pa.int64()), pa.array(np.diff(cut).astype(np.int64)),
                     *_columns([_bitmap(x) for _, x in got]),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(values))], names=["cid", "n", *_BITS, "shingles"])

    schema = ", ".join(f"{b} long" for b in _BITS)
    return (found.select("text", "want").mapInArrow(run, f"cid long, n long, {schema}, shingles array<long>")
            .select("cid", "n", F.struct(*_BITS).alias("bits"), "shingles"))


def prefixes(sets: DataFrame) -> DataFrame:
    """``cid, n, prefix``: the shared shingles among the first a(n) - l + 1 by frequency."""
    length = F.expr(f"n - floor((4 * n + 4) / 5) + floor(n * {PREFIX_TENTHS} / 10) + 1").cast("int")
    spare = F.expr(f"floor(floor((4 * n + 4) / 5) * {PREFIX_TENTHS} / 10) + 1")
    postings = sets.select("cid", "n", F.explode(F.slice("shingles", F.lit(1), length)).alias("s"))
    often = written(postings.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    shared = postings.join(often, "s")
    by_set = Window.partitionBy("cid", "n")
    rank = F.row_number().over(by_set.orderBy("df", "s"))
    # the a(n) - shared shingles of frequency 1 come first
    return (shared.withColumn("m", F.count("*").over(by_set)).withColumn("rank", rank)
            .where(F.col("rank") <= F.col("m") - spare + 1)
            .groupBy("cid", "n").agg(F.sort_array(F.collect_set("s")).alias("prefix")))


def _may_link(a: str, b: str) -> Column:
    """Size and bitmap filters on two sides' columns ``n`` and ``bits`` with the given suffixes."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    differ = sum((F.bit_count(F.col(f"bits{a}.{k}").bitwiseXOR(F.col(f"bits{b}.{k}"))) for k in _BITS), F.lit(0))
    return (100 * F.least(n, m) >= LEAST * F.greatest(n, m)) & (9 * differ <= n + m)


def _as(df: DataFrame, suffix: str, *keep: str) -> DataFrame:
    return df.select(*keep, *(F.col(c).alias(c + suffix) for c in df.columns if c not in keep))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones among ``a, b`` pairs of classes."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * both >= LEAST * (F.size("x") + F.size("y") - both)).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """``cid, label``: the least class that links connect each linked class with,
    by alternating large and small stars; a class's neighbours are never gathered."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "stars")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = (small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
                 .distinct())
        edges = written(small, "stars")
        # done when every class hangs on one other, which hangs on none
        ends = edges.groupBy("u").agg(F.count("*").alias("n"), F.lit(0).alias("root"))
        roots = edges.select(F.col("v").alias("u"), F.lit(0).alias("n"), F.lit(1).alias("root")).distinct()
        left = ends.unionAll(roots).groupBy("u").agg(F.sum("n").alias("n"), F.sum("root").alias("root")).where("n + root > 1")
        if not left.head(1):
            return edges.select(F.col("u").alias("cid"), F.col("v").alias("label"))


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members with the ``label`` of the class that the links found so far give them."""
    found = components(links)
    return written(members.join(found, "cid", "left").withColumn("label", F.coalesce("label", "cid")), "labels")


def _with_one(lists: DataFrame, turn: int) -> DataFrame:
    """Every entry of a posting list with one entry of the list, if their labels differ."""
    one = written(lists.groupBy("s").agg(F.min(F.struct(F.xxhash64("cid", F.lit(turn)).alias("turn"), "cid", "n", "bits", "label")).alias("p"))
                  .select("s", "p.*").drop("turn"), "one-of-each-list")
    return _as(lists, "_b", "s").join(_as(one, "_a", "s"), "s").where(F.col("label_a") != F.col("label_b"))


def _pairs(joined: DataFrame) -> DataFrame:
    """``a, b`` of the joined entries that may link."""
    return joined.where(_may_link("_a", "_b")).select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b"))


def links_of(sets: DataFrame) -> DataFrame:
    """``a, b``: links between sets that connect every class of linked sets."""
    prefixed = written(prefixes(sets).withColumn("gid", F.xxhash64("n", "prefix")), "prefixes")
    members = written(prefixed.select("cid", "gid").join(sets.select("cid", "n", "bits"), "cid"), "members")
    postings = written(prefixed.select("gid", F.explode("prefix").alias("s")).distinct(), "postings")
    # each member with the first of its group, and each group's first with one of the list's
    first = written(members.groupBy("gid").agg(F.min(F.struct("cid", "n", "bits")).alias("f")).select("gid", "f.*"), "groups")
    inside = _as(members, "_b", "gid").join(_as(first, "_a", "gid"), "gid")
    across = _with_one(postings.join(first.withColumn("label", F.col("cid")), "gid").drop("gid"), 0)
    pairs = _pairs(inside.where(F.col("cid_a") != F.col("cid_b"))).unionAll(_pairs(across))
    links = written(verified(pairs.distinct(), sets), "links")
    # once more, by what is in different classes now, with another member of each list
    units = (_labelled(members, links).groupBy("gid", "label").agg(F.min(F.struct("cid", "n", "bits")).alias("u"))
             .select("gid", "label", "u.*"))
    again = _with_one(postings.join(units, "gid").drop("gid"), 1)
    links = written(links.unionAll(verified(_pairs(again).distinct(), sets)), "links")
    # the rest: all pairs of groups that aren't wholly in one class
    return written(links.unionAll(verified(_pairs(_members_of_group_pairs(postings, _labelled(members, links))).distinct(), sets)), "links")


def _groups(members: DataFrame) -> DataFrame:
    """``gid, n, lo, hi, all, any`` of ``members``: a group's size, least and
    largest label, and its members' bitmaps combined by AND and by OR."""
    combined = [F.struct(*[f(F.col(f"bits.{k}")).alias(k) for k in _BITS]).alias(name) for name, f in (("all", F.bit_and), ("any", F.bit_or))]
    return members.groupBy("gid").agg(F.first("n").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), *combined)


def _groups_may_link() -> Column:
    """Size and bitmap filters on two groups: a bit that all members of one have
    and none of the other differs in every pair of members. For groups of one
    member each this is ``_may_link``."""
    n, m = F.col("n_a"), F.col("n_b")

    def beyond(a: str, b: str, k: str) -> Column:
        return F.col(f"all_{a}.{k}").bitwiseAND(F.bitwise_not(F.col(f"any_{b}.{k}")))

    differ = sum((F.bit_count(beyond("a", "b", k).bitwiseOR(beyond("b", "a", k))) for k in _BITS), F.lit(0))
    return (100 * F.least(n, m) >= LEAST * F.greatest(n, m)) & (9 * differ <= n + m)


def _members_of_group_pairs(postings: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of members of different labels whose groups share a posting list and
    pass the filters. Of a list, groups that lie wholly in its largest class
    aren't paired with each other."""
    lists = postings.join(written(_groups(members), "group-labels"), "gid")
    one_class = F.col("lo") == F.col("hi")
    by_label = lists.groupBy("s", F.when(one_class, F.col("lo")).alias("label")).agg(F.count("*").alias("size"))
    largest = written(by_label.groupBy("s").agg(F.max(F.when(F.col("label").isNotNull(), F.struct("size", "label"))).alias("top"),
                                                F.count("*").alias("labels"), F.max(F.col("label").isNull()).alias("mixed"))
                      .where("labels > 1 or mixed").select("s", F.col("top.label").alias("most")), "largest-labels")
    open_lists = written(lists.join(largest, "s").withColumn("top", one_class & F.col("lo").eqNullSafe(F.col("most"))).drop("most"), "open-lists")
    same_class = (F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b"))
    pairs = (_as(open_lists.where("not top"), "_a", "s").join(_as(open_lists, "_b", "s"), "s")
             .where((F.col("top_b") | (F.col("gid_a") <= F.col("gid_b"))) & ~same_class & _groups_may_link())
             .select("gid_a", "gid_b").distinct())
    pairs = written(pairs, "group-pairs")
    return (pairs.join(_as(members, "_a"), "gid_a").join(_as(members, "_b"), "gid_b")
            .where((F.col("label_a") != F.col("label_b")) & ((F.col("gid_a") != F.col("gid_b")) | (F.col("cid_a") < F.col("cid_b")))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, cid, label, n_shingles, component_id`` of every row; ``cid`` names
    its set, ``label`` its class."""
    own = written(sizes(docs), "set-sizes")
    # the least id: a null one only where all are
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    classes = written(own.groupBy("cid", "n").agg(first.alias("first")), "classes")
    chosen = written(screened(docs, classes), "screened")
    sets = written(sets_of(docs, chosen), "sets")
    labels = components(links_of(sets))
    joined = classes.where("n > 0").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = written(joined.groupBy("label").agg(F.min("first.doc_id").alias("component_id")), "components")
    linked = joined.join(least, "label").select("cid", "label", "component_id")
    return (own.join(linked, "cid", "left")
            .select("doc_id", "cid", "label", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def _with_names(docs: DataFrame, column: str) -> DataFrame:
    """Add each row's ``cid``."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(at)):
                rows = batch.slice(s.first, s.rows)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([_class_id(x) for x in shingle_sets(s)], pa.int64())],
                                                 names=[*rows.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())]))


def _listed(docs: DataFrame, rows: DataFrame, name: str, how: str) -> DataFrame:
    """Join the rows of ``docs`` to a list of ``doc_id, cid``."""
    own = free_name("listed", docs)
    rows = written(rows.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), "cid").alias(own)), "listed")
    small = rows.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(rows) if small else rows,
                     F.col("doc_id").eqNullSafe(F.col(f"{own}.doc_id")) & (F.col(name) == F.col(f"{own}.cid")), how)


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their
    class (by doc_id, null first, then set; then text, among rows of equal id
    and set). Texts without words all stay."""
    found = written(near_duplicates(docs).where("n_shingles > 0").groupBy("label", "doc_id", "cid").agg(F.count("*").alias("rows")), "classes")
    first = written(found.groupBy("label").agg(F.min(F.struct("doc_id", "cid")).alias("first")), "firsts")
    marked = found.join(first, "label").withColumn("is_first", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("cid") == F.col("first.cid")))
    name, rank = free_name("set_name", docs), free_name("set_rank", docs)
    named = _with_names(docs, name)
    repeated = marked.where("is_first and rows > 1")
    kept = _listed(named, marked.where("not is_first or rows > 1"), name, "left_anti").drop(name)
    if not repeated.head(1):
        return kept
    order = Window.partitionBy("doc_id", name).orderBy("text")
    return kept.unionByName(_listed(named, repeated, name, "left_semi").withColumn(rank, F.row_number().over(order))
                            .where(F.col(rank) == 1).drop(name, rank))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).drop("cid", "label")


OP4_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS MATERIALIZED (SELECT x.rid AS a, y.rid AS b, count(*) AS common FROM g x JOIN g y ON x.s = y.s AND x.rid <> y.rid GROUP BY ALL),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.rid = p.a JOIN n y ON y.rid = p.b WHERE 100 * common >= 80 * (x.n + y.n - common)),
c(rid, other) AS (SELECT rid, rid FROM d UNION SELECT c.rid, l.b FROM c JOIN l ON l.a = c.other),
m AS MATERIALIZED (SELECT c.rid, min(d.doc_id) AS component_id FROM c JOIN d ON d.rid = c.other GROUP BY c.rid)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d JOIN m USING (rid) LEFT JOIN n USING (rid)
"""
