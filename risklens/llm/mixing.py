"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of the mix's words, held below a
multiple of its own words (the excess goes to the other sources by weight). A
source with target/size = whole + part gets ``whole`` certain copies of every document.

For the rest, a document has an inclusion probability pi of its own, in
proportion to its size: pi = scale * size, the scale being such that the words
expected of the sample are those that the target still lacks. Documents whose pi
would reach 1 are certain, and the scale follows from the others alone. A
document is ranked by its random odds over its inclusion odds,
(u / (1 - u)) / (pi / (1 - pi)), u being uniform and fixed by the document
(certain ones: 0), and the documents of lowest rank are taken until their words
come nearest to what the target lacks: a sample of fixed size in words.

No source is ever sorted as a whole: scales come from a table of the different
sizes of a source; words are summed by (source, slice of the rank), the slice
holding the cut is found from these sums, and only its documents, about one in
65,536 of a source, are put in order. Tables with a row per source, or per
source and size, are the largest that one task sees whole.

Edge cases: a null or empty text has size 0 and takes 0 words; null is a source
of its own, last in order; repeated rows (same id and text) are taken or left
together; an empty table gives an empty mix; a column of the input named like
one of the operator's own is read but never overwritten in ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklens.llm.tables import free_name, join_small, load, written

WEIGHTS = (3, 1, 2)
SHARE, MOST_COPIES = 1.5, 2
SLICES = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
_U_RANGE = float(1 << 52)


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The document's random number as an integer below 2**52, the same in every run."""
    own = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"),
                   F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
            most: float = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    With the sources in order of cap / weight, the level (words per unit of
    weight) that fills the mix when all earlier sources are capped rises up to
    the first source that isn't, and falls after it: its maximum is the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    of_rank = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    level = ((share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(rest))
    return (sizes.withColumn("place", F.row_number().over(by_name) - 1)
            .withColumn("weight", of_rank)
            .withColumn("cap", most * F.col("source_size").cast("double"))
            .withColumn("level", level)
            .withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
            .select("source", "source_size", "target"))


def scales(sizes: DataFrame) -> DataFrame:
    """``source, scale`` of ``source, size, held, need`` (documents of each
    size, and words wanted of the source): pi = least(1, scale * size).

    The m largest sizes are certain for the least m with scale * size < 1 for
    the next one, the scale being (need - words of the certain) / (sum of
    squared sizes of the others)."""
    words = F.col("size") * F.col("held")
    # sums of squares can exceed 64 bits
    squares = F.col("size").cast("decimal(20,0)") * words.cast("decimal(18,0)")
    larger = Window.partitionBy("source").orderBy(F.desc("size"))
    before = larger.rowsBetween(Window.unboundedPreceding, -1)
    from_here = larger.rowsBetween(0, Window.unboundedFollowing)
    scale = ((F.col("need") - F.coalesce(F.sum(words).over(before), F.lit(0)).cast("double"))
             / F.sum(squares).over(from_here).cast("double"))
    return (sizes.where(F.col("size") > 0).withColumn("scale", scale).where(F.col("scale") * F.col("size") < 1)
            .groupBy("source").agg(F.max_by("scale", "size").alias("scale")))


def pareto_rank(u: Column, pi: Column) -> Column:
    """Random odds over inclusion odds: 0 where inclusion is certain, no bound where nothing is to be included."""
    x = (u + 0.5) / _U_RANGE
    return (F.when(pi >= 1, F.lit(0.0)).when(pi > 0, (x / (1 - x)) / (pi / (1 - pi)))
            .otherwise(F.lit(float("inf"))))


def _rank() -> Column:
    """Of a row with size, u and its source's need and scale (null: all documents are certain)."""
    pi = F.when(F.col("need") > 0, F.coalesce(F.col("scale") * F.col("size"), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.when(F.col("size") > 0, pareto_rank(F.col("u"), pi)).otherwise(F.lit(float("inf")))


def plan(sized: DataFrame, **mix) -> DataFrame:
    """``source, source_size, target, whole, need, scale, cut``: every document of
    the source is taken ``whole`` times, and once more if its (rank, u) is at most
    ``cut`` (null: none). ``sized``: source, size, u of each document."""
    sizes = written(sized.groupBy("source", "size").agg(F.count("*").alias("held")), "mix-counts")
    goal = (targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("held")).alias("source_size")), **mix)
            .withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long"))
            .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    needs = goal.select(F.col("source").alias("n_source"), "need")
    scaled = scales(sizes.join(needs, F.col("source").eqNullSafe(F.col("n_source")))
                    .where(F.col("need") > 0).select("source", "size", "held", "need"))
    goal = written(goal.join(scaled.withColumnRenamed("source", "s_source"), F.col("source").eqNullSafe(F.col("s_source")), "left")
                   .drop("s_source"), "mix-targets")
    goals = goal.select(F.col("source").alias("s_source"), "need", "scale")
    ranked = (join_small(sized, goals, F.col("source").eqNullSafe(F.col("s_source")), "inner")
              .where((F.col("need") > 0) & (F.col("size") > 0)).withColumn("rank", _rank())
              .withColumn("slice", F.floor(F.col("rank") / (1 + F.col("rank")) * SLICES).cast("int")))
    up_to = Window.partitionBy("source").orderBy("slice")
    sums = ranked.groupBy("source", "slice", "need").agg(F.sum("size").alias("words"))
    cutting = written(
        sums.withColumn("ahead", F.sum("words").over(up_to) - F.col("words"))
        .where((F.col("ahead") < F.col("need")) & (F.col("ahead") + F.col("words") >= F.col("need")))
        .groupBy("source").agg(F.min(F.struct("slice", "ahead")).alias("at"))
        .select(F.col("source").alias("c_source"), "at.slice", "at.ahead")
        .withColumnRenamed("slice", "c_slice"), "mix-slices")
    inside = join_small(ranked, cutting, F.col("source").eqNullSafe(F.col("c_source"))
                        & (F.col("slice") == F.col("c_slice")), "inner")
    # rows of the same rank and u are one step, so that repeated rows stay together
    steps = inside.groupBy("source", "rank", "u", "need", "ahead").agg(F.sum("size").alias("words"))
    by_rank = Window.partitionBy("source").orderBy("rank", "u")
    taken = steps.withColumn("words", F.col("ahead") + F.sum("words").over(by_rank))
    # either side of the cut: the documents before the slice, or up to one inside it
    first = F.struct("rank", "u")
    nearest = taken.groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("words") - F.col("need")).alias("off"), -F.col("words"), first.alias("at"))).alias("best"),
        F.min(F.struct((F.col("need") - F.col("ahead")).alias("off"), first.alias("at"))).alias("none"))
    at = F.when(F.col("best.off") <= F.col("none.off"), F.col("best.at")).otherwise(
        F.struct(F.col("none.at.rank").alias("rank"), (F.col("none.at.u") - 1).alias("u")))
    cuts = nearest.select(F.col("source").alias("k_source"), at.alias("cut"))
    return written(goal.join(cuts, F.col("source").eqNullSafe(F.col("k_source")), "left").drop("k_source"), "mix-plan")


def _copies() -> Column:
    """Times that a row with its source's rule is taken."""
    rank, cut = _rank(), F.col("cut")
    more = (rank < cut["rank"]) | ((rank == cut["rank"]) & (F.col("u") <= cut["u"]))
    return F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words().alias("size"), uniform().alias("u"))


def mix_words(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    sized = written(_sized(docs), "mix-sizes")
    rule = plan(sized.select("source", "size", "u")).withColumnRenamed("source", "p_source")
    return (join_small(sized, rule, F.col("source").eqNullSafe(F.col("p_source")), "inner")
            .select("doc_id", "size", "source_size", "target", (_copies() * F.col("size")).alias("taken")))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    row, copy = (free_name(x, docs) for x in ("mix_row", "mix_copy"))
    rules = plan(written(_sized(docs).select("source", "size", "u"), "mix-sizes"))
    keyed = docs.select(F.struct(*docs.columns).alias(row), F.col("source").alias("d_source"), n_words().alias("size"), uniform().alias("u"))
    return (join_small(keyed, rules, F.col("d_source").eqNullSafe(F.col("source")), "inner")
            .select(row, F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(_copies(), F.lit(1)))).alias(copy), _copies().alias("mix_taken"))
            .where(F.col("mix_taken") > 0).select(f"{row}.*"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_words(load(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CAST([3, 1, 2][CAST(place % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight, 2 * CAST(source_size AS DOUBLE) AS cap FROM p),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
n AS (SELECT *, target - whole * source_size AS need FROM g),
h AS (SELECT d.source, n.need, d.size, count(*) AS held FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
      WHERE n.need > 0 AND d.size > 0 GROUP BY ALL),
f AS (SELECT *, (need - CAST(coalesce(sum(size * held) OVER (PARTITION BY source ORDER BY size DESC
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
                / CAST(sum(size::HUGEINT * size * held) OVER (PARTITION BY source ORDER BY size DESC
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS scale FROM h),
e AS (SELECT source, arg_max(scale, size) AS scale FROM f WHERE scale * size < 1 GROUP BY source),
i AS (SELECT d.*, n.source_size, n.target, n.whole, n.need, (u + 0.5::DOUBLE) / 4503599627370496 AS x,
             CASE WHEN n.need > 0 AND d.size > 0 THEN coalesce(e.scale * d.size, 1.0::DOUBLE) ELSE 0 END AS pi
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source),
r AS (SELECT *, CASE WHEN pi >= 1 THEN 0 WHEN pi > 0 THEN (x / (1 - x)) / (pi / (1 - pi)) ELSE 'infinity'::DOUBLE END AS rank FROM i),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, u) AS words FROM r),
k AS (SELECT source, min({'off': abs(words - need), 'words': -words, 'rank': rank, 'u': u}) AS best
      FROM c WHERE pi > 0 GROUP BY source, need HAVING min(abs(words - need)) <= need),
z AS (SELECT c.*, coalesce(rank < best.rank OR (rank = best.rank AND u <= best.u), false) AS more
      FROM c LEFT JOIN k ON c.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN more THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM z
"""
