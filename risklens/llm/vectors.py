"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights over terms (its dimensions).
Queries and candidates are dealt into blocks; every pair of a query block and a
candidate block is one group, whose candidates are held as postings by term.
For each term, the weighted postings are added into dense score arrays, one
per query of the block; partition selection then keeps the k best of each
array, and the partial lists of all candidate blocks merge per query.

All arithmetic is on 64-bit integers (it wraps like a long beyond that), so
scores are exact. Ties go to the smaller id; equal ids to each other in no
particular order. A null vector, or one with a null or non-finite component,
takes no part. Vectors of different lengths meet in their common dimensions.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklens.llm.tables import load

#: Rows of a block; a pair of blocks needs about QUERIES * CANDIDATES * 16 bytes while it is scored.
QUERIES, CANDIDATES = 512, 8192


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """``id, weights`` with weights = floor(scale * x); rows that take no part are left out."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return (df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(whole)
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("long")).alias("weights")))


def _dense(weights: pd.Series, width: int) -> np.ndarray:
    """Postings by term: row t holds the weight that each vector gives to term t."""
    out = np.zeros((width, len(weights)), dtype=np.int64)
    for j, w in enumerate(weights):
        out[:len(w), j] = w
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def top_k(queries: DataFrame, candidates: DataFrame, k: int,
          query_rows: int = QUERIES, candidate_rows: int = CANDIDATES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of each query,
    itself excluded; both inputs as ``id, weights`` (see ``quantised``)."""
    n_q = max(1, -(-queries.count() // query_rows))
    n_c = max(1, -(-candidates.count() // candidate_rows))

    def blocks(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        at = F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        return df.select("id", "weights", at.alias(own), every.alias(other))

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(q) and len(c):
            width = min(q["weights"].map(len).max(), c["weights"].map(len).max())
            cut = lambda w: w[:width]
            rows, postings = _dense(q["weights"].map(cut), width), _dense(c["weights"].map(cut), width)
            ids, totals = c["id"].to_numpy(), np.zeros((len(q), len(c)), dtype=np.int64)
            for t in range(width):
                for i in np.flatnonzero(rows[t]):
                    totals[i] += rows[t, i] * postings[t]
            for i, query in enumerate(q["id"].to_numpy()):
                other = np.flatnonzero(ids != query)
                best = other[_best(totals[i, other], ids[other], k)]
                made.append(pd.DataFrame({"query_id": query, "vec_id": ids[best], "score": totals[i, best]}))
        return pd.concat(made) if made else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    left = blocks(queries, "qb", n_q, "cb", n_c).groupBy("qb", "cb")
    right = blocks(candidates, "cb", n_c, "qb", n_q).groupBy("qb", "cb")
    partial = left.cogroup(right).applyInPandas(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors.where(F.col("id") % 100 == 0), vectors, 10)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
