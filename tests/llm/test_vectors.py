import random

import duckdb
import pytest

from risklens.llm import vectors

NAN, INF = float("nan"), float("inf")


def brute(rows, k, is_query):
    import math

    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if is_query(q):
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("blocks", [(2, 3), (512, 8192)])
def test_equals_brute_force(spark, blocks):
    r = random.Random(1)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 0.25]) for _ in range(4)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [NAN, 0.0, 0.0, 0.0]), (63, [INF, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (64, []), (65, [0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    import numpy as np

    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    v = vectors.quantised(df.selectExpr("*", "vec_id as id", "1 as weights"), "vec_id", "embedding")
    got = vectors.top_k(v.where("id % 7 = 0"), v, 5, *blocks)
    assert {tuple(x) for x in got.collect()} == brute(rows, 5, lambda i: i % 7 == 0)


def test_empty(spark):
    v = vectors.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert vectors.top_k(v, v, 3).count() == 0


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
        want = c.sql(f"select query_id, rank, vec_id, score from ({vectors.OP7_SQL})").fetchall()
    assert sorted(map(tuple, vectors.op7_exact_topk(spark, d).collect())) == sorted(want)
