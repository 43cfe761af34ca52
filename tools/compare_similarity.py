"""Time the similarity-edge operator against the literal nested-loop form.

The nested-loop form is the job's theta self join (a.k != b.k) scoring every
record pair; the operator is the equi join on (length, position, value).
usage: python tools/compare_similarity.py [sf_dir]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from risklens.plans.graph_queries import customers  # noqa: E402
from risklens.operators.graph.build import similarity_edges  # noqa: E402
from risklens.session import build_session  # noqa: E402


def nested_loop(cust):
    a = cust.select(F.col("c_custkey").alias("src"), F.col("a1").alias("x1"), F.col("a2").alias("x2"))
    b = cust.select(F.col("c_custkey").alias("dst"), F.col("a1").alias("y1"), F.col("a2").alias("y2"))
    score = (((F.col("x1") == F.col("y1")) & (F.col("y1") != "")).cast("int")
             + ((F.col("x2") == F.col("y2")) & (F.col("y2") != "")).cast("int")) / 2.0
    return (a.join(b, F.col("src") != F.col("dst"))
            .groupBy("src", "dst").agg(F.max(score).alias("weight"))
            .where(F.col("weight") > 0))


REPS = int(os.environ.get("REPS", "3"))


def timed(df, reps=REPS):
    out = []
    for _ in range(reps + 1):
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - t0)
    return sorted(out[1:])[reps // 2]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=16,
                          conf={"spark.driver.memory": "16g"})
    cust = customers(spark, sf_dir)
    eq = similarity_edges(cust, "c_custkey", ["a1", "a2"])
    nl = nested_loop(cust)
    same = eq.exceptAll(nl).count() == 0 and nl.exceptAll(eq).count() == 0
    print(json.dumps({"sf_dir": sf_dir, "equi_join_sec": round(timed(eq), 3),
                      "nested_loop_sec": round(timed(nl), 3), "identical": same,
                      "edges": eq.count()}))


if __name__ == "__main__":
    main()
