"""Readers and sinks on fixture tables: each query writes a table in the format in
question to the shared folder and gives what the reader makes of it."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from risklens.operators import rules as RU
from risklens.operators import stats as S
from risklens.plans.access_queries import _GAP_SQL, _events, _gap_stats
from risklens.plans.graph_queries import CO_SQL, _black, co_edges
from risklens.plans.learn_queries import _BASKET_SQL, labelled_points, order_baskets
from risklens.plans.registry import register, rnd, table
from risklens.session import new_table_path
from risklens.sources import readers as IO

# ---------------------------------------------------------------- IO1, 2.8f
# events as JSON lines; some lines are cut off, some have no or no readable timestamp
_LOG_SQL = """lines AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS ip, event_type AS uri, CAST(event_id AS VARCHAR) AS dfp,
         CASE WHEN event_id % 89 = 7 THEN 'soon' WHEN event_id % 83 = 11 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS t,
         CAST(epoch_us(ts) AS VARCHAR) AS ts_us FROM events),
log AS (SELECT *, event_id % 97 = 5 AS cut,
               '{' || array_to_string(list_filter(['"ip":"' || ip || '"', '"uri":"' || uri || '"', '"dfp":"' || dfp || '"',
                                                   '"timestamp":"' || t || '"'], lambda x: x IS NOT NULL), ',') || '}' AS line FROM lines)"""


def log_lines(spark, sf_dir):
    ev, n = _events(spark, sf_dir), F.col("event_id")
    stamp = (F.when(n % 89 == 7, F.lit("soon")).when(n % 83 == 11, F.lit(None))
             .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("ip"), F.col("event_type").alias("uri"),
                              n.cast("string").alias("dfp"), stamp.alias("timestamp")))
    return ev.select(F.when(n % 97 == 5, F.substring(line, 1, 25)).otherwise(line).alias("value"))


@register("json_log_scan", f"""WITH {_LOG_SQL}
SELECT 'good' AS kind, ip, uri, dfp, ts_us, NULL AS line, NULL AS reason FROM log WHERE NOT cut AND t IS NOT NULL AND t <> 'soon'
UNION ALL
SELECT 'rejected', NULL, NULL, NULL, NULL, CASE WHEN cut THEN substr(line, 1, 25) ELSE line END,
       CASE WHEN cut THEN 'malformed' WHEN t IS NULL THEN 'no timestamp' ELSE 'bad timestamp' END
FROM log WHERE cut OR t IS NULL OR t = 'soon'""")
def q_json_log_scan(spark, sf_dir):
    path = new_table_path(spark)
    log_lines(spark, sf_dir).write.text(path)
    good, rejected = IO.scan_access_log(spark, path)
    return (good.select(F.lit("good").alias("kind"), "ip", "uri", "dfp", F.unix_micros(F.col("ts")).cast("string").alias("ts_us"))
            .unionByName(rejected.withColumn("kind", F.lit("rejected")), allowMissingColumns=True)
            .select("kind", "ip", "uri", "dfp", "ts_us", "line", "reason"))


# ---------------------------------------------------------------- IO2, IO3
def _hist_sql(n: int) -> str:
    return f"""SELECT bucket_start, CAST(coalesce(floor((x - lo) / nullif((hi - lo) / {n}.0, 0)), 0) AS BIGINT) AS bin, lo, hi, count(*) AS cnt
  FROM x JOIN b USING (bucket_start) GROUP BY ALL"""


@register("slices_rewritten", f"""
WITH x AS (SELECT bucket_start, round(stdev_gap_ms, 3) AS x FROM ({_GAP_SQL}) g
           WHERE stdev_gap_ms IS NOT NULL AND NOT isnan(stdev_gap_ms)),
     b AS (SELECT bucket_start, min(x) AS lo, max(x) AS hi FROM x GROUP BY bucket_start)
SELECT * FROM ({_hist_sql(100)}) WHERE bucket_start <> (SELECT min(bucket_start) FROM b)
UNION ALL SELECT * FROM ({_hist_sql(10)}) WHERE bucket_start = (SELECT min(bucket_start) FROM b)""")
def q_slices_rewritten(spark, sf_dir):
    """All slices written, then the first one again with other bins."""
    path = new_table_path(spark)
    g = _gap_stats(spark, sf_dir).select("bucket_start", rnd("stdev_gap_ms", 3).alias("x"))

    def slices(n):
        return (S.histogram(g, "x", n=n, by=["bucket_start"])
                .withColumn("slice", F.date_format("bucket_start", "yyyy-MM-dd_HH")))

    IO.write_slices(slices(100), path, ["slice"])
    first = spark.read.parquet(path).agg(F.min("bucket_start")).scalar()
    IO.write_slices(slices(10).where(F.col("bucket_start") == first), path, ["slice"])
    return spark.read.parquet(path).select("bucket_start", "bin", "lo", "hi", "cnt")


# ---------------------------------------------------------------- IO4, J2
def bucketed_hits(spark, sf_dir, buckets: int = 8):
    """Blacklisted orders from two bucketed catalog tables."""
    orders, black = _black(spark, sf_dir)
    run = uuid.uuid4().hex
    names = [f"risklens_orders_{run}", f"risklens_black_{run}"]
    for name, df in zip(names, (orders.select("o_orderkey", "o_custkey"), black)):
        IO.save_bucketed(df, name, new_table_path(spark), "o_orderkey", buckets)
    left, right = (IO.read_table(spark, name) for name in names)
    return left.join(right.hint("merge"), on="o_orderkey")


@register("blacklist_bucketed", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 480000""")
def q_blacklist_bucketed(spark, sf_dir):
    return bucketed_hits(spark, sf_dir).select("o_orderkey", "o_custkey")


# ---------------------------------------------------------------- IO5
@register("libsvm_roundtrip", """
SELECT CASE WHEN label < 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS label, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last,
       round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings""")
def q_libsvm_roundtrip(spark, sf_dir):
    path = new_table_path(spark)
    _, _, points = labelled_points(spark, sf_dir)
    points.select("label", "features").write.format("libsvm").save(path)
    x = F.col("x")
    return (IO.read_libsvm(spark, path).select("label", vector_to_array("features").alias("x"))
            .select("label", x[0].alias("first"), F.element_at(x, -1).alias("last"),
                    F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6).alias("total")))


# ---------------------------------------------------------------- IO6, RU4
@register("baskets_text", f"""WITH {_BASKET_SQL}
SELECT string_agg(item, ',' ORDER BY item) AS items FROM b GROUP BY t""")
def q_baskets_text(spark, sf_dir):
    """One basket a line, with an empty and a repeated item that the reader drops."""
    path = new_table_path(spark)
    line = F.concat(F.array_join("items", ","), F.lit(",,"), F.col("items")[0])
    order_baskets(spark, sf_dir).select(line).write.text(path)
    return IO.read_baskets_text(spark, path).select(RU.items_text("items").alias("items"))


# ---------------------------------------------------------------- IO7
@register("edge_list_text", f"""WITH {CO_SQL}
SELECT src, dst, 1.0::DOUBLE AS weight FROM co""")
def q_edge_list_text(spark, sf_dir):
    path = new_table_path(spark)
    co_edges(spark, sf_dir).select(F.concat_ws(" ", "src", "dst")).write.text(path)
    return IO.read_edge_list(spark, path)


# ---------------------------------------------------------------- AG6, PF9 with error 0
_RANKED_SQL = "list_sort(list({c}::DOUBLE))[greatest(1, ceil(q * count(*)))::BIGINT]"


@register("exact_quantiles", f"""
SELECT q, {_RANKED_SQL.format(c="l_extendedprice")} AS price, {_RANKED_SQL.format(c="l_quantity")} AS quantity
FROM lineitem, (SELECT unnest([0.0, 0.25, 0.5, 0.8, 0.999, 1.0])::DOUBLE AS q) GROUP BY q""")
def q_exact_quantiles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    rows = [(q, S.exact_quantile(li, "l_extendedprice", q), S.exact_quantile(li, "l_quantity", q))
            for q in (0.0, 0.25, 0.5, 0.8, 0.999, 1.0)]
    return spark.createDataFrame(rows, "q double, price double, quantity double")


@register("below_exact_p80", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_extendedprice <= (SELECT quantile_disc(l_extendedprice, 0.8) FROM lineitem)""")
def q_below_exact_p80(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return S.filter_by_quantile(li, "l_extendedprice", 0.8, relative_error=0)
