import datetime as dt

from conftest import rows
from risklens.operators import access as A
from risklens.streaming import stream_access_frequency

T0 = dt.datetime(2024, 1, 5)


def test_stream_matches_batch(spark, tmp_path):
    recs = [(k, T0 + dt.timedelta(hours=h, minutes=mi), u)
            for k in (1, 2) for h in (0, 5, 7, 30) for mi in (0, 17) for u in ("a", "b")]
    recs.append((3, T0, None))
    batch = spark.createDataFrame(recs, "k long, ts timestamp_ntz, uri string")
    src = tmp_path / "in"
    batch.write.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).parquet(str(src))
    agg = stream_access_frequency(stream, ["k"], "ts", 6 * 3600, value_col="uri",
                                  values=["a"])
    q = (agg.writeStream.outputMode("update").format("memory")
         .queryName("freq_stream_test").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = rows(spark.table("freq_stream_test"), "k", "uri", "bucket_start", "frequency")
    exp = rows(A.access_frequency(batch, ["k"], "ts", 6 * 3600, value_col="uri", values=["a"]),
               "k", "uri", "bucket_start", "frequency")
    assert got == exp
