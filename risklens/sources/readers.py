"""Scans and sinks (IO1-IO13).

Every reader declares its schema: inference costs a full extra pass over the
input at scale and can change types between runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# IO1: access log as JSON lines. The timestamp arrives as text
# ("yyyy-MM-dd HH:mm:ss[.fraction]") and is parsed once here.
ACCESS_LOG_SCHEMA = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("uri", T.StringType()),
    T.StructField("dfp", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])

TESTDATA_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """IO1: JSON-lines access log -> (ip, uri, dfp, ts timestamp).

    A fraction of any length is read (to microseconds); a text that is no
    timestamp gives NULL, which the operators' NOT NULL filters drop. See
    ``scan_access_log`` for what could not be read."""
    raw = spark.read.schema(ACCESS_LOG_SCHEMA).json(path)
    return raw.select("ip", "uri", "dfp", F.try_to_timestamp("timestamp").alias("ts"))


def scan_access_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO1 that loses no line: ``(good, rejected)``.

    ``good``: as ``read_access_log``; ``rejected(line, reason)``: every other line
    as it stands, ``reason`` being ``malformed`` (no JSON object of the declared
    types), ``no timestamp`` (missing or null) or ``bad timestamp``. Blank lines
    are neither. Both are filters over one parsed scan; write what is used twice.
    """
    declared = T.StructType([*ACCESS_LOG_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = (spark.read.text(path).where(F.trim("value") != "")
              .select("value", F.from_json("value", declared, {"mode": "PERMISSIVE"}).alias("r"))
              .select("value", "r.*").withColumn("ts", F.try_to_timestamp("timestamp")))
    reason = (F.when(F.col("_corrupt_record").isNotNull(), "malformed")
              .when(F.col("timestamp").isNull(), "no timestamp")
              .when(F.col("ts").isNull(), "bad timestamp"))
    marked = parsed.withColumn("reason", reason)
    return (marked.where(F.col("reason").isNull()).select("ip", "uri", "dfp", "ts"),
            marked.where(F.col("reason").isNotNull()).select(F.col("value").alias("line"), "reason"))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """IO4: catalog (Hive) table by name."""
    return spark.table(name)


def save_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    """Save ``df`` as catalog table ``name`` (files at ``path``), dealt into
    ``buckets`` by a hash of ``key`` and sorted by it: tables of one number of
    buckets join on their keys without a shuffle of either. One task writes each
    bucket, so choose buckets of some hundred MB."""
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", path).mode("overwrite").saveAsTable(name))


def read_libsvm(spark: SparkSession, path: str,
                num_features: int | None = None) -> DataFrame:
    """IO5: libsvm file -> (label double, features vector).

    Passing ``num_features`` skips the extra pass that finds the dimension.
    """
    r = spark.read.format("libsvm")
    if num_features:
        r = r.option("numFeatures", str(num_features))
    return r.load(path)


def read_baskets_text(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """IO6: one transaction per line, items separated by ``sep``.

    Empty items are dropped and duplicates removed (FP-growth rejects them).
    """
    lines = spark.read.text(path)
    items = F.array_distinct(F.filter(F.split("value", sep), lambda x: x != ""))
    return lines.select(items.alias("items"))


def read_edge_list(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """IO7: ``src dst`` per line -> (src long, dst long, weight 1.0)."""
    e = spark.read.csv(path, sep=sep, schema="src long, dst long")
    return e.where(F.col("src").isNotNull() & F.col("dst").isNotNull()) \
        .withColumn("weight", F.lit(1.0))


def read_testdata(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet tables of the bundled fixture (``{sf_dir}/{name}.parquet``)."""
    if name not in TESTDATA_TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_result(df: DataFrame, path: str, fmt: str = "parquet",
                 partition_by: list[str] | None = None) -> None:
    """IO2/IO3/IO8-IO10: overwrite a result table, optionally partitioned
    (one ``partitionBy("bucket")`` write replaces the per-slice append loop)."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_slices(df: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> None:
    """IO3: write the slices (values of ``by``) that ``df`` has rows of, in place of
    what the table at ``path`` holds of them; its other slices stay. Running a
    slice again therefore never doubles it. A slice is written by few tasks."""
    (df.repartition(*by, F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(8)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt).save(path))
