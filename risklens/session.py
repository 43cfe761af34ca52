"""Session construction and lineage cutting for iterative operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

# Folders written by cut_lineage / read_table in this process.
_TABLES: set[str] = set()

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "risklens",
                  shuffle_partitions: int | None = None,
                  conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume.

    On a cluster, leave ``master`` unset and let spark-submit decide; the
    shuffle partition count should then come from the cluster config.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it if needed.

    The directory comes from ``spark.checkpoint.dir`` (a shared folder on a
    cluster). Only a local-mode session without that setting -- unit tests --
    gets a private folder under the system temp directory, deleted when the
    process ends; a cluster session
    without it is an error, because a machine-local folder would not survive
    the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a shared folder (HDFS/S3/...) before "
            "running iterative graph operators on a cluster")
    path = tempfile.mkdtemp(prefix="risklens-ckpt-", dir=os.environ.get("TMPDIR"))
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the checkpoint folder and
    return the table.

    Used once per round of the iterative graph algorithms so that plans and
    lineage stay constant-size and a lost executor only costs the current
    round. A columnar table is cheaper to write and re-read than an RDD
    checkpoint, and it gives the planner real size statistics.
    """
    spark = df.sparkSession
    path = new_table_path(spark)
    df.write.mode("errorifexists").parquet(path)
    _TABLES.add(path)
    return spark.read.schema(df.schema).parquet(path)


def new_table_path(spark: SparkSession) -> str:
    """A fresh folder name under the checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/risklens-{uuid.uuid4().hex}"


def append_table(df: DataFrame, path: str) -> None:
    """Append ``df`` to the parquet table at ``path`` (one folder collects
    the per-level results of a loop instead of a growing union plan)."""
    df.write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    _TABLES.add(path)
    return spark.read.schema(schema).parquet(path)


def release(df: DataFrame | None) -> None:
    """Delete the tables written by ``cut_lineage`` that ``df`` reads, once
    nothing needs them any more (a loop's superseded round, or a consumed
    result). Tables are found through the frame's input files, so frames
    not backed by such tables are left alone; deletion is best effort."""
    if df is None or not _TABLES:
        return
    try:
        files = df.inputFiles()
    except Exception:  # noqa: BLE001
        return
    known = {_norm(p): p for p in _TABLES}
    paths = {p for f in files for np_, p in known.items() if _norm(f).startswith(np_ + "/")}
    if not paths:
        return
    spark = df.sparkSession
    for path in paths:
        _TABLES.discard(path)
        try:
            hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
        except Exception:  # noqa: BLE001 - e.g. Spark Connect: leave the folder
            pass


def _norm(p: str) -> str:
    """Scheme-free path, so ``file:/a`` and ``file:///a`` compare equal."""
    u = urlparse(p)
    return (u.netloc + u.path).rstrip("/") if u.scheme not in ("", "file") else u.path.rstrip("/")
