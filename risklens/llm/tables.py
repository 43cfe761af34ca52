"""Reading of the tables and writing of intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklens.session import ensure_checkpoint_dir


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with underscores added while ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder that spark.checkpoint.dir names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, and a
    lost executor costs no more than the tasks it ran."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch: with this, a task's Python process stays within some 300 MB.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python in batches of few MB, whatever the texts' lengths."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, f"{BATCH_BYTES}b")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` as string, for an Arrow stage."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def in_training_part(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels a model may learn from: crc32 of the id's text, mod 5, is not 0.
    A null id counts as held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows of ``df`` (all, if it has no more), chosen by a hash
    of ``key``, the same in every run; ``df`` must be cheap to count."""
    n = df.count()
    if n <= most:
        return df
    share = int(most / n * (1 << 32))  # of all hashes
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 32)) < share)


#: Rows up to which a table of short rows is broadcast (about 5 MB).
SMALL_ROWS = 50_000


def join_small(df: DataFrame, small: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """Join a table that is usually small (one row per source, suffix, ...):
    broadcast if a count shows it to be so, else an ordinary join, whose hot
    keys Spark splits at run time. ``small`` must be cheap to count."""
    return df.join(F.broadcast(small) if small.count() <= SMALL_ROWS else small, on, how)


#: Labelled documents, about, that a text classifier is fitted on.
FIT_DOCS = 8_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = FIT_DOCS) -> DataFrame:
    """``doc_id, label, text`` of about ``most`` labelled documents of the
    training part, chosen by a hash of doc_id. The sampled labels, at most about
    ``most`` rows, are broadcast, so that the documents aren't shuffled. An id
    that several rows have is there as often: ``fit_rows`` takes one of them."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & in_training_part()).select(
        F.col("doc_id").alias("_labelled"), F.col(label).cast("int").alias("label")).distinct()
    chosen = written(bounded_sample(known, "_labelled", most), "labels")
    return (docs.select("doc_id", F.col("text").cast("string").alias("text"))
            .join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"))
            .select("doc_id", "label", "text"))


def fit_rows(encoded: DataFrame, values: list[str], most: int) -> DataFrame:
    """What a fit may bring to the driver of ``doc_id, label, *values`` (arrays):
    one row for each id and label, whatever their number was (the least), and of
    these, in order of a hash of the id, as many as hold ``most`` elements of the
    first array together; the last one may go beyond."""
    one = written(encoded.groupBy("doc_id", "label").agg(F.min(F.struct(*values)).alias("v")), "fit-rows")
    order = Window.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "label")  # of the sampled ids alone
    ahead = F.sum(F.size(F.col("v")[values[0]])).over(order.rowsBetween(Window.unboundedPreceding, -1))
    taken = (one.select("doc_id", "label", F.coalesce(ahead, F.lit(0)).alias("ahead")).where(F.col("ahead") < most)
             .select("doc_id", "label"))
    return one.join(F.broadcast(taken), ["doc_id", "label"]).select("doc_id", "label", "v.*")
