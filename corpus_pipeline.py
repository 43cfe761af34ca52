"""Training-corpus pipeline: filter, deduplicate, decontaminate, mix, encode.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir), works on all rows
its predecessor kept, and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of
``documents``:

* quality: documents that the classifier rejects go;
* near-duplicates: one document of each class of linked documents stays;
* decontamination: documents that leak a benchmark item go;
* mixing: rows stand as often as the mix takes them;
* token-ids: the token files are written, and their digest is the result
  (doc_id, start, n_tokens, ids_crc32 of every row).

The quality model is fitted on ``labels`` and the documents it is given. Every
stage's own rules for nulls, empty and repeated rows are in its module; an
empty table passes through all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from risklens.llm import decontamination, mixing, near_duplicates, quality, token_file
from risklens.llm.tables import labelled_sample, load, written


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = quality.fit(labelled_sample(docs, load(spark, sf_dir, "labels"), "quality"))
    return quality.accepted(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_file.encode_documents(docs)


STAGES = [
    ("quality", filter_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token-ids", write_tokens),
]

#: The stages have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
