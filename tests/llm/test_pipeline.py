import corpus_pipeline

import pytest
from pyspark.sql import functions as F

from risklens.llm import decontamination, near_duplicates, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = corpus_pipeline.load(spark, SF, "documents"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_take_effect(spark, stages):
    first, good, single, clean, mix, tokens = stages
    assert all(x.columns == first.columns for x in (good, single, clean, mix))
    ids = [[r["doc_id"] for r in x.select("doc_id").collect()] for x in stages]
    assert set(ids[0]) >= set(ids[1]) >= set(ids[2]) >= set(ids[3]) >= set(ids[4])
    scores = {r["doc_id"]: r["score"] for r in quality.score(first, quality.fit(corpus_pipeline.labelled_sample(
        first, corpus_pipeline.load(spark, SF, "labels"), "quality"))).collect()}
    assert sorted(ids[1]) == sorted(d for d, s in scores.items() if s >= quality.THRESHOLD)
    classes = near_duplicates.near_duplicates(good).collect()
    assert sorted(ids[2]) == sorted(r["doc_id"] for r in classes if r["doc_id"] == r["component_id"])
    leaking = {r["doc_id"] for r in decontamination.leaks(single, corpus_pipeline.load(spark, SF, "benchmark")).collect()}
    assert sorted(ids[3]) == sorted(set(ids[2]) - leaking)
    assert sorted(ids[5]) == sorted(ids[4])
    rows = sorted(tokens.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(ids[4])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))


def test_empty_documents(spark):
    docs = corpus_pipeline.load(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_every_stage_takes_odd_rows(spark):
    """Nulls in all columns, repeated rows, a text of 1 MB and columns named like the stages' own, through the whole chain."""
    plain = corpus_pipeline.load(spark, SF, "documents")
    names = plain.columns
    good = plain.where("doc_id < 120")
    long = " ".join(f"meadow river {i} lamp." for i in range(52_000))
    assert len(long) > 1_000_000
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "a text without an id", "en", "src0", 20), (-1, None, "en", None, None), (-2, "", None, "src1", 0),
         (-3, long, "en", None, len(long)), (-4, "One repeated row of the table. " * 9, "en", "src2", 5), (-4, "One repeated row of the table. " * 9, "en", "src2", 5)],
        plain.schema)
    docs = good.unionByName(odd).withColumns({c: F.lit(7) for c in (
        "score", "label", "cid", "n", "listed", "size", "u", "cut", "mix_row", "mix_copy", "part", "ids", "item_id", "x")})
    columns, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        tables.append(docs)
        if name != "token-ids":
            assert docs.columns == columns and set(names) <= set(docs.columns)
    kept, single, clean, mix, tokens = tables
    assert kept.count() >= single.count() >= clean.count()
    long_in = [x.where("doc_id = -3").count() for x in tables]
    assert len(set(min(n, 1) for n in long_in)) == 1  # whole or not at all: no later stage drops a clean text
    assert single.where("doc_id = -4").count() <= 1
    rows = sorted(tokens.collect(), key=lambda r: r["start"])
    assert len(rows) == mix.count()
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
