import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from risklens.llm import token_file
from risklens.llm.tables import new_folder
from risklens.llm.words import slices

TEXTS = ["", " ", "Hello, world!", "it's we'll 'd ABC", "İstanbul é é ́x", "日本 ١٢٣ ☃☃!!", "a\x1cb\x85c\xa0d\x00e",
         "ΑΣ ΣΣ", "<|endoftext|> q <|startoftext|>", "x" * 5000, "one two " * 3000, "\n\t\r\n"]


def library_ids(texts):
    t = Tokenizer.from_file(token_file.default_tokenizer())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_equals_library():
    for cached in (3, token_file.CACHED_WORDS):
        encoder, got = token_file.WordEncoder(token_file.default_tokenizer(), cached), []
        for s in slices(pa.array(TEXTS + [None] + TEXTS), 64):
            ids, n = encoder(s)
            ends = np.cumsum(n)
            got += [ids[e - k:e].tolist() for e, k in zip(ends, n)]
        assert got == library_ids(TEXTS + [""] + TEXTS)


def ours(texts, slice_bytes=1 << 16, **cache):
    encoder, got = token_file.WordEncoder(token_file.default_tokenizer(), **cache), []
    for s in slices(pa.array(texts), slice_bytes):
        ids, n = encoder(s)
        ends = np.cumsum(n)
        got += [ids[e - k:e].tolist() for e, k in zip(ends, n)]
    return got


CODE_POINTS = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000] + list(range(0x20000, 0x110000, 17))


@pytest.mark.parametrize("form", ["{}", "a{}b", "x{}"])
def test_every_character_equals_library(form):
    chars = [form.format(chr(c)) for c in CODE_POINTS]
    texts = [" ".join(chars[i:i + 50]) for i in range(0, len(chars), 50)]
    assert ours(texts) == library_ids(texts)


def test_miscounted_words_beside_each_other_equal_library():
    # words whose number of pre-tokens is easily mistaken: special tokens, letters that normalisation splits
    texts = ["one <|endoftext|> two", "\u0958 x", "a\u095eb y", "one<|endoftext|>two <|startoftext|>"]
    assert ours(texts) == library_ids(texts)
    rng = random.Random(4)
    pieces = ["<|endoftext|>", "\u0958", "\u095f", "ab", "\u0378", "'s", "1", " ", " ", "\n", "\u0301", "\xa0", "Σ", "İ", "☃"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 30))) for _ in range(3000)]
    assert ours(texts, slice_bytes=300, cached=40) == library_ids(texts)


def test_long_words_leave_the_cache():
    encoder = token_file.WordEncoder(token_file.default_tokenizer(), cached_ids=1000)
    texts = ["".join(random.Random(i).choices("abcdefgh", k=4000)) for i in range(30)]
    got = []
    for s in slices(pa.array(texts), 100):
        got.append(encoder(s)[0].tolist())
        assert encoder.used < 1000 + 4001
    assert got == library_ids(texts)


def test_files_round_trip(spark, docs_of):
    rows = [(i * 3 - 5, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (100, None), (4, "again"), (4, "again")]
    docs = docs_of(rows, extra="part ahead ids")
    got = token_file.encode_documents(docs).collect()
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    start, want = 0, []
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    for (i, _), ids in zip(rows, library_ids([t or "" for _, t in rows])):
        ids = [*ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_lookup_by_id(spark, docs_of):
    path = new_folder(spark, "token-test")
    token_file.write(docs_of([(i, f"document number {i}") for i in range(200)]), path, token_file.default_tokenizer())
    found = token_file.lookup(spark, path, [7, 150, 999])
    assert sorted(r["doc_id"] for r in found.collect()) == [7, 150]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    rows = token_file.read(spark, path).orderBy("part", "ahead").collect()
    assert [r["doc_id"] for r in rows] == list(range(200))


def test_files_have_stripes_row_index_and_bloom_filter(spark, docs_of):
    path = new_folder(spark, "token-test")
    docs = docs_of([(i, "".join(chr(97 + (i * j) % 26) for j in range(40))) for i in range(30_000)])
    token_file.write(docs.repartition(1), path, token_file.default_tokenizer(), stripe_bytes=1 << 16)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stripes = 0
    for name in {r["f"] for r in token_file.read(spark, path).select(F.input_file_name().alias("f")).distinct().collect()}:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        for stripe in reader.getStripes():
            kinds = {str(x.getKind()) for x in rows.readStripeFooter(stripe).getStreamsList() if x.getColumn() == 1}
            assert {"ROW_INDEX", "BLOOM_FILTER_UTF8", "DATA"} <= kinds
            encoding = rows.readStripeFooter(stripe).getColumns(1)
            assert str(encoding.getKind()) == "DIRECT_V2"  # run-length encoding of integers
            stripes += 1
    assert stripes > 3
    assert [r["doc_id"] for r in token_file.lookup(spark, path, [12_345, 99_999_999]).collect()] == [12_345]


def test_one_id_across_files(spark, docs_of):
    rows = [(7, f"text {i}") for i in range(3000)] + [(3, "a"), (9, "b")]
    path = new_folder(spark, "token-test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows go to one file
    try:
        token_file.write(docs_of(rows).repartition(8), path, token_file.default_tokenizer())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    own = token_file.read(spark, path).where("doc_id = 7")
    assert own.count() == 3000 and own.select("part").distinct().count() > 1
    assert [r["doc_id"] for r in token_file.read(spark, path).orderBy("part", "ahead").collect()] == [3] + [7] * 3000 + [9]
    digest = sorted(token_file.digest(spark, path).collect(), key=lambda r: r["start"])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(digest, digest[1:]))


def test_empty_table(docs_of):
    assert token_file.encode_documents(docs_of([])).collect() == []
