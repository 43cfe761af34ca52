import base64
import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from risklens.llm import warc

SCHEMA = "page_id long, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    groups = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= least:
            groups.setdefault(html or "", []).append(page)
    first = {h: min((p for p in pages if p is not None), default=None) for h, pages in groups.items()}
    out = []
    for page, _, html in rows:
        to = first.get(html or "", page)
        out.append((page, len((html or "").encode()), sha(html), "response" if to == page else "revisit", None if to == page else to))
    return sorted(out, key=str)


def run(spark, rows, folder, parts=2, clash=(), **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    df = df.withColumns({c: F.lit(1) for c in clash})
    manifest = warc.write(df, f"file://{folder}/archives", **options)
    return manifest, warc.read_chunks(spark, manifest, chunk_bytes=options.get("chunk_bytes", warc.CHUNK_BYTES))


def digests(chunks):
    rows = warc.records(chunks).select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to")), "intact").collect()
    assert all(r["intact"] for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=str)


ROWS = [(5, "http://a.b/ü x\r\n", "é" * 1000), (2, None, None), (1, "http://x", ""), (7, "u", "é" * 1000), (3, "u", "é" * 1000),
        (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 40), (3, "v", "é" * 1000), (None, "n", "é" * 1000), (None, "n", "only null"),
        (4, "w", "plain"), (-8, "w", "plain ")]


def test_round_trip(spark, tmp_path):
    _, chunks = run(spark, ROWS, tmp_path, clash=("sha1", "first", "data", "chunk_no", "key", "payload", "held"))
    assert digests(chunks) == expected(ROWS)


def test_payloads_in_chunks_with_running_digests(spark, tmp_path):
    _, chunks = run(spark, ROWS, tmp_path, chunk_bytes=64)
    assert digests(chunks) == expected(ROWS)
    by_record = {}
    for r in chunks.where("record_type = 'response'").collect():
        by_record.setdefault((r["record_id"], r["target_uri"]), []).append(r)
    texts = {(warc.record_name(p, hashlib.sha1((h or "").encode()).hexdigest())): (h or "").encode() for p, _, h in ROWS}
    for (name, _), own in by_record.items():
        own.sort(key=lambda r: r["chunk_no"])
        assert [r["chunk_no"] for r in own] == list(range(len(own))) and [r["last"] for r in own] == [False] * (len(own) - 1) + [True]
        whole = b"".join(bytes(r["data"]) for r in own)
        assert whole == texts[name]
        for r in own:
            assert len(r["data"]) <= 64
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(whole[:r["payload_bytes"]]).digest()).decode()


def test_long_payload_crosses_no_bound(spark, tmp_path):
    rows = [(1, "u", "".join(chr(97 + i * i % 26) for i in range(5_000_000))), (2, "u", "short")]
    _, chunks = run(spark, rows, tmp_path, parts=1)
    assert digests(chunks) == expected(rows)
    assert chunks.agg(F.max(F.length("data"))).first()[0] == warc.CHUNK_BYTES


def test_archives_are_members_of_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 500)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1500)
    rows = [(i, f"http://h/{i}", f"page {i} " * 5) for i in range(40)]
    manifest, chunks = run(spark, rows, tmp_path, parts=1)
    assert digests(chunks) == expected(rows)
    parts = manifest.orderBy("archive", "offset").collect()
    assert len(parts) > 10 and len({r["archive"] for r in parts}) > 3 and sum(r["records"] for r in parts) == 40
    files = sorted(x for x in os.listdir(tmp_path / "archives") if not x.startswith("."))
    assert sorted({os.path.basename(r["archive"]) for r in parts}) == files
    seen = 0
    for name in files:
        data = (tmp_path / "archives" / name).read_bytes()
        own = [r for r in parts if r["archive"].endswith(name)]
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) == len(data)
        text = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        seen += text.count(b"WARC-Type: response")
    assert seen == 40


def test_many_shared_payloads(spark, tmp_path, monkeypatch):
    """Beyond the bound of a broadcast: hot digests apart, the others by a shuffle."""
    monkeypatch.setattr(warc, "SMALL_ROWS", 3)
    rows = [(i, "u", "hot" if i % 3 == 0 else f"pair {i // 4}") for i in range(60)] + [(None, "u", "hot")]
    _, chunks = run(spark, rows, tmp_path)
    assert digests(chunks) == expected(rows)


def test_least_bytes(spark, tmp_path):
    _, chunks = run(spark, ROWS, tmp_path, least_bytes=6)
    assert digests(chunks) == expected(ROWS, 6)


def test_damage_is_seen(spark, tmp_path):
    manifest, _ = run(spark, ROWS[:3], tmp_path, parts=1)
    part = manifest.first()
    path = tmp_path / "archives" / os.path.basename(part["archive"])
    path.write_bytes(path.read_bytes()[:-300])
    with pytest.raises(Exception, match="ends too early"):
        warc.read_chunks(spark, manifest).collect()


def test_empty_table(spark, tmp_path):
    manifest, chunks = run(spark, [], tmp_path)
    assert manifest.count() == 0 and chunks.count() == 0
