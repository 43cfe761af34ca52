import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from risklens.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    """Root of a list of digests, and for each of them its siblings, level by level: (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 3 * 3:p // 3 * 3 + 3]
            paths[i].append(("".join(run[:p % 3]), "".join(run[p % 3 + 1:])))
        nodes = [h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
        at = [p // 3 for p in at]
    return nodes[0], paths


def expected(rows):
    leaf = lambda r, text: h(*map(field, (r[0], r[3], r[2], None if r[1] is None else len(r[1]), text)))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for own in by_source.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: tree([leaf(r, r[1]) for r in own]) for s, own in by_source.items()}
    root, top = tree([trees[s][0] for s in names]) if names else (None, [])
    out = []
    for s, above in zip(names, top):
        for r, path in zip(by_source[s], trees[s][1]):
            path = path + above
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            for left, right in path:
                now = h(left, now, right)
            out.append((r[0], leaf(r, r[1]), trees[s][0], root, h(*[x + y for x, y in path]), now, now == root))
    return sorted(out, key=str)


def found(spark, df):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.verified(df, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=str)


def rows_of(sizes):
    rows, i = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            rows.append((i * 7 % 1009, f"line {i}\nand {'é' * (i % 5)}", "en" if i % 3 else None, name))
            i += 1
    return rows


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_equals_brute_force(spark, docs_of, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rows = rows_of({"a": 1, "b": 2, "é": 3, "c": 4, None: 28, "Z": 10, "": 9})
    assert found(spark, docs_of(rows)) == expected(rows)


def test_edges(spark, docs_of):
    rows = [(None, None, None, None), (None, "", "en", None), (3, "a\nb", "en", "s"), (3, "a\nb", "en", "s"), (3, None, "en", "s"),
            (4, "x" * 300_000 + "\n", None, "s"), (-5, "\n", "de", "t")]
    df = docs_of(rows, extra="grp block node item rank path n top h d kids pos")
    assert found(spark, df) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, "one\n", "en", "s")], [(8, "a\n", "en", None), (9, "b\n", "en", None)]])
def test_few_rows(spark, docs_of, rows):
    assert found(spark, docs_of(rows)) == expected(rows)


def test_only_digests_are_shuffled_and_nothing_is_joined_below(spark, docs_of):
    blocks = merkle.tiers(docs_of(rows_of({"a": 40})).select(
        F.col("source").alias("grp"), F.lit(40).cast("long").alias("n"), F.col("doc_id").alias("rank"), F.lit("x").alias("h"),
        F.struct("doc_id").alias("item")), "test")
    paths = blocks[-1].select("grp", "block", F.struct(F.lit("r").alias("root")).alias("top"), F.array().cast(merkle._PATH).alias("path"))
    plan = merkle.descend(blocks, paths)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
