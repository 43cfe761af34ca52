import hashlib
import math

import numpy as np
import pytest

from risklens.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    """Plain Lloyd on Python integers; rows of (vec_id, embedding, label)."""
    whole = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    vectors = [[max(-V.LIMIT, min(V.LIMIT, math.floor(4096 * float(np.float32(x))))) for x in r[1]] for r in whole]
    d = max(1, -(-max(map(len, vectors)) // parts))
    order = sorted(range(len(whole)), key=lambda i: (whole[i][0] is None, whole[i][0] or 0, vectors[i]))[:entries]
    vectors = [v + [0] * (parts * d - len(v)) for v in vectors]
    books = [[vectors[i][j * d:j * d + d] for i in order] for j in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((away(v[j * d:j * d + d], e), k) for k, e in enumerate(books[j])) for j in range(parts)] for v in vectors]

    for _ in range(rounds):
        own = assign()
        for j in range(parts):
            for k in range(len(books[j])):
                held = [v[j * d:j * d + d] for v, a in zip(vectors, own) if a[j][1] == k]
                if held:
                    books[j][k] = [sum(x) // len(held) for x in zip(*held)]
    own = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    made = [(r[0], r[2], "".join(f"{k:02x}" for _, k in a), sum(e for e, _ in a)) for r, a in zip(whole, own)]
    return sorted(made, key=str), digest


def check(spark, rows, **extra):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumns({c: df["vec_id"] for c in ("x", "ids", "part", "code")}) if extra.pop("clash", False) else df
    codes, books = V.compressed(V.integers(df, "vec_id", "embedding", "label"), **extra)
    parts, entries, rounds = extra.get("parts", V.PARTS), extra.get("entries", V.ENTRIES), extra.get("rounds", V.ROUNDS)
    want, digest = brute(rows, parts, entries, rounds)
    assert sorted(map(tuple, codes.collect()), key=str) == want
    assert V.books_digest(books) == digest


def test_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 16) / 4096], int(i) % 4 or None) for i in range(400)]
    check(spark, rows, clash=True)


def test_equals_brute_force_clustered(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_VECTORS", 100)
    rng = np.random.default_rng(6)
    hot = [float(x) for x in rng.normal(size=12)]
    rows = [(int(i), hot if i % 3 == 0 else [float(x) for x in rng.normal(i % 5, 0.01, 12)], int(i) % 2) for i in range(500)]
    check(spark, rows, parts=4, entries=5, rounds=3)


def test_edges(spark):
    v = [0.5, -0.25, 3.0, 0.1, -0.0001, 7.5, 1.0, 2.0]
    rows = [(1, v, 1), (1, v, 1), (1, v[::-1], None), (None, v, None), (2, None, 1), (3, v[:-1] + [None], 1), (4, v[:-1] + [float("nan")], 1),
            (5, [float("inf")] + v[1:], 1), (6, [], 2), (7, v + [1.0], 2), (8, [1e30] * 8, 3), (-9, [-1e30] * 8, 3)]
    check(spark, rows)


def test_empty_table(spark):
    codes, books = V.compressed(V.integers(spark.createDataFrame([], SCHEMA), "vec_id", "embedding", "label"))
    assert codes.count() == 0 and books.size == 0


@pytest.mark.parametrize("seed", range(6))
def test_tree_covers_and_settles(seed, monkeypatch):
    monkeypatch.setattr(V, "LEAF", [1, 4, 16][seed % 3])
    rng = np.random.default_rng(seed)
    points = rng.integers(-6, 7, (int(rng.integers(1, 600)), 3)).astype(np.int32) * int(rng.integers(1, 9))
    points[rng.random(len(points)) < 0.3] = points[0]
    tree = V.CoverTree.build(points)
    assert sorted(tree.order) == list(range(len(points)))
    far = lambda a, b: np.sqrt(np.square((points[a] - points[b]).astype(float)).sum(axis=-1))
    for i in range(len(tree.radius)):
        own = tree.order[tree.start[i]:tree.end[i]]
        assert far(own, own[0]).max() <= tree.radius[i]
        kids = range(tree.child[i], tree.child[i] + tree.children[i])
        assert not kids or (tree.start[kids[0]], tree.end[kids[-1]]) == (tree.start[i], tree.end[i])
        centres = tree.order[[tree.start[k] for k in kids]]
        assert all(far(a, b) > tree.radius[i] / 2 * 0.999 for n, a in enumerate(centres) for b in centres[:n])
    for _ in range(5):
        book = points[rng.integers(0, len(points), 7)].astype(np.int64) + rng.integers(-2, 3, (7, 3))
        want = V.nearest(points, book)
        assert (tree.codes(points, book) == want).all()
        count, total = tree.sums(points, book)
        assert (count == np.bincount(want, minlength=7)).all()
        assert (total == [points[want == k].sum(axis=0) for k in range(7)]).all()


def test_subtrees_are_settled_whole():
    rng = np.random.default_rng(9)
    centres = rng.integers(-40000, 40000, (8, 4))
    points = (centres[rng.integers(0, 8, 3000)] + rng.integers(-50, 50, (3000, 4))).astype(np.int32)
    nodes, _, single, _ = V.CoverTree.build(points).settle(points, centres.astype(np.int64))
    assert len(single) == 0 and len(nodes) < 100
