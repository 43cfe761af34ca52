import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from risklens.llm import near_duplicates as nd

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k:k + 5]) for k in range(len(w) - 4)])


def brute(rows):
    """(doc_id, n_shingles, component_id) of every row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in lists[g] if j > i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(zip((r[0] for r in rows), sets))), key=repr)


def corpus(seed, n_base=25, vocabulary=400, sizes=(1, 3, 5, 6, 8, 12, 40, 90)):
    """Bases, edited copies of copies, and a passage that many texts share."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = [r.choice(words) for _ in range(30)]
    texts = []
    for _ in range(n_base):
        base = [r.choice(words) for _ in range(r.choice(sizes))]
        if r.random() < 0.4:
            base[len(base) // 2:len(base) // 2] = passage
        texts.append(base)
        for _ in range(r.choice((0, 0, 1, 4, 12))):
            copy = list(r.choice(texts[-4:]))
            for _ in range(r.choice((0, 1, 1, 2, 5))):
                at = r.randrange(len(copy))
                copy[at:at + r.choice((0, 1, 1))] = [r.choice(words)] * r.choice((0, 1, 1)) if len(copy) > 1 else [r.choice(words)]
            texts.append(copy)
    texts = [" ".join(t).upper() if r.random() < 0.1 else "\t".join(t) for t in texts]
    return list(enumerate(r.sample(texts, len(texts)), start=-3))


def got(docs):
    return sorted((tuple(r) for r in nd.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(docs_of, seed):
    rows = corpus(seed)
    assert got(docs_of(rows, extra="cid n label s")) == brute(rows)


def test_large_group_of_chained_copies(docs_of):
    """Each text is near the next but far from the ends: links make one class."""
    words = [f"a{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4:i * 4 + 120])) for i in range(60)]
    out = got(docs_of(rows))
    assert out == brute(rows)
    assert {c for _, _, c in out} == {0}


def test_edge_cases(docs_of):
    rows = [(5, None), (4, ""), (3, " \n"), (9, "a b"), (8, "A  B"), (7, "a b c"), (7, "a b"), (None, "n n n n n n"), (None, "x y"),
            (2, "same " * 20_000), (1, "same " * 20_000), (6, "same"), (6, "same"), (10, "x y z " * 7000), (11, "x y z " * 7000 + "end")]
    assert got(docs_of(rows)) == brute(rows)
    assert got(docs_of([])) == []


def test_rows_of_one_id_meet_their_own_set_only(docs_of):
    """Many near copies without an id: the sets come from one row each, not from all pairs of rows."""
    words = [f"a{i}" for i in range(60)]
    rows = [(None, " ".join(words + [f"z{i}"])) for i in range(300)] + [(7, " ".join(words)), (7, " ".join(words[:30]))]
    docs = docs_of(rows)
    own = nd.sizes(docs)
    classes = own.groupBy("cid", "n").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"))
    assert nd.sets_of(docs, classes).count() == 302
    assert got(docs) == brute(rows)


def test_equals_sql(spark, docs_of):
    rows = corpus(12) + [(900, None), (901, ""), (902, "a b"), (903, "A\tB"), (904, "É x y z w v"), (905, "é x y z w v")]
    docs = docs_of(rows)
    with duckdb.connect() as c:
        c.register("documents", docs.toPandas())
        want = c.sql(nd.OP4_SQL).fetchall()
    assert got(docs) == sorted(want, key=repr) == brute(rows)


def test_groups_of_one_prefix(docs_of):
    """Sets that differ in what is frequent only: large groups, several classes among them."""
    words = [f"a{i}" for i in range(300)]
    r = random.Random(2)
    rows = []
    for i in range(150):
        text = words[i % 3 * 100:i % 3 * 100 + 90]
        for _ in range(i % 7):
            at = r.randrange(len(text))
            text = text[:at] + [f"b{r.randrange(4)}"] + text[at + 1:]
        rows.append((i, " ".join(text)))
    assert got(docs_of(rows)) == brute(rows)


def test_representatives(docs_of):
    rows = corpus(9) + [(500, "a b c d e f"), (500, "a b c d e f"), (501, "a b c d e f"), (502, None), (503, ""), (502, None)]
    docs = docs_of(rows, extra="set_name listed")
    out = nd.representatives(docs)
    assert out.columns == docs.columns
    want = Counter(d for d, n, c in brute(rows) if n and d == c)
    want = Counter(list(want)) + Counter(d for d, n, _ in brute(rows) if not n)
    assert Counter(r["doc_id"] for r in out.collect()) == want


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300, i) for i in range(301, 380)] + [(i, i + 1) for i in range(400, 460)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    found = {r["cid"]: r["label"] for r in nd.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent if find(x) != x}
