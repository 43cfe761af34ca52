import random

import numpy as np
import pyarrow as pa

from risklens.llm import decontamination as dc
from risklens.llm.words import ALNUM, slices

SCHEMA = "item_id long, text string"


def hashed(text):
    s = next(iter(slices(pa.array([text]))))
    starts, ends, _ = s.words(ALNUM)
    return s.hashes(starts, ends, latin=True)


def infix_distance(item, text):
    """Least edits between the item and any stretch of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_distances_equal_the_recurrence():
    r = random.Random(4)
    for _ in range(60):
        item, text = [r.randrange(1, 5) for _ in range(r.randrange(1, 9))], [r.randrange(1, 5) for _ in range(r.randrange(1, 14))]
        off, end = dc.distances(np.array([item], np.uint64), np.array([text], np.uint64))
        assert off[0] == infix_distance(item, text)
        back, size = dc.distances_to_end(np.array(item, np.uint64), np.array(text[:end[0]], np.uint64))
        assert back == off[0] and infix_distance(item, text[end[0] - size:end[0]]) == off[0]


def planted(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, say(r.choice((3, 8, 15, 25, 40, 70)))) for i in range(30)]
    docs = []
    for d in range(240):
        i, item = r.choice(items)
        copy = list(item)
        for _ in range(r.choice((0, 0, 1, 2, len(item) // 5, len(item) // 3))):
            at = r.randrange(len(copy))
            copy[at:at + r.choice((0, 1, 1))] = [f"x{r.randrange(10**9)}"] * r.choice((0, 1)) if len(copy) > 1 else copy[at:at + 1]
        body = say(r.choice((0, 5, 60)))
        docs.append((d, body + (copy if d % 4 else []) + say(r.choice((0, 7, 40)))))
    return items, docs


def test_recall_against_brute_force(spark, docs_of):
    items, docs = planted(1)
    want = set()
    for d, text in docs:
        for i, item in items:
            if infix_distance(item, text) <= int(dc.allowed(len(item))):
                want.add((d, i))
    bench = spark.createDataFrame([(i, ", ".join(w).upper() + ".") for i, w in items], SCHEMA)
    rows = dc.leaks(docs_of([(d, " ".join(t)) for d, t in docs], extra="item_id start"), bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in rows}
    assert set(got) <= want
    assert len(got) >= 0.95 * len(want)
    text, item = dict(docs), dict(items)
    assert all(n == infix_distance(item[i], text[d]) for (d, i), n in got.items())
    for r in rows:
        span = " ".join(text[r["doc_id"]])[r["start"]:r["end"]].split()
        assert infix_distance(span, item[r["item_id"]]) <= r["edits"] or abs(len(span) - len(item[r["item_id"]])) <= r["edits"]


def test_case_and_punctuation_do_not_count(spark, docs_of):
    bench = spark.createDataFrame([(1, "Écoute le chant des oiseaux, là-bas.")], SCHEMA)
    docs = docs_of([(7, "x ÉCOUTE LE!! CHANT DES!! OISEAUX LÀ-BAS y"), (8, "écoute le bruit du vent")])
    assert [r["doc_id"] for r in dc.leaks(docs, bench).collect()] == [7]


def test_edge_cases(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, "..."), (None, "a b c d e f"), (4, "one two three four five six")], SCHEMA)
    rows = [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (None, "one two three four five six"),
            (5, "pad " * 30_000 + "one two three four five six " + "pad " * 30_000)]
    docs = docs_of(rows, extra="edits end")
    assert sorted(map(repr, ((r["doc_id"], r["item_id"]) for r in dc.leaks(docs, bench).collect()))) == sorted(
        repr((d, i)) for d in (3, 3, None, 5) for i in (1, 4))
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert dc.leaks(docs_of([]), bench).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert dc.leaks(docs, none).count() == 0 and dc.clean(docs, none).count() == len(rows)


def bench_of(spark, items):
    return spark.createDataFrame([(i, " ".join(w)) for i, w in items], SCHEMA)


def test_everything_is_found_where_sampling_falls_short(spark, docs_of, monkeypatch):
    monkeypatch.setattr(dc, "RECALL", 1.01)  # no number of walks reaches that
    items, docs = planted(7)
    want = {(d, i) for d, text in docs for i, item in items if infix_distance(item, text) <= int(dc.allowed(len(item)))}
    index = next(dc.blocks(bench_of(spark, items)))
    assert not index.sampled and index.walks == dc.MOST_WALKS
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs_of([(d, " ".join(t)) for d, t in docs]), bench_of(spark, items)).collect()}
    assert got == want


def test_measured_recall_reaches_the_target(spark):
    index = next(dc.blocks(bench_of(spark, planted(3)[0])))
    assert index.sampled and index.recall >= dc.RECALL


def test_blocks_of_items(spark, docs_of, monkeypatch):
    items, docs = planted(5)
    bench, table = bench_of(spark, items), docs_of([(d, " ".join(t)) for d, t in docs])
    exact = lambda: sorted(map(tuple, dc.leaks(table, bench).collect()))
    monkeypatch.setattr(dc, "RECALL", 1.01)
    whole, kept = exact(), sorted(r["doc_id"] for r in dc.clean(table, bench).collect())
    monkeypatch.setattr(dc, "BLOCK_WORDS", 200)
    assert len(list(dc.blocks(bench))) > 2
    assert exact() == whole and sorted(r["doc_id"] for r in dc.clean(table, bench).collect()) == kept
