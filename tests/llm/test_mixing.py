import duckdb
import pytest

from risklens.llm import mixing


def sql(rows):
    with duckdb.connect() as c:
        c.execute("create table documents (doc_id bigint, text varchar, source varchar)")
        if rows:
            c.executemany("insert into documents values (?, ?, ?)", rows)
        return sorted(map(repr, c.sql(f"select doc_id, size, source_size, target, taken from ({mixing.OP5_SQL})").fetchall()))


def spark_rows(docs):
    return sorted(repr(tuple(r)) for r in mixing.mix_words(docs).select("doc_id", "size", "source_size", "target", "taken").collect())


CASES = {
    "plain": [(i, "w " * (i % 40 + 1), f"src{i % 7}") for i in range(300)],
    "hot source": [(i, "a b c" if i % 3 else None, "hot" if i < 250 else f"s{i}") for i in range(300)],
    "null source, empty texts": [(1, None, None), (2, "", "a"), (3, "x y", None), (4, "z", "é"), (5, "\t\n", "e"), (None, "q", "b")],
    "repeated rows": [(1, "a b", "x")] * 5 + [(2, "c", "x")] * 3 + [(2, "d e f", "y")],
    "long text": [(1, "word " * 50_000, "x"), (2, "a", "x"), (3, "b", "y")],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_equals_sql(docs_of, case):
    rows = CASES[case]
    assert spark_rows(docs_of([(i, t, "en", s) for i, t, s in rows], extra="size u target")) == sql(rows)


def test_mixed_rows_have_the_words_taken(docs_of):
    docs = docs_of([(i, "w " * (i % 50 + 1), "en", f"s{i % 4}") for i in range(400)], extra="mix_u cut")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_words(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got: dict = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert got == {k: v for k, v in taken.items() if v}


def test_targets_are_near(docs_of):
    rows = mixing.mix_words(docs_of([(i, "w " * (i % 30 + 1), "en", f"s{i % 5}") for i in range(1000)])).collect()
    by: dict = {}
    for i, r in enumerate(rows):
        s = r["doc_id"] % 5
        by.setdefault(s, [r["target"], 0])[1] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(t - w) <= 30 for t, w in by.values())
    assert abs(sum(t for t, _ in by.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6


def test_inclusion_is_in_proportion_to_size(spark, docs_of):
    """One hot source gets a tenth of its words: documents four times as long are taken four times as often, the longest for certain."""
    sizes = {i: 5 if i % 2 else 20 for i in range(4000)} | {5000: 9000}
    docs = docs_of([(i, "w " * n, "en", "hot") for i, n in sizes.items()])
    sized = mixing._sized(docs).select("source", "size", "u")
    rule = mixing.plan(sized, share=0.3, most=2).first()
    assert rule["whole"] == 0 and abs(rule["need"] - 0.3 * sum(sizes.values())) < 1e-6
    # the certain document apart, the expected words are those wanted
    assert abs(sum(min(1, rule["scale"] * n) * n for n in sizes.values()) - rule["need"]) < 1e-6 and rule["scale"] * 9000 > 1
    joined = mixing._sized(docs).crossJoin(mixing.plan(sized, share=0.3, most=2).drop("source"))
    taken = {r["doc_id"]: r["n"] for r in joined.select("doc_id", mixing._copies().alias("n")).collect()}
    of = lambda n: [taken[i] for i, m in sizes.items() if m == n]
    assert taken[5000] == 1
    for n in (5, 20):
        assert abs(sum(of(n)) / len(of(n)) - rule["scale"] * n) < 0.04
    assert abs(sum(taken[i] * n for i, n in sizes.items()) - rule["need"]) <= 20
