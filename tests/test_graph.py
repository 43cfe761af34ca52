import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import rows
from risklens.operators.graph import build as B
from risklens.operators.graph import cells as K
from risklens.operators.graph import community as L
from risklens.operators.graph import components as C
from risklens.operators.graph import lpa as P
from risklens.operators.graph import report as R


def edges_df(spark, triples):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in triples],
                                 "src long, dst long, weight double")


# ------------------------------------------------------------------ GR1
def recs(spark, data, n):
    cols = ", ".join(f"a{i} string" for i in range(n))
    return spark.createDataFrame(data, f"k string, {cols}")


def test_similarity_half(spark):
    df = recs(spark, [("1", "x", "y"), ("2", "x", "z")], 2)
    e = B.similarity_edges(df, "k", ["a0", "a1"])
    assert rows(e) == [(1, 2, 0.5), (2, 1, 0.5)]


def test_similarity_all_empty_and_null(spark):
    df = recs(spark, [("1", "", None), ("2", "", None), ("3", None, "q"), ("4", "", "q")], 2)
    e = B.similarity_edges(df, "k", ["a0", "a1"])
    assert rows(e) == [(3, 4, 0.5), (4, 3, 0.5)]


def test_similarity_skips_empty_keys(spark):
    df = recs(spark, [("", "x", "y"), ("2", "x", "y"), ("3", "x", "y")], 2)
    assert rows(B.similarity_edges(df, "k", ["a0", "a1"])) == [(2, 3, 1.0), (3, 2, 1.0)]


def brute_sim(data, compat):
    best = {}
    for ka, *xa in data:
        for kb, *xb in data:
            if not ka or not kb or ka == kb:
                continue
            if compat:
                la, lb = java_split(xa), java_split(xb)
                if len(la) != len(lb) or not la:
                    continue
                s = sum(1 for p, q in zip(la, lb) if p == q and q != "") / len(la)
            else:
                la = [v or "" for v in xa]
                lb = [v or "" for v in xb]
                s = sum(1 for p, q in zip(la, lb) if p == q and q != "") / len(la)
            key = (int(ka), int(kb))
            best[key] = max(best.get(key, 0.0), s)
    return sorted((a, b, w) for (a, b), w in best.items() if w > 0)


def java_split(values):
    """Literal model of comma-joining (NULLs skipped) and splitting with
    trailing empty fields removed."""
    s = ",".join(v for v in values if v is not None)
    if s == "":
        return [""]
    parts = s.split(",")
    while parts and parts[-1] == "":
        parts.pop()
    return parts


@pytest.mark.parametrize("compat", [False, True])
def test_similarity_equals_theta_join_model(spark, compat):
    rnd = random.Random(3 if compat else 4)
    pool = ["a", "b", "", None, "a,b", "c"] if compat else ["a", "b", "", None, "c"]
    data = [(str(rnd.randrange(1, 15)), *(rnd.choice(pool) for _ in range(3)))
            for _ in range(60)]
    e = B.similarity_edges(recs(spark, data, 3), "k", ["a0", "a1", "a2"], compat=compat)
    got = rows(e)
    exp = brute_sim(data, compat)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in exp]
    for g, x in zip(got, exp):
        assert g[2] == pytest.approx(x[2])


# ------------------------------------------------------------------ GR2-GR4
def test_cooccurrence_and_union(spark):
    df = spark.createDataFrame([("a1", "9")] * 3 + [("a2", "9"), ("", "9")], "c string, m string")
    df = df.select(F.regexp_replace("c", "a", "").alias("c"), "m")
    e = B.cooccurrence_edges(df, "c", "m", right_offset=100)
    assert rows(e) == [(1, 109, 3.0), (2, 109, 1.0)]
    u = B.union_edges(e, e)
    assert u.count() == 4
    assert rows(B.vertex_strength(u)) == [(1, 6.0), (2, 2.0), (109, 8.0)]
    assert B.total_weight(u).first().total_weight == 8.0
    assert rows(B.graph_vertices(u)) == [(1,), (2,), (109,)]


def test_seed_labels(spark):
    verts = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    orders = spark.createDataFrame([("o1", "1"), ("o2", "1"), ("o3", "2"), ("o4", "7")],
                                   "ok string, cust string")
    black = spark.createDataFrame([("o1",), ("o2",), ("o4",)], "ok string")
    labels, counts = B.seed_labels(verts, orders, black, key="cust", black_key="ok")
    assert rows(labels) == [(1, -1, True), (2, 2, False), (3, 3, False)]
    c = counts.first()
    assert (c.black_num, c.seeded) == (3, 1)


# ------------------------------------------------------------------ GR12
def union_find(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_components_small(spark):
    e = edges_df(spark, [(1, 2, 1), (2, 3, 1), (5, 6, 1)])
    assert rows(C.connected_components(e)) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]


def test_components_random_vs_union_find(spark):
    rnd = random.Random(11)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)]
    e = edges_df(spark, [(a, b, 1) for a, b in pairs])
    ids = {x for p in pairs for x in p}
    exp = union_find([(a, b) for a, b in pairs if a != b], ids)
    verts = spark.createDataFrame([(999,)], "id long")
    got = dict(rows(C.connected_components(e, vertices=verts)))
    assert got.pop(999) == 999
    assert got == exp


# ------------------------------------------------------------------ GR5, GR6
def brute_lpa(triples, steps):
    ids = {x for a, b, _ in triples for x in (a, b)}
    lab = {i: i for i in ids}
    for _ in range(steps):
        votes = defaultdict(lambda: defaultdict(float))
        for a, b, w in triples:
            votes[a][lab[b]] += w
            votes[b][lab[a]] += w
        lab = {i: (min(votes[i].items(), key=lambda kv: (-kv[1], kv[0]))[0] if votes[i]
                   else lab[i]) for i in ids}
    return lab


def test_lpa_tie_smallest_label(spark):
    e = edges_df(spark, [(5, 2, 1.0), (5, 9, 1.0)])
    got = dict(rows(P.label_propagation(e, max_steps=1)))
    assert got[5] == 2


def test_lpa_random_vs_model(spark):
    rnd = random.Random(5)
    triples = [(rnd.randrange(40), rnd.randrange(40), rnd.choice([0.5, 1.0])) for _ in range(90)]
    triples = [t for t in triples if t[0] != t[1]]
    got = dict(rows(P.label_propagation(edges_df(spark, triples), max_steps=4)))
    assert got == brute_lpa(triples, 4)


def brute_bm(triples, labels, steps, seed=-1):
    dist = {i: {l: 1.0} for i, l in labels.items()}
    for _ in range(steps):
        s = defaultdict(lambda: defaultdict(float))
        for a, b, w in triples:
            for l, p in dist[b].items():
                s[a][l] += w * p
            for l, p in dist[a].items():
                s[b][l] += w * p
        new = {}
        for i, d in dist.items():
            if not s[i] or d.get(seed, 0.0) == 1.0:
                new[i] = d
            else:
                z = sum(s[i].values())
                new[i] = {l: v / z for l, v in s[i].items()}
        dist = new
    return dist


def test_bm_lpa_vs_model_and_clamp(spark):
    rnd = random.Random(8)
    triples = [(rnd.randrange(30), rnd.randrange(30), rnd.choice([0.5, 1.0, 2.0]))
               for _ in range(60)]
    triples = [t for t in triples if t[0] != t[1]]
    ids = sorted({x for a, b, _ in triples for x in (a, b)} | {77})
    seeds = set(rnd.sample(ids, 5))
    labels = {i: (-1 if i in seeds else i) for i in ids}
    verts = spark.createDataFrame([(i, l) for i, l in labels.items()], "id long, label long")
    got = P.bm_label_propagation(edges_df(spark, triples), verts, max_steps=3).collect()
    exp = brute_bm(triples, labels, 3)
    gd = defaultdict(dict)
    for r in got:
        gd[r.id][r.label] = r.prob
    assert set(gd) == set(exp)
    for i in exp:
        assert set(gd[i]) == set(exp[i])
        for l, p in exp[i].items():
            assert gd[i][l] == pytest.approx(p, rel=1e-9)
        assert sum(gd[i].values()) == pytest.approx(1.0)
    for s in seeds:
        assert gd[s] == {-1: 1.0}
    assert gd[77] == {77: 1.0}


def test_grey_list_and_report(spark):
    dist = spark.createDataFrame(
        [(1, -1, 1.0), (2, -1, 0.2), (2, 5, 0.8), (3, 3, 0.6), (3, 4, 0.4), (4, -1, 0.5),
         (4, 9, 0.5)], "id long, label long, prob double")
    grey = R.grey_list(dist)
    assert rows(grey) == [(1, 1.0), (2, 0.2), (4, 0.5)]
    v = dict((r.id, r.label) for r in R.vertex_verdict(dist).collect())
    assert v[3] == 3
    e = edges_df(spark, [(1, 2, 1), (2, 1, 1), (2, 3, 1), (4, 3, 1)])
    cc, groups = R.fraud_groups(grey, e)
    assert rows(cc) == [(1, 1), (2, 1), (4, 4)]
    assert rows(groups) == [(1, 2, 2, 1.0), (4, 1, 0, 0.0)]
    counts = spark.createDataFrame([(5, 2)], "black_num long, seeded long")
    s = R.fraud_summary(cc, counts).first()
    assert (s.n_groups, s.black_num, s.seeded, s.grey_num) == (2, 5, 2, 3)
    assert s.seed_share == pytest.approx(2 / 3)


# ------------------------------------------------------------------ Louvain
def triangles(spark, bridge):
    t = [(1, 2, 1), (2, 3, 1), (1, 3, 1), (4, 5, 1), (5, 6, 1), (4, 6, 1)]
    if bridge:
        t.append((3, 4, 1))
    both = t + [(b, a, w) for a, b, w in t]
    return edges_df(spark, both)


def test_louvain_two_triangles_bridge(spark):
    e = triangles(spark, bridge=True)
    m = L.louvain(e, max_iter=5, layers=2)
    lv = m.groupBy("level").agg(F.count("*").alias("n")).collect()
    assert all(r.n == 6 for r in lv)
    last = max(r.level for r in lv)
    comm = dict(rows(m.where(F.col("level") == last), "vertex", "community"))
    assert set(comm) == {1, 2, 3, 4, 5, 6}
    assert comm[1] == comm[2] == comm[3]


def test_louvain_disjoint_triangles_survive_coarsening(spark):
    e = triangles(spark, bridge=False)
    m = L.louvain(e, max_iter=5, layers=2)
    for lvl in {r.level for r in m.select("level").distinct().collect()}:
        comm = dict(rows(m.where(F.col("level") == lvl), "vertex", "community"))
        assert set(comm) == {1, 2, 3, 4, 5, 6}
    final = dict(rows(m.where(F.col("level") == 0), "vertex", "community"))
    assert final[1] == final[2] == final[3] != final[4] == final[5] == final[6]


def test_best_moves_model(spark):
    e = triangles(spark, bridge=True)
    nodes = L.louvain_init(e)
    m = e.agg(F.sum("weight")).first()[0]
    mv = {r.id: (r.target, r.gain) for r in L.best_moves(nodes, L.edge_ends(e), m).collect()}
    deg = defaultdict(float)
    kin = defaultdict(float)
    for r in e.collect():
        deg[r.src] += r.weight
        deg[r.dst] += r.weight
        kin[(r.src, r.dst)] += r.weight
        kin[(r.dst, r.src)] += r.weight
    for v in deg:
        cands = [(kin[(v, c)] - deg[c] * deg[v] / m, c) for c in deg if (v, c) in kin]
        q, c = max(cands, key=lambda t: (t[0], -t[1]))
        assert mv[v] == ((c, q) if q > 0 else (v, 0.0))


def test_coarsen_keeps_isolated_and_inner(spark):
    e = triangles(spark, bridge=False)
    nodes = L.louvain_init(e).withColumn(
        "comm", F.when(F.col("id") <= 3, F.lit(1)).otherwise(F.lit(4)))
    n2, e2, _ = L.louvain_coarsen(nodes, e)
    assert e2.count() == 0
    assert rows(n2, "id", "degree", "inner_degree") == [(1, 0.0, 12.0), (4, 0.0, 12.0)]


def test_modularity_not_decreasing_on_fixture(spark):
    c = spark.read.parquet("/root/testdata/sf0.01/customer.parquet")
    c = c.select("c_custkey", F.floor(F.col("c_acctbal") / 10).cast("string").alias("a1"),
                 F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment",
                             F.floor(F.col("c_acctbal") / 1000).cast("string")).alias("a2"))
    e = B.similarity_edges(c, "c_custkey", ["a1", "a2"])
    m = L.louvain(e)
    qs = [L.modularity(e, m.where(F.col("level") == lv), resolution=2.0).first().modularity
          for lv in sorted(r.level for r in m.select("level").distinct().collect())]
    assert all(b >= a - 1e-12 for a, b in zip(qs, qs[1:]))
    sizes = rows(L.communities(m).groupBy("level").count())
    assert [c for _, c in sizes] == [355, 167, 137, 137]


def test_entity_graph_with_customer_links(spark):
    df = spark.createDataFrame(
        [("1", "x", "y", "900"), ("2", "x", "z", "900"), ("2", "x", "z", "900"), ("", "x", "y", "7")],
        "k string, a0 string, a1 string, cust string")
    e = B.entity_graph(df, "k", ["k", "a0", "a1"], ["a0", "a1"], cust="cust", cust_offset=1000)
    assert rows(e) == [(1, 2, 0.5), (2, 1, 0.5), (1900, 1, 1.0), (1900, 2, 2.0)]
    with pytest.raises(ValueError):
        B.entity_graph(df, "k", ["k"], ["a0"])


def test_seed_probability_equals_full_propagation(spark):
    rnd = random.Random(21)
    triples = [(rnd.randrange(40), rnd.randrange(40), rnd.choice([0.3, 0.5, 1.0, 2.5]))
               for _ in range(100)]
    triples = [t for t in triples if t[0] != t[1]]
    ids = sorted({x for a, b, _ in triples for x in (a, b)} | {99})
    seeds = set(rnd.sample(ids, 6))
    verts = spark.createDataFrame([(i, -1 if i in seeds else i, i in seeds) for i in ids],
                                  "id long, label long, is_seed boolean")
    e = edges_df(spark, triples)
    for steps in (1, 3):
        full = {r.id: r.prob for r in
                P.bm_label_propagation(e, verts, max_steps=steps).where("label = -1").collect()}
        fast = dict(rows(P.seed_probability(e, verts, max_steps=steps)))
        assert set(fast) == set(ids)
        for i in ids:
            assert fast[i] == pytest.approx(full.get(i, 0.0), rel=1e-12, abs=1e-15)
            assert (fast[i] == 1.0) == (full.get(i, 0.0) == 1.0)
    grey = dict(rows(R.grey_list_from_seeds(e, verts, 3)))
    assert set(grey) == {i for i, p in fast.items() if p > 0}


def test_cells_equal_pairs(spark):
    """Vertices, components, strength, total weight and seed probability from cells
    equal those of the pair edges."""
    from risklens.operators.graph import cells as K
    rnd = random.Random(5)
    data = [(str(k), rnd.choice(["", "p", "q", "r", None]) , rnd.choice(["x", "y", "z", "v", "w"]) if rnd.random() < 0.6 else f"own{k}")
            for k in range(1, 70)]
    df = spark.createDataFrame(data, "k string, a0 string, a1 string")
    e = B.similarity_edges(df, "k", ["a0", "a1"]).cache()
    shared = K.shared_cells(K.similarity_cells(df, "k", ["a0", "a1"]))
    vertices = K.cell_vertices(shared)
    assert rows(vertices) == rows(B.graph_vertices(e))
    assert rows(K.cell_components(shared), "id", "component") == rows(C.connected_components(e), "id", "component")
    want = dict(rows(B.vertex_strength(e)))
    got = dict(rows(K.cell_strength(shared)))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert K.cell_total_weight(shared).first()[0] == pytest.approx(B.total_weight(e).first()[0])
    seeds = vertices.withColumn("is_seed", F.col("id") % 9 == 0)
    for steps in (1, 2, 5):
        p = dict(rows(P.seed_probability(e, seeds, steps)))
        q = dict(rows(K.cell_seed_probability(shared, seeds, steps)))
        assert q.keys() == p.keys()
        assert all(q[k] == pytest.approx(p[k], rel=1e-12, abs=1e-15) and (q[k] == 1.0) == (p[k] == 1.0) for k in p)


def test_cell_components_of_several_records_per_key(spark):
    from risklens.operators.graph import cells as K
    rnd = random.Random(6)
    data = [(str(rnd.randrange(1, 40)), rnd.choice("abcdefghij"), f"u{rnd.randrange(60)}") for _ in range(70)]
    df = spark.createDataFrame(data, "k string, a0 string, a1 string")
    e = B.similarity_edges(df, "k", ["a0", "a1"])
    shared = K.shared_cells(K.similarity_cells(df, "k", ["a0", "a1"]))
    assert rows(K.cell_components(shared), "id", "component") == rows(C.connected_components(e), "id", "component")


def test_label_propagation_keeps_whole_distributions(spark):
    """A vertex whose labels are all rare keeps them: a star with ten leaves."""
    star = edges_df(spark, [(0, i, 1.0) for i in range(1, 11)])
    verts = spark.createDataFrame([(i, i) for i in range(11)], "id long, label long")
    got = P.bm_label_propagation(star, verts, max_steps=1).collect()
    assert {r.id for r in got} == set(range(11))
    assert sorted(r.prob for r in got if r.id == 0) == pytest.approx([0.1] * 10)


def test_target_groups_are_components(spark):
    """Random functional graphs with long chains, swaps and longer cycles."""
    rnd = random.Random(8)
    for n in (1, 7, 60):
        to = {i: rnd.randrange(n + 5) for i in range(n)}
        to |= {1000 + i: 1001 + i for i in range(40)}  # a chain, ids ascending
        to |= {2000 + i: 1999 + i for i in range(1, 40)}  # a chain, ids descending
        to |= {3000: 3001, 3001: 3002, 3002: 3000, 2999: 3001}  # a cycle of three
        to = {a: b for a, b in to.items() if a != b}
        moves = spark.createDataFrame(list(to.items()), "src long, dst long")
        got = defaultdict(set)
        for r in L.target_groups(moves).collect():
            got[r.component].add(r.id)
        want = defaultdict(set)
        for i, c in rows(C.connected_components(moves), "id", "component"):
            want[c].add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# ------------------------------------------------------------------ contraction, spread joins
def test_spread_join_equals_plain_join(spark, monkeypatch):
    from risklens.operators import joins

    rnd = random.Random(7)
    keys = [0 if rnd.random() < 0.4 else rnd.randrange(60) for _ in range(900)] + [None] * 5
    large = spark.createDataFrame(list(enumerate(keys)), "i long, k long")
    keyed = spark.createDataFrame([(k, f"v{k}") for k in range(0, 60, 3)], "k long, v string")
    for how in ("inner", "left"):
        want = rows(large.join(keyed, on="k", how=how), "i", "k", "v") if how == "inner" else None
        monkeypatch.setattr(joins, "PLAIN_ROWS", 10)
        monkeypatch.setattr(joins, "HOT_SHARE", 20)
        got = joins.spread_join(large, keyed, "k", how)
        plain = large.join(keyed, on="k", how=how)
        key = lambda df: sorted(map(repr, df.select("i", "k", "v").collect()))
        assert key(got) == key(plain)
        assert want is None or rows(got, "i", "k", "v") == want
        # the hot key's rows are not in the shuffled part
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_components_of_star_path_and_loops(spark, monkeypatch):
    from risklens.operators import joins

    edges = [(0, i) for i in range(1, 400)] + [(5000, i) for i in range(1000, 1200)] + [(i, i + 1) for i in range(2000, 2100)] + [(7, 7), (9000, 9000)]
    ids = {x for e in edges for x in e if e[0] != e[1]}
    want = union_find([e for e in edges if e[0] != e[1]], ids)
    e = edges_df(spark, [(a, b, 1) for a, b in edges])
    assert dict(rows(C.connected_components(e), "id", "component")) == want
    monkeypatch.setattr(joins, "PLAIN_ROWS", 20)
    monkeypatch.setattr(C, "PLAIN_ROWS", 20)
    monkeypatch.setattr(joins, "HOT_SHARE", 10)
    verts = spark.createDataFrame([(9000,), (1,), (9001,)], "id long")
    assert dict(rows(C.connected_components(e, vertices=verts), "id", "component")) == want | {9000: 9000, 9001: 9001}


def test_components_edge_table_shrinks(spark):
    e = edges_df(spark, [(i, rnd, 1) for i, rnd in zip(range(1, 3000), (random.Random(1).randrange(i) for i in range(1, 3000)))])
    left, sizes = C._edges(e), []
    while n := left.count():
        sizes.append(n)
        left = C.cut_lineage(C.contracted(left, C.pointers(left), n))
    assert len(sizes) < 12 and all(b <= a * 0.7 for a, b in zip(sizes, sizes[1:]))


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert rows(C.connected_components(none)) == []
    assert rows(C.connected_components(none, vertices=spark.createDataFrame([(3,)], "id long"))) == [(3, 3)]


# ------------------------------------------------------------------ cells against pairs
def several_attributes(spark, seed, n=40, several=False):
    rnd = random.Random(seed)
    pool = ["a", "b", "c", "", None]
    data = {(str(k), *(rnd.choice(pool) for _ in range(3))) for k in range(n)}
    if several:
        data |= {(str(rnd.randrange(n)), *(rnd.choice(pool) for _ in range(3))) for _ in range(12)}
    df = recs(spark, sorted(data, key=str), 3)
    return df, B.similarity_edges(df, "k", ["a0", "a1", "a2"])


@pytest.mark.parametrize("seed", [1, 2])
def test_cell_propagation_equals_pairs(spark, seed):
    from risklens.operators.graph import cell_lpa as CP

    df, e = several_attributes(spark, seed)
    shared = K.shared_cells(K.similarity_cells(df, "k", ["a0", "a1", "a2"]))
    # weights in thirds can tie up to rounding: whole numbers of shared positions are exact
    whole = e.withColumn("weight", F.round(F.col("weight") * 3))
    for steps in (1, 2, 4):
        assert rows(CP.cell_label_propagation(shared, max_steps=steps), "id", "label") == rows(P.label_propagation(whole, max_steps=steps), "id", "label")
    start = B.graph_vertices(e).withColumn("label", F.when(F.col("id") % 7 == 0, -1).otherwise(F.col("id")))
    assert (rows(CP.cell_label_propagation(shared, start, max_steps=3), "id", "label")
            == rows(P.label_propagation(whole, start, max_steps=3), "id", "label"))
    start = start.unionByName(spark.createDataFrame([(999, -1)], "id long, label long"))
    got = {(r.id, r.label): r.prob for r in CP.cell_bm_label_propagation(shared, start, max_steps=3).collect()}
    want = {(r.id, r.label): r.prob for r in P.bm_label_propagation(e, start, max_steps=3).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {k for k, v in got.items() if v == 1.0} == {k for k, v in want.items() if v == 1.0}


def test_cell_propagation_forms_no_pairs(spark):
    """A cell of many keys: messages grow with keys x labels of the cell, not with pairs of keys."""
    from risklens.operators.graph import cell_lpa as CP

    df = recs(spark, [(str(i), "x", str(i % 50)) for i in range(3000)], 2)
    shared = K.shared_cells(K.similarity_cells(df, "k", ["a0", "a1"]))
    out = CP.cell_label_propagation(shared, max_steps=1)
    # smallest id among those that share both attributes: its twins are i % 50
    assert {(r.id, r.label) for r in out.collect()} == {(i, i % 50 if i >= 50 else i + 50) for i in range(3000)}


def test_density_by_inclusion_and_exclusion(spark):
    from risklens.operators.graph import sharing as G

    df, e = several_attributes(spark, 5, n=60)
    shared = K.shared_cells(K.similarity_cells(df, "k", ["a0", "a1", "a2"]))
    cc = K.cell_components(shared)
    assert rows(G.cell_density(shared, cc)) == rows(R.community_density(e, C.connected_components(e)))
    with pytest.raises(Exception, match="more than"):
        G.cell_sets(spark.createDataFrame([(1, i) for i in range(20)], "k long, cell long")).collect()


def test_strength_of_keys_with_several_records(spark):
    df, e = several_attributes(spark, 6, several=True)
    got, want = (dict(rows(x, "id", "degree")) for x in (K.record_strength(df, "k", ["a0", "a1", "a2"]), B.vertex_strength(e)))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    shared = K.shared_cells(K.similarity_cells(df, "k", ["a0", "a1", "a2"]))
    for total in (K.cell_strength(shared), K.cell_total_weight(shared)):
        with pytest.raises(Exception, match="several records"):
            total.collect()


def test_louvain_rounds_of_few_moves_look_at_few_edges(spark, monkeypatch):
    rnd = random.Random(9)
    edges = [(a, b, 1) for c in range(12) for a in range(c * 10, c * 10 + 10) for b in range(a + 1, c * 10 + 10) if rnd.random() < 0.6]
    edges += [(rnd.randrange(120), rnd.randrange(120), 1) for _ in range(40)]
    e = edges_df(spark, [x for x in edges if x[0] != x[1]])
    want = rows(L.louvain(e), "vertex", "level", "community")
    from risklens.operators import joins

    for few, plain in ((10 ** 9, 10 ** 9), (1, 10 ** 9), (1, 5)):  # never; always; always, with spread joins
        monkeypatch.setattr(L, "FEW_MOVES", few)
        monkeypatch.setattr(L, "PLAIN_ROWS", plain)
        monkeypatch.setattr(joins, "PLAIN_ROWS", plain)
        assert rows(L.louvain(e), "vertex", "level", "community") == want


def test_growing_join_sides_are_not_broadcast(spark, monkeypatch):
    """Small files may hold many rows: no table of vertices or edges goes through the driver."""
    from risklens.operators import joins

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = recs(spark, [(str(i), str(i // 3), str(i % 4)) for i in range(40)], 2)
    e = B.similarity_edges(df, "k", ["a0", "a1"])
    assert "Broadcast" not in plan(e) and "SortMergeJoin" in plan(e)
    nodes, ends = L.louvain_init(e), L.edge_ends(e)
    assert "Broadcast" not in plan(L.best_moves(nodes, ends, 10.0))
    assert all("Broadcast" not in plan(x) for x in L.louvain_coarsen(nodes, e)[:2])
    monkeypatch.setattr(joins, "PLAIN_ROWS", 5)
    large = spark.range(100).select((F.col("id") % 10).alias("g"), "id")
    keyed = spark.range(10).select(F.col("id").alias("g"), (F.col("id") * 2).alias("v"))
    assert rows(joins.spread_join(large, keyed, "g")) == sorted((i % 10, i, i % 10 * 2) for i in range(100))


@pytest.mark.parametrize("most", [0, 12, 1000])
def test_seeded_propagation_of_groups_small_and_large(spark, monkeypatch, most):
    """By sums, mixed, and group by group: the same distributions; a large group alone is written round by round."""
    from risklens.operators.graph import cell_lpa as CP

    rnd = random.Random(4)
    data = [(str(i), f"{i // 30}|{rnd.randrange(9)}", f"{i // 60}|{rnd.randrange(14)}") for i in range(240)]
    data += [(str(1000 + i), f"s{i // 2}", f"t{i // 4}") for i in range(40)]
    df = recs(spark, data, 2)
    e = B.similarity_edges(df, "k", ["a0", "a1"])
    shared = K.shared_cells(K.similarity_cells(df, "k", ["a0", "a1"]))
    start = B.graph_vertices(e).withColumn("label", F.when(F.col("id") % 5 < 2, -1).otherwise(F.col("id")))
    start = start.unionByName(spark.createDataFrame([(9999, 9999)], "id long, label long"))
    by_sums = []
    monkeypatch.setattr(CP, "_by_sums", lambda *a, f=CP._by_sums: by_sums.append(1) or f(*a))
    monkeypatch.setattr(CP, "GROUP_KEYS", most)
    got = {(r.id, r.label): r.prob for r in CP.cell_bm_label_propagation(shared, start, max_steps=4).collect()}
    want = {(r.id, r.label): r.prob for r in P.bm_label_propagation(e, start, max_steps=4).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {k for k, v in got.items() if v == 1.0} == {k for k, v in want.items() if v == 1.0}
    assert len(by_sums) == (most < 1000)


def packed_small(monkeypatch):
    """Blocks of few ends and vertices of few, so that small graphs have several blocks and hubs."""
    from risklens.operators import joins
    from risklens.operators.graph import blocks

    monkeypatch.setattr(blocks, "BLOCK_ENDS", 100)
    monkeypatch.setattr(blocks, "MOST_ENDS", 15)
    monkeypatch.setattr(joins, "PLAIN_ROWS", 5)
    return blocks


def hubs_and_loops(seed, n=80):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(n), rnd.randrange(n), rnd.choice((0.5, 1, 2))) for _ in range(220)]
    return edges + [(0, i, 1) for i in range(1, n, 2)] + [(5, 5, 1), (2 ** 62, 2 ** 62 + 1, 1), (3, 4, 0.5), (3, 4, 1)]


@pytest.mark.parametrize("most", [15, 10 ** 6])
def test_packed_moves_equal_moves_by_rows(spark, monkeypatch, most):
    monkeypatch.setattr(packed_small(monkeypatch), "MOST_ENDS", most)
    from risklens.operators.graph import blocks

    e = edges_df(spark, hubs_and_loops(4)).unionByName(spark.createDataFrame([(None, 1, 1.0), (2, None, 1.0), (1, 6, None)], "src long, dst long, weight double"))
    ends = L.edge_ends(e)
    nodes = L.louvain_init(e.where("src is not null and dst is not null"))
    nodes = nodes.withColumn("comm", F.when(F.col("id") < 80, F.col("id") % 9).otherwise(F.col("id")))
    packed = blocks.packed_ends(ends, ends.count())
    assert packed.n > 3 and (packed.hubs is None) == (most > 15)
    got = L.packed_moves(nodes, packed, 300.0, n_nodes=nodes.count())
    assert rows(got) == rows(L.best_moves(nodes, ends, 300.0)) and len(rows(got)) > 70


def test_louvain_of_a_large_edge_table_goes_by_blocks(spark, monkeypatch):
    """Rounds that look at all nodes join and sort no row per edge."""
    e = edges_df(spark, [x for x in hubs_and_loops(8) if x[0]])
    nodes, m = L.louvain_init(e), float(e.agg(F.sum("weight")).first()[0])
    want, rounds = L.louvain_local(nodes, e, m, 2)
    want = rows(want, "id", "comm")
    monkeypatch.setattr(packed_small(monkeypatch), "MOST_ENDS", 10 ** 6)
    monkeypatch.setattr(L, "PLAIN_ROWS", 5)
    monkeypatch.setattr(L, "FEW_MOVES", 10 ** 9)  # all nodes, always

    def none(*_):
        raise AssertionError("by rows")

    monkeypatch.setattr(L, "neighbour_communities", none)
    got, n = L.louvain_local(nodes, e, m, 2)
    assert rows(got, "id", "comm") == want and n == rounds > 0


def test_coarsening_reads_the_edges_once(spark):
    """Super-edges and inner weights come from one written table."""
    e = edges_df(spark, [(1, 2, 1), (2, 3, 0.5), (3, 4, 1), (1, 4, 2)])
    nodes = L.louvain_init(e).withColumn("comm", F.when(F.col("id") < 3, 1).otherwise(3).cast("long"))
    new, cross, _ = L.louvain_coarsen(nodes, e)
    assert all("Scan parquet" in x._jdf.queryExecution().toString() for x in (new, cross))
    assert rows(cross) == [(1, 3, 2.5)] and rows(new, "id", "degree", "inner_degree") == [(1, 2.5, 2.0), (3, 2.5, 2.0)]


@pytest.mark.parametrize("most", [15, 10 ** 6])
def test_fraud_report_of_a_large_edge_table_goes_by_blocks(spark, monkeypatch, most):
    """The same grey list, groups, edges and density as by rows; the rounds group no row per edge."""
    e = edges_df(spark, [(a, b, w) for a, b, w in hubs_and_loops(6, 200) if a] + [(0, i, 1) for i in range(1, 60)])
    vertices = B.graph_vertices(e)
    labels = vertices.withColumn("is_seed", F.col("id").isin(1, 5, 40, 111))

    def report():
        packed = P.packed_graph(e)
        grey = R.grey_list_from_seeds(e, labels, 2, packed)
        cc, groups = R.fraud_groups(grey, e, packed)
        return [(i, round(p, 9)) for i, p in rows(grey)], rows(cc), rows(groups)

    twice = labels.unionByName(labels.where("id < 9"))  # sums take every row of a vertex
    want, plain = report(), rows(P.seed_probability(e, twice, 1))
    monkeypatch.setattr(packed_small(monkeypatch), "MOST_ENDS", most)
    monkeypatch.setattr("risklens.operators.graph.blocks.PLAIN_ROWS", 5)
    assert (P.packed_graph(e).hubs is None) == (most > 15)
    assert rows(P.seed_probability(e, twice, 1)) == plain

    def none(*_):
        raise AssertionError("by rows")

    monkeypatch.setattr(P, "_both_ways", none)
    monkeypatch.setattr(R, "grey_subgraph", none)
    assert report() == want
