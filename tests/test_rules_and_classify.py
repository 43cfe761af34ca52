import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import rows
from risklens.operators import classify as M
from risklens.operators import rules as RU
from risklens.sources.readers import read_baskets_text, read_edge_list


def tx(spark, baskets):
    return spark.createDataFrame([(b,) for b in baskets], "items array<string>")


def test_itemsets_and_rules(spark):
    t = tx(spark, [["a", "b"], ["a", "b", "c"], ["a"], []])
    fi = RU.frequent_itemsets(t, 0.25)
    assert fi.count() == 7
    r = {(tuple(x.antecedent), x.consequent[0]): x for x in
         RU.association_rules(t, 0.25).collect()}
    ab = r[(("a",), "b")]
    assert ab.confidence == pytest.approx(2 / 3)
    assert ab.lift == pytest.approx(4 / 3)
    assert ab.support == pytest.approx(0.5)
    for (ante, cons), x in r.items():
        assert cons not in ante
    high = RU.association_rules(t, 0.25, min_confidence=0.9).collect()
    assert all(x.confidence >= 0.9 for x in high) and len(high) < len(r)


def test_baskets_dedupe_and_empties(spark):
    df = spark.createDataFrame([("x", "x", ""), ("y", None, "z")], "a string, b string, c string")
    assert [r.items for r in RU.baskets(df, ["a", "b", "c"]).collect()] == [["x"]]
    g = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "c")], "k long, i string")
    assert rows(RU.grouped_baskets(g, "k", "i").select("k", RU.items_text("items").alias("s"))) \
        == [(1, "a,b"), (2, "c")]


def test_text_readers(spark, tmp_path):
    p = tmp_path / "b.txt"
    p.write_text("a,b,,b\nc\n")
    assert [r.items for r in read_baskets_text(spark, str(p)).collect()] == [["a", "b"], ["c"]]
    q = tmp_path / "e.txt"
    q.write_text("1 2\n2 3\n")
    assert rows(read_edge_list(spark, str(q))) == [(1, 2, 1.0), (2, 3, 1.0)]


def test_precision_recall_no_positive_prediction(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "label double, pred double")
    r = M.precision_recall(df, prediction="pred").first()
    assert r.precision is None and r.recall == 0.0 and r.accuracy == 0.5


def points(spark, n=80):
    data = []
    for i in range(n):
        y = float((i // 3) % 2)
        data.append((i, y, Vectors.dense([y * 2 + (i % 7) * 0.1, (i % 5) * 0.3, 1.0 - y])))
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("vec_id", T.LongType()),
                           T.StructField("label", T.DoubleType()),
                           T.StructField("features", VectorUDT())])
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("kind", sorted(M.ESTIMATORS))
def test_classifiers_fit_and_score(spark, kind):
    pts = points(spark)
    test = pts.where(F.col("vec_id") % 4 == 0)
    train = pts.where(F.col("vec_id") % 4 != 0)
    kw = {"numTrees": 20} if kind == "random_forest" else {}
    if kind == "gbt":
        kw = {"maxIter": 3}
    m = M.train_and_score(train, test, pts, kind, **kw).collect()
    assert {r.dataset for r in m} == {"train", "test"}
    for r in m:
        assert r.recall >= 0.8 and r.precision >= 0.8


@pytest.mark.parametrize("share", [3, 1])
def test_threshold_takes_the_positive_label(spark, share):
    """Label 1.0 as the minority (index 1) and as the majority (index 0)."""
    pts = points(spark).where((F.col("label") == 1.0) | (F.col("vec_id") % 4 < share))
    if share == 3:
        pts = points(spark).where((F.col("label") == 0.0) | (F.col("vec_id") % 4 < 2))
    model = M.train(pts, pts, "logistic")
    i = M.positive_index(model)
    n = dict(rows(pts.groupBy("label").count()))
    assert i == int(n[1.0] < n[0.0])
    out = M.threshold(model.transform(pts), 0.5, i).collect()
    assert all(float(r.predictedLabel) == r.thresholdLabel for r in out)


@pytest.mark.parametrize("kind", sorted(M.ESTIMATORS))
def test_fit_checks_hold(spark, kind):
    pts = points(spark)
    kw = {"random_forest": {"numTrees": 5}, "gbt": {"maxIter": 3}}.get(kind, {})
    model = M.train(pts, pts, kind, **kw)
    got = M.fit_checks(model, pts, kind).collect()
    assert got and all(r.ok for r in got)


def test_fit_checks_fail_for_a_wrong_fit(spark):
    pts = points(spark)
    early = M.train(pts, pts, "ridge", maxIter=1)
    assert not all(r.ok for r in M.stationarity(early, pts).collect())
    tree = M.train(pts, pts, "decision_tree")
    other = pts.withColumn("label", 1.0 - F.col("label"))
    wrong = {r.item: r.ok for r in M.fit_checks(tree, other, "decision_tree").collect()}
    assert wrong["predictions"] and not wrong["counts"]


def test_least_rows_of_a_leaf_are_checked(spark):
    from risklens.operators import trees as T

    pts = points(spark)
    tree = M.train(pts, pts, "decision_tree", minInstancesPerNode=1)
    got = {r.item: r.ok for r in T.tree_checks(tree.stages[2], tree.transform(pts), 50).collect()}
    assert got["predictions"] and got["counts"] and got["majority"] and not got["least rows"]


def test_best_split_equals_brute_force(spark):
    from risklens.operators import trees as T

    rnd = __import__("random").Random(3)
    data = [(float(rnd.random() < 0.4), [float(rnd.randrange(6)), rnd.random() ** 8 * 1e6, 1.0]) for _ in range(300)]
    gini = lambda ys: 2 * (sum(ys) / len(ys)) * (1 - sum(ys) / len(ys))
    best = None
    for f in range(3):
        values = sorted({x[f] for _, x in data})
        for a, b in zip(values, values[1:]):
            left, right = [y for y, x in data if x[f] <= a], [y for y, x in data if x[f] > a]
            gain = gini([y for y, _ in data]) - len(left) / 300 * gini(left) - len(right) / 300 * gini(right)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, (a + b) / 2, len(left), len(right))
    got = T.best_split(spark.createDataFrame(data, "label double, x array<double>")).first()
    assert (got.feature, got.n_left, got.n_right) == (best[1], *best[3:])
    assert got.threshold == pytest.approx(best[2]) and got.gain == pytest.approx(best[0])
    assert T.best_split(spark.createDataFrame([(1.0, [2.0])], "label double, x array<double>")).count() == 0


def test_unknown_classifier(spark):
    with pytest.raises(ValueError):
        M.build_pipeline(points(spark), "svm")


def test_rules_from_table(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("d", "")], "f1 string, f2 string")
    fi, ru = RU.rules_from_table(df, ["f1", "f2"], min_support=0.5)
    assert rows(fi.select(RU.items_text("items").alias("s"), "freq")) == [("a", 3), ("a,b", 2), ("b", 2)]
    r = {(tuple(x.antecedent), x.consequent[0]): x for x in ru.collect()}
    assert r[(("b",), "a")].confidence == 1.0


def test_rule_identities_on_fixture(spark):
    from risklens.plans.learn_queries import MIN_SUPPORT, order_baskets
    tx = order_baskets(spark, "/root/testdata/sf0.01")
    n = tx.count()
    fi = {tuple(r.items): r.freq for r in RU.frequent_itemsets(tx, MIN_SUPPORT).collect()}
    for r in RU.association_rules(tx, MIN_SUPPORT).collect():
        union = tuple(sorted(list(r.antecedent) + list(r.consequent)))
        assert r.support * n == pytest.approx(fi[union])
        assert r.confidence == pytest.approx(fi[union] / fi[tuple(r.antecedent)])
        assert r.lift == pytest.approx(r.confidence / (fi[tuple(r.consequent)] / n))


def test_libsvm_train_and_score(spark, tmp_path):
    from risklens.sources.readers import read_libsvm

    def write(name, rows_):
        p = tmp_path / name
        p.write_text("".join(f"{y} 1:{a} 2:{b}\n" for y, a, b in rows_))
        return str(p)
    train_rows = [(float(i % 2), (i % 2) * 3 + (i % 5) * 0.1, (i % 3) * 0.2) for i in range(60)]
    test_rows = [(float(i % 2), (i % 2) * 3 + 0.05, 0.1) for i in range(10)]
    tr = read_libsvm(spark, write("train.txt", train_rows), num_features=2)
    te = read_libsvm(spark, write("test.txt", test_rows), num_features=2)
    assert tr.columns == ["label", "features"] and tr.count() == 60
    m = {r.dataset: r for r in M.train_and_score(tr, te, tr.unionByName(te), "decision_tree").collect()}
    assert m["test"].n == 10 and m["test"].recall == 1.0 and m["test"].precision == 1.0


@pytest.mark.parametrize("name, items", [
    ("decision_tree", {"predictions", "counts", "least rows", "majority", "leaves"}), ("random_forest", {"votes"}), ("gbt", {"votes"}),
    ("lr", {"intercept", "feature 0", "feature 1"}), ("lasso", {"intercept", "feature 0", "feature 1"}),
    ("ridge", {"intercept", "feature 0", "feature 1"})])
def test_classifier_queries_check_their_fit(spark, tmp_path, name, items):
    import duckdb

    import __spark_entry__ as E

    gen = __import__("random").Random(1)
    rows = [(i, [gen.gauss(i % 2, 1.0), gen.gauss(0.0, 1.0)], 3 if i % 2 else 7) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(
        f"{tmp_path}/embeddings.parquet")
    got = {r.item: (r.n, r.n_true, r.ok) for r in E.queries()[f"clf_{name}"](spark, str(tmp_path)).collect()}
    assert set(got) == {"train", "test"} | items and all(ok for _, _, ok in got.values())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == {r[0]: r[1:] for r in con.execute(E.oracle_sql()[f"clf_{name}"]).fetchall()}
