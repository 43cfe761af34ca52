"""Association-rule and classifier queries.

Fixture mapping: transactions = distinct part brands of each order
(``lineitem`` x ``part``); baskets from columns = one part row
(brand, type, container-like size); labelled points = ``embeddings``
(features = the 64 floats, label = ``label < 5``, test set = ``vec_id % 5 = 0``,
the rest trains, the union fits the indexers); precision/recall of the
``labels`` table scores ``toxic`` as a prediction of ``quality``.
"""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from risklens.operators import classify as M
from risklens.operators import rules as RU
from risklens.operators import trees as T
from risklens.plans.registry import register, rnd, table
from risklens.session import cut_lineage

MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.15


def order_baskets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return RU.grouped_baskets(li.join(pa, li.l_partkey == pa.p_partkey), "l_orderkey", "p_brand")


_BASKET_SQL = """b AS (SELECT DISTINCT l.l_orderkey AS t, p.p_brand AS item
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
      WHERE l.l_orderkey IS NOT NULL AND p.p_brand IS NOT NULL)"""

# Brute force over all subsets of every basket (baskets hold at most seven
# brands), so the oracle is exact for itemsets of any size.
_ITEMSET_SQL = f"""{_BASKET_SQL},
sub(t, items, last) AS (
  SELECT t, [item], item FROM b
  UNION ALL
  SELECT s.t, list_append(s.items, b.item), b.item FROM sub s JOIN b ON b.t = s.t AND b.item > s.last),
n AS (SELECT count(DISTINCT t) AS n FROM b),
fi AS (SELECT items, count(*) AS freq FROM sub GROUP BY items
       HAVING count(*) >= (SELECT ceil({MIN_SUPPORT} * n) FROM n))"""

_RULE_SQL = f"""{_ITEMSET_SQL},
cand AS (SELECT fi.items, fi.freq, c.item AS consequent,
                list_filter(fi.items, lambda x: x <> c.item) AS antecedent
         FROM fi, unnest(fi.items) AS c(item) WHERE len(fi.items) > 1),
rules AS (
  SELECT array_to_string(cand.antecedent, ',') AS antecedent, cand.consequent,
         cand.freq / a.freq AS confidence,
         (cand.freq / a.freq) / (w.freq / (SELECT n FROM n)) AS lift,
         cand.freq / (SELECT n FROM n) AS support
  FROM cand JOIN fi a ON a.items = cand.antecedent
            JOIN fi w ON w.items = [cand.consequent])"""


@register("baskets", f"""WITH {_BASKET_SQL}
SELECT t AS l_orderkey, string_agg(item, ',' ORDER BY item) AS items FROM b GROUP BY t""")
def q_baskets(spark, sf_dir):
    return order_baskets(spark, sf_dir).select("l_orderkey", RU.items_text("items").alias("items"))


@register("baskets_columns", """
SELECT array_to_string(list_distinct_ordered, ',') AS items FROM (
  SELECT list_sort(list_distinct(list_filter([p_brand, p_type, CAST(p_size AS VARCHAR)],
                                             lambda x: x <> ''))) AS list_distinct_ordered
  FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL AND p_size IS NOT NULL)""")
def q_baskets_columns(spark, sf_dir):
    tx = RU.baskets(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])
    return tx.select(RU.items_text("items").alias("items"))


@register("frequent_itemsets", f"""WITH RECURSIVE {_ITEMSET_SQL}
SELECT array_to_string(items, ',') AS items, len(items) AS size, freq FROM fi""")
def q_frequent_itemsets(spark, sf_dir):
    fi = RU.frequent_itemsets(order_baskets(spark, sf_dir), MIN_SUPPORT)
    return fi.select(RU.items_text("items").alias("items"), F.col("size").cast("bigint"), "freq")


def _rules_spark(spark, sf_dir, min_conf):
    r = RU.association_rules(order_baskets(spark, sf_dir), MIN_SUPPORT, min_conf)
    return r.select(RU.items_text("antecedent").alias("antecedent"),
                    F.col("consequent")[0].alias("consequent"),
                    rnd("confidence", 9).alias("confidence"), rnd("lift", 9).alias("lift"),
                    rnd("support", 9).alias("support"))


@register("association_rules", f"""WITH RECURSIVE {_RULE_SQL}
SELECT antecedent, consequent, round(confidence, 9) AS confidence, round(lift, 9) AS lift,
       round(support, 9) AS support FROM rules""")
def q_association_rules(spark, sf_dir):
    return _rules_spark(spark, sf_dir, 0.0)


@register("rules_min_confidence", f"""WITH RECURSIVE {_RULE_SQL}
SELECT antecedent, consequent, round(confidence, 9) AS confidence, round(lift, 9) AS lift,
       round(support, 9) AS support FROM rules WHERE confidence >= {MIN_CONFIDENCE}""")
def q_rules_min_confidence(spark, sf_dir):
    return _rules_spark(spark, sf_dir, MIN_CONFIDENCE)


# ------------------------------------------------------------------ ML
@register("precision_recall", """
SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS n_true,
       count(*) FILTER (WHERE toxic = 1) AS n_pred,
       count(*) FILTER (WHERE toxic = quality AND quality = 1) AS n_right,
       (count(*) FILTER (WHERE toxic = quality AND quality = 1))
         / nullif(count(*) FILTER (WHERE toxic = 1), 0) AS precision,
       (count(*) FILTER (WHERE toxic = quality AND quality = 1))
         / nullif(count(*) FILTER (WHERE quality = 1), 0) AS recall,
       (count(*) FILTER (WHERE toxic = quality)) / nullif(count(*), 0) AS accuracy
FROM labels""")
def q_precision_recall(spark, sf_dir):
    return M.precision_recall(table(spark, sf_dir, "labels"), label="quality", prediction="toxic")


def labelled_points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pts = e.select("vec_id", (F.col("label") < 5).cast("double").alias("label"),
                   array_to_vector("embedding").alias("features"))
    test = pts.where(F.col("vec_id") % 5 == 0)
    train_df = pts.where(F.col("vec_id") % 5 != 0)
    return train_df, test, pts


_TRAIN_SQL = "WITH tr AS (SELECT count(*) AS n, count(*) FILTER (WHERE label < 5) AS n_true FROM embeddings WHERE vec_id % 5 <> 0)"
_SETS_SQL = f"""{_TRAIN_SQL}
SELECT 'train' AS item, n, n_true, true AS ok FROM tr
UNION ALL
SELECT 'test', count(*), count(*) FILTER (WHERE label < 5), true FROM embeddings WHERE vec_id % 5 = 0"""

# checks of the fit, each on the training rows
_CHECKED_ITEMS_SQL = {
    "linear": """SELECT 'intercept' AS item, n, n_true, true AS ok FROM tr
UNION ALL SELECT concat('feature ', range), n, n_true, true
FROM range((SELECT max(len(embedding)) FROM embeddings)::BIGINT), tr""",
    "decision_tree": "SELECT unnest(['predictions', 'counts', 'least rows', 'majority']) AS item, n, n_true, true AS ok FROM tr",
    "ensemble": "SELECT 'votes' AS item, n, n_true, true AS ok FROM tr",
}


# a data set's rows, then what the fit must satisfy; the tree's leaves are also checked by themselves
_LEAVES_SQL = {"decision_tree": "\nUNION ALL SELECT 'leaves', n, n_true, true FROM tr"}


def _clf_sql(check):
    return f"{_SETS_SQL}\nUNION ALL SELECT item, n, n_true, ok FROM (\n{_CHECKED_ITEMS_SQL[check]}){_LEAVES_SQL.get(check, '')}"


def _clf(kind):
    def run(spark, sf_dir):
        """CJ9: a row per data set (size, positives, and whether the metrics of the model's
        predictions agree with them) and per property that the fit must have on its training rows."""
        train_df, test, all_data = labelled_points(spark, sf_dir)
        train_df = cut_lineage(train_df)
        model = M.train(train_df, all_data, kind)
        scores = M.train_and_score(train_df, test, all_data, kind, model=model)
        agrees = ((F.col("n_right") <= F.least("n_true", "n_pred")) & F.col("accuracy").between(0.0, 1.0)
                  & F.col("recall").eqNullSafe(F.try_divide(F.col("n_right").cast("double"), F.col("n_true"))))
        sets = scores.select(F.col("dataset").alias("item"), "n", "n_true", agrees.alias("ok"))
        checks = M.fit_checks(model, train_df, kind)
        if kind == "decision_tree":
            checks = checks.unionByName(M.leaf_majorities(model, train_df))
        return sets.unionByName(checks.join(F.broadcast(_sizes(train_df))).select("item", "n", "n_true", "ok"))
    run.__name__ = f"q_clf_{kind}"
    return run


def _sizes(train_df):
    return train_df.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1.0).alias("n_true"))


def _fit(kind):
    def run(spark, sf_dir):
        """A row per property that the fit must have on its training rows."""
        train_df, _, all_data = labelled_points(spark, sf_dir)
        train_df = cut_lineage(train_df)
        checks = M.fit_checks(M.train(train_df, all_data, kind), train_df, kind)
        return checks.join(F.broadcast(_sizes(train_df))).select("item", "n", "n_true", "ok")
    run.__name__ = f"q_fit_{kind}"
    return run


for _name, _kind, _check in (("decision_tree", "decision_tree", "decision_tree"),
                             ("random_forest", "random_forest", "ensemble"),
                             ("gbt", "gbt", "ensemble"), ("lr", "logistic", "linear"),
                             ("lasso", "lasso", "linear"), ("ridge", "ridge", "linear")):
    register(f"clf_{_name}", _clf_sql(_check))(_clf(_kind))
    register(f"fit_{_name}", f"{_TRAIN_SQL}\n{_CHECKED_ITEMS_SQL[_check]}")(_fit(_kind))


# ML5: the first split of a tree that may cut between any two values, against the
# split that SQL works out: least Gini impurity after the cut, over all features and cuts
@register("first_split", """
WITH v AS (SELECT unnest(range(len(embedding)::BIGINT)) AS feature, unnest(embedding)::DOUBLE AS x, (label < 5)::INT AS y
           FROM embeddings WHERE vec_id % 5 <> 0),
d AS (SELECT feature, x, count(*) AS n, sum(y) AS ones FROM v GROUP BY ALL),
c AS (SELECT feature, (x + lead(x) OVER w) / 2 AS threshold, sum(n) OVER w AS l, sum(ones) OVER w AS l1,
             sum(n) OVER (PARTITION BY feature) AS n, sum(ones) OVER (PARTITION BY feature) AS n1
      FROM d WINDOW w AS (PARTITION BY feature ORDER BY x)),
g AS (SELECT feature, threshold, l, n,
             2 * (n1 / n) * (1 - n1 / n) - (l / n) * 2 * (l1 / l) * (1 - l1 / l)
               - ((n - l) / n) * 2 * ((n1 - l1) / (n - l)) * (1 - (n1 - l1) / (n - l)) AS gain
      FROM c WHERE threshold IS NOT NULL),
b AS (SELECT * FROM g ORDER BY gain DESC, feature, threshold LIMIT 1)
SELECT source, feature, round(threshold, 9) AS threshold, round(gain, 9) AS gain, l::BIGINT AS n_left, (n - l)::BIGINT AS n_right
FROM b, (SELECT unnest(['fitted', 'searched']) AS source)""")
def q_first_split(spark, sf_dir):
    train_df, _, _ = labelled_points(spark, sf_dir)
    train_df = cut_lineage(train_df)
    points = train_df.select(F.col("label"), vector_to_array("features").alias("x"))
    searched = T.best_split(points).withColumn("source", F.lit("searched"))
    bins = points.agg(*[F.count_distinct(F.col("x")[0]).alias("n")]).first()["n"] + 1
    model = DecisionTreeClassifier(maxDepth=1, maxBins=max(2, bins), minInstancesPerNode=1).fit(train_df)
    fitted = T.tree_nodes(spark, model).where("node = 1").select(
        F.lit("fitted").alias("source"), "feature", "threshold", "gain", "n_left", "n_right")
    out = fitted.unionByName(searched.select("source", "feature", "threshold", "gain", "n_left", "n_right"))
    return out.select("source", F.col("feature").cast("long").alias("feature"), rnd("threshold", 9).alias("threshold"),
                      rnd("gain", 9).alias("gain"), "n_left", "n_right")


# PF19 on probability vectors made from a column: each component is the share of
# one label, in the order of a label indexer, with 1.0 once at index 0 and once at 1.
@register("probability_threshold", """
SELECT vec_id, CASE WHEN embedding[1] > 0.02 THEN 1.0 ELSE 0.0 END AS first_label,
       CASE WHEN embedding[1] > 0.02 THEN 1.0 ELSE 0.0 END AS second_label
FROM embeddings""")
def q_probability_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("p"))
    e = e.select("vec_id", array_to_vector(F.array(F.col("p"), 1 - F.col("p"))).alias("first"),
                 array_to_vector(F.array(1 - F.col("p"), F.col("p"))).alias("second"))
    out = M.threshold(e, 0.02, 0, prob_col="first", out="first_label")
    return M.threshold(out, 0.02, 1, prob_col="second", out="second_label").select("vec_id", "first_label", "second_label")


# CJ8: table columns to rules in one call.
_PART_BASKETS_SQL = """b AS (SELECT DISTINCT p_partkey AS t, unnest(list_filter([p_brand, p_type, CAST(p_size AS VARCHAR)],
                                                                        lambda x: x <> '')) AS item
      FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL AND p_size IS NOT NULL)"""


@register("rules_from_table", f"""WITH RECURSIVE {_RULE_SQL.replace(_BASKET_SQL, _PART_BASKETS_SQL)}
SELECT antecedent, consequent, round(confidence, 9) AS confidence, round(lift, 9) AS lift,
       round(support, 9) AS support FROM rules""")
def q_rules_from_table(spark, sf_dir):
    _, r = RU.rules_from_table(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], MIN_SUPPORT)
    return r.select(RU.items_text("antecedent").alias("antecedent"), F.col("consequent")[0].alias("consequent"),
                    rnd("confidence", 9).alias("confidence"), rnd("lift", 9).alias("lift"), rnd("support", 9).alias("support"))
