"""Frequent itemsets and association rules (RU1-RU5, PF15, PF18, SO4).

Mining is Spark ML's parallel FP-growth; rules come from the fitted model
(confidence, lift and support are model columns), so nothing is collected.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens import defaults as D
from risklens.session import cut_lineage


def baskets(df: DataFrame, fields: list[str]) -> DataFrame:
    """RU3: one transaction per row from ``fields``.

    Rows with a NULL field are skipped (PF4); the fields become one array
    (PF18) with empty strings removed (PF15) and duplicates dropped (FP-growth
    rejects repeated items).
    """
    d = df.dropna(subset=list(fields))
    arr = F.array(*[F.col(c).cast("string") for c in fields])
    return d.select(F.array_distinct(F.filter(arr, lambda x: x != "")).alias("items"))


def grouped_baskets(df: DataFrame, key: str, item: str) -> DataFrame:
    """Transactions as the distinct items of each ``key`` -> (key, items).

    ``collect_set`` is partially aggregated map-side; one transaction's items
    are one row by definition."""
    return (df.where(F.col(key).isNotNull() & F.col(item).isNotNull())
            .groupBy(key).agg(F.array_sort(F.collect_set(F.col(item).cast("string")))
                              .alias("items")))


def fit_fpgrowth(tx: DataFrame, min_support: float = D.FP_MIN_SUPPORT,
                 min_confidence: float = D.FP_MIN_CONFIDENCE,
                 num_partitions: int | None = None, items_col: str = "items") -> FPGrowthModel:
    """RU1: fit FP-growth; ``num_partitions`` only when positive."""
    fp = FPGrowth(itemsCol=items_col, minSupport=min_support, minConfidence=min_confidence)
    if num_partitions and num_partitions > 0:
        fp = fp.setNumPartitions(num_partitions)
    return fp.fit(tx)


def frequent_itemsets(tx: DataFrame, min_support: float = D.FP_MIN_SUPPORT,
                      num_partitions: int | None = None) -> DataFrame:
    """RU1: ``(items array<string> sorted, size, freq)``. The transactions are
    written once: the fit reads them several times."""
    model = fit_fpgrowth(cut_lineage(tx.select("items")), min_support, 0.0, num_partitions)
    return _itemsets(model)


def _itemsets(model: FPGrowthModel) -> DataFrame:
    return model.freqItemsets.select(F.array_sort("items").alias("items"),
                                     F.size("items").alias("size"), "freq")


def association_rules(tx: DataFrame, min_support: float = D.FP_MIN_SUPPORT,
                      min_confidence: float = D.FP_MIN_CONFIDENCE,
                      num_partitions: int | None = None) -> DataFrame:
    """RU2 / RU5: single-consequent rules A => c with

    ``confidence = freq(A + c) / freq(A)``,
    ``lift = confidence / (freq(c) / N)``, ``support = freq(A + c) / N``,
    N = number of transactions (empty ones included), keeping rules with
    ``confidence >= min_confidence``.
    """
    model = fit_fpgrowth(cut_lineage(tx.select("items")), min_support, min_confidence, num_partitions)
    return model.associationRules.select(
        F.array_sort("antecedent").alias("antecedent"), "consequent",
        "confidence", "lift", "support")


def items_text(c) -> F.Column:
    """Sorted, comma-joined rendering of an item array."""
    return F.array_join(F.array_sort(c), ",")


def rules_from_table(df: DataFrame, fields: list[str],
                     min_support: float = D.FP_MIN_SUPPORT,
                     min_confidence: float = D.FP_MIN_CONFIDENCE,
                     num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """CJ8: baskets from table columns, then itemsets and rules.

    Returns ``(frequent_itemsets, association_rules)`` from one fitted model.
    """
    tx = cut_lineage(baskets(df, fields))
    model = fit_fpgrowth(tx, min_support, min_confidence, num_partitions)
    rules = model.associationRules.select(
        F.array_sort("antecedent").alias("antecedent"), "consequent",
        "confidence", "lift", "support")
    return cut_lineage(_itemsets(model)), rules
