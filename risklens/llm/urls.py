"""URL filter: rules first, then gradient-boosted trees on lexical features.

A rule fits its host and all its subdomains if the path starts with the rule's
path; the longest fitting rule decides. URLs that a rule decides are the
labelled ones; the trees learn from them and judge the others.

Both classes weigh the same in the fit, since the share of URLs that rules block
says nothing of the others. Features, all from the URL's text: lengths of URL, host and path, path depth,
host labels, share of digits and hyphens, entropy of the characters (host
without its last label; path and query), number of
parameters, length of query and fragment, and statistics of the host's suffixes
(its last one and last two labels): smoothed share of blocked ones and number of
the labelled URLs under the suffix. These would carry the labels themselves, so

* they are out of fold: hosts are dealt into ``FOLDS`` folds, and what a URL is
  trained with leaves its own fold out;
* a suffix at or below a rule's host has none (share: that of all labelled URLs,
  number: 0), for there the label is the rule and says nothing of other URLs.
  With rules on whole top-level domains that holds for all suffixes; their
  statistics are made and joined all the same.

The trees are fitted on at most about ``FIT_ROWS`` labelled URLs, chosen by a
hash of the URL; the suffix statistics cover all of them.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits
no rule and is judged by its other features; with labels of one class only that
class is the verdict of all others, without labels it is allow; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.tables import bounded_sample, join_small, load, written

#: Verdict, rule.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
FIT_ROWS = 20_000
SMOOTHING = 20.0
FOLDS = 5
TREES, DEPTH, SEED = 20, 4, 11

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, from columns host and path; else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        of_host, slash, of_path = rule.partition("/")
        fits = (((F.col("host") == of_host) | F.col("host").endswith("." + of_host))
                & F.col("path").startswith(slash + of_path))
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    n = F.length(text).cast("double")

    def share(c: Column) -> Column:
        return F.length(F.replace(text, c, F.lit(""))) / n

    return F.when(n > 0, F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0),
        lambda acc, c: acc - F.when(share(c) < 1, (1 - share(c)) * F.log2(1 - share(c))).otherwise(F.lit(0.0)))).otherwise(0.0)


def _per(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def lexical(url: Column) -> dict[str, Column]:
    h, p = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.length(url)
    return {
        "f_length": n, "f_host_length": F.length(h), "f_path_length": F.length(p),
        "f_depth": F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))),
        "f_labels": F.size(F.split(h, r"\.")),
        "f_digits": _per(F.regexp_count(url, F.lit("[0-9]")), n),
        "f_hyphens": _per(F.regexp_count(url, F.lit("[-_]")), n),
        # without the suffix, which would give the top-level domain away
        "f_entropy": _entropy(F.concat(p, query)), "f_host_entropy": _entropy(F.regexp_replace(h, r"\.[^.]*$", "")),
        "f_params": F.when(F.length(query) > 0, F.size(F.split(query, "&"))).otherwise(0),
        "f_query_length": F.length(query),
        "f_fragment": F.length(F.regexp_extract(url, r"#(.*)", 1)),
        "f_secure": F.lower(url).startswith("https://").cast("int"),
    }


def _with_suffixes(df: DataFrame) -> DataFrame:
    labels = F.split("host", r"\.")
    return (df.withColumn("s1", F.element_at(labels, -1))
            .withColumn("s2", F.when(F.size(labels) > 1, F.concat_ws(".", F.element_at(labels, F.greatest(-F.size(labels), F.lit(-2))),
                                                                     F.element_at(labels, -1))).otherwise(F.col("s1"))))


def under_rule(suffix: Column, rules=RULES) -> Column:
    """Whether a suffix is a rule's host or lies below one."""
    hosts = sorted({rule.partition("/")[0] for _, rule in rules})
    return reduce(Column.__or__, [(suffix == h) | suffix.endswith("." + h) for h in hosts], F.lit(False))


def fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host, F.lit(5)), F.lit(FOLDS)).cast("int")


def suffix_statistics(labelled: DataFrame, suffix: str, mean: float, rules=RULES) -> DataFrame:
    """``key, fold, rate, seen`` of each suffix over the labelled URLs (column
    label: 1 is block) outside the fold; fold -1 leaves none out."""
    key = F.col(f"{suffix}_key")
    held = (labelled.where(~under_rule(F.col(suffix), rules)).groupBy(F.col(suffix).alias(f"{suffix}_key"), fold(F.col("host")).alias("of"))
            .agg(F.sum("label").alias("ones"), F.count("*").alias("n")))
    folds = F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1))).alias(f"{suffix}_fold")
    outside = F.col("of") != F.col(f"{suffix}_fold")
    return (held.select("*", folds).groupBy(key, f"{suffix}_fold")
            .agg(((F.sum(F.when(outside, F.col("ones")).otherwise(0)) + SMOOTHING * mean)
                  / (F.sum(F.when(outside, F.col("n")).otherwise(0)) + SMOOTHING)).alias(f"f_{suffix}_rate"),
                 F.log1p(F.sum(F.when(outside, F.col("n")).otherwise(0))).alias(f"f_{suffix}_seen")))


def with_features(df: DataFrame, statistics: dict[str, DataFrame], mean: float, training: bool) -> tuple[DataFrame, list[str]]:
    """Add the feature columns to ``df``, which has url, host, path, s1 and s2."""
    made = lexical(F.coalesce(F.col("url"), F.lit("")))
    out, names = df.withColumns(made), list(made)
    for s, stats in statistics.items():
        of = fold(F.col("host")) if training else F.lit(-1)
        out = (join_small(out, stats, (F.col(s) == F.col(f"{s}_key")) & (of == F.col(f"{s}_fold"))).drop(f"{s}_key", f"{s}_fold")
               .fillna({f"f_{s}_rate": mean, f"f_{s}_seen": 0.0}))
        names += [f"f_{s}_rate", f"f_{s}_seen"]
    return out, names


def judge(pages: DataFrame, rules=RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``page_id, url``;
    ``score`` is the trees' probability of block (null where a rule decides)."""
    url = F.col("url")
    text, verdict = rule_of(rules)
    parsed = written(
        pages.select("page_id", url.cast("string").alias("url")).withColumn("host", host(url)).withColumn("path", path(url))
        .withColumn("rule", text).withColumn("ruled", verdict).transform(_with_suffixes), "urls")
    labelled = (parsed.where(F.col("rule").isNotNull())
                .withColumn("label", (F.col("ruled") == "block").cast("double")))
    mean = labelled.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
    if mean in (0.0, 1.0):
        return parsed.select("page_id", "host", "path", "rule",
                             F.coalesce("ruled", F.lit("block" if mean else "allow")).alias("verdict"),
                             F.when(F.col("rule").isNull(), F.lit(mean)).alias("score"))
    statistics = {s: written(suffix_statistics(labelled, s, mean, rules), "url-suffixes") for s in ("s1", "s2")}
    sample = written(bounded_sample(labelled, "url", fit_rows), "url-sample")
    train, names = with_features(sample, statistics, mean, training=True)
    weight = F.when(F.col("label") == 1, 0.5 / mean).otherwise(0.5 / (1 - mean))
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(
        assemble.transform(train).select("features", "label", weight.alias("weight")))
    full, _ = with_features(parsed, statistics, mean, training=False)
    scored = model.transform(assemble.transform(full)).withColumn("p", vector_to_array("probability")[1])
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("ruled", F.when(F.col("p") >= 0.5, "block").otherwise("allow")).alias("verdict"),
                         F.when(F.col("rule").isNull(), F.col("p")).alias("score"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages"))
