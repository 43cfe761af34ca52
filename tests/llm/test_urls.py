import math
import re

from pyspark.sql import functions as F

from risklens.llm import urls

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host, best = host.translate(LOWER), None
    for _, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


URLS = [None, "", "no scheme", "http://", "://x", "http://com/", "http://COM", "HTTP://Www.Example.COM/en/1?x=1&y=2#f", "http://a.example.com/en/", "http://notexample.com/en/",
        "http://x.net/es/1", "http://x.net/es", "http://x.net/fr/?q", "http://x.net/en/1", "http://É.org/p\na?b", "http://a://b.com/c", "http://h?x/com/", "http://h#/com/",
        "http://x.org/" + "a1" * 20_000, "http://user@x.com:80/"]


def test_rules_and_parts(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(i, u) for i, u in enumerate(URLS)] + [(None, "http://x.com/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as label", "4 as features")
    verdict = dict((r, v) for v, r in RULES)
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule = brute(URLS[r["page_id"]] if r["page_id"] is not None else "http://x.com/")
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict[rule] if rule else r["verdict"] in ("allow", "block")


def test_without_labels_and_empty(spark):
    schema = "page_id long, url string"
    assert [r["verdict"] for r in urls.judge(spark.createDataFrame([(1, "http://x.org/"), (2, None)], schema)).collect()] == ["allow", "allow"]
    assert [r["verdict"] for r in urls.judge(spark.createDataFrame([(1, "http://x.net/es/"), (2, None)], schema)).collect()] == ["block", "block"]
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0


def test_trees_learn_a_lexical_pattern(spark):
    """Blocked .net pages have long, digit-rich URLs with parameters; unruled pages like them are blocked too."""
    rows = [(i, f"http://h{i}.net/es/{i:09d}{i:09d}?a=1&b=2&c={i}" if i % 2 else f"http://h.com/page{chr(97 + i % 26)}") for i in range(400)]
    rows += [(1000 + i, f"http://z{i}.org/x/{i:09d}{i:09d}?a=1&b=2&c={i}" if i % 2 else f"http://h.org/page{chr(97 + i % 26)}") for i in range(40)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).where("rule is null").collect()
    right = sum((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in got)
    assert len(got) == 40 and right >= 36


def test_unruled_pages_are_judged_alike_on_every_top_level_domain(spark):
    """All labelled .net pages are blocked, all labelled .com pages but the long ones allowed; the domain must not decide."""
    def url(tld, i, bad):
        return f"http://h{i}.{tld}/" + (f"{'es' if tld == 'net' else 'en'}/{i:09d}{i:09d}?a=1&b=2&c={i}" if bad else f"page{chr(97 + i % 26)}")

    rows = [(i, url("net", i, True)) for i in range(150)] + [(200 + i, url("com", i, False)) for i in range(300)]
    rows += [(600 + i, f"http://h{i}.example.com/en/{i:09d}{i:09d}?a=1&b=2&c={i}") for i in range(50)]
    unruled = {1000 + 40 * k + i: (tld, i % 2 == 1) for k, tld in enumerate(("net", "org", "io", "co.uk")) for i in range(40)}
    rows += [(i, url(tld, i, bad).replace("/es/", "/x/")) for i, (tld, bad) in unruled.items()]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).where("rule is null").collect()}
    assert got == {i: "block" if bad else "allow" for i, (_, bad) in unruled.items()}


def test_suffix_statistics_equal_brute_force(spark):
    """Out of fold, and none at or below a rule's host."""
    rules = [("block", "bad.xyz/"), ("block", "worse.xyz/"), ("allow", "good.org/")]
    hosts = [f"{w}.{h}" for h in ("bad.xyz", "worse.xyz", "good.org") for w in ("a", "b", "c", "d", "www", "m")] * 2
    df = spark.createDataFrame([(h, h.rsplit(".", 1)[1], ".".join(h.rsplit(".", 2)[1:]), float("good" not in h)) for h in hosts],
                               "host string, s1 string, s2 string, label double").withColumn("fold", urls.fold(F.col("host")))
    got = {(r["s1_key"], r["s1_fold"]): (r["f_s1_rate"], r["f_s1_seen"]) for r in urls.suffix_statistics(df, "s1", 0.5, rules).collect()}
    rows = df.collect()
    for s in ("xyz", "org"):
        for f in range(-1, urls.FOLDS):
            own = [r["label"] for r in rows if r["s1"] == s and r["fold"] != f]
            rate, seen = got[s, f]
            assert abs(rate - (sum(own) + urls.SMOOTHING * 0.5) / (len(own) + urls.SMOOTHING)) < 1e-12 and abs(seen - math.log1p(len(own))) < 1e-12
    assert urls.suffix_statistics(df, "s2", 0.5, rules).count() == 0


def plain_features(url):
    from collections import Counter

    host, path, _ = brute(url)
    query = re.search(r"\?([^#]*)", url)
    query, entropy = query[1] if query else "", lambda t: -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0
    fragment = re.search(r"#(.*)", url)
    return {"f_length": len(url), "f_host_length": len(host), "f_path_length": len(path), "f_depth": path.count("/"),
            "f_labels": host.count(".") + 1, "f_digits": sum(c in "0123456789" for c in url) / len(url), "f_hyphens": sum(c in "-_" for c in url) / len(url),
            "f_entropy": entropy(path + query), "f_host_entropy": entropy(host.rsplit(".", 1)[0] if "." in host else host),
            "f_params": query.count("&") + 1 if query else 0, "f_query_length": len(query), "f_fragment": len(fragment[1]) if fragment else 0,
            "f_secure": int(url.lower().startswith("https://"))}


def test_features_equal_brute_force(spark):
    own = ["http://a-b.example.com/x/y_z/12?q=1&r=2#top", "HTTPS://X.Net", "http://com/", "https://www.a.b.org/a?x#y#z", "http://h/p?", "ftp://1.2.3.4:80/%20"]
    url = F.col("url")
    df = spark.createDataFrame([(u,) for u in own], "url string").withColumn("host", urls.host(url)).withColumn("path", urls.path(url))
    for r in df.withColumns(urls.lexical(url)).collect():
        want = plain_features(r["url"])
        assert {k: round(float(r[k]), 9) for k in want} == {k: round(float(v), 9) for k, v in want.items()}


def test_plan_is_native(spark):
    df = urls.judge(spark.createDataFrame([(1, "http://x.net/es/"), (2, "http://x.com/"), (3, "http://x.org/")], "page_id long, url string"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_suffixes_under_rules_are_no_features(spark, monkeypatch):
    """Statistics are made where they can tell trees something, and nowhere else."""
    made, plain = [], urls.suffix_statistics
    monkeypatch.setattr(urls, "suffix_statistics", lambda df, s, *a: made.append(s) or plain(df, s, *a))
    schema = "page_id long, url string"
    rows = [(i, f"http://h{i}.net/es/{i}" if i % 2 else f"http://h{i}.com/{i}") for i in range(20)] + [(99, "http://x.org/")]
    assert urls.judge(spark.createDataFrame(rows, schema)).count() == 21 and made == []
    rules = [("block", "bad.xyz/"), ("block", "worse.xyz/"), ("allow", "good.org/")]
    rows = [(i, f"http://h{i}.bad.xyz/p" if i % 2 else f"http://h{i}.good.org/p") for i in range(200)] + [(1000, "http://h.xyz/p"), (1001, "http://h.org/p")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, schema), rules).where("rule is null").collect()}
    assert got == {1000: "block", 1001: "allow"} and made == ["s1"]
    assert urls.free_suffixes([("block", "a.b.c/")]) == ["s1", "s2"] and urls.free_suffixes([("block", "b.c/"), ("allow", "c/")]) == []


def test_statistics_of_both_suffixes_are_made_under_any_rules(spark, monkeypatch):
    """Also where all suffixes lie below rules: the trees then get the share of all labelled URLs and the number 0."""
    made, seen, plain, features = [], [], urls.suffix_statistics, urls.with_features
    monkeypatch.setattr(urls, "suffix_statistics", lambda df, s, *a: made.append(s) or plain(df, s, *a))
    monkeypatch.setattr(urls, "with_features", lambda *a, **k: seen.append(features(*a, **k)) or seen[-1])
    own = ["f_s1_rate", "f_s1_seen", "f_s2_rate", "f_s2_seen"]
    rows = [(i, f"http://h{i}.net/es/{i}" if i % 4 else f"http://h{i}.com/{i}") for i in range(20)] + [(99, "http://x.org/")]
    assert urls.judge(spark.createDataFrame(rows, "page_id long, url string")).count() == 21 and made == ["s1", "s2"]
    assert [df.count() for df, _ in seen] == [20, 21] and all(set(own) <= set(names) for _, names in seen)
    assert {tuple(r) for df, _ in seen for r in df.select(own).collect()} == {(0.75, 0.0, 0.75, 0.0)}
    made.clear(), seen.clear()
    rules = [("block", "a.b.xyz/"), ("allow", "c.d.org/")]
    rows = [(i, f"http://h{i}.a.b.xyz/p" if i % 2 else f"http://h{i}.c.d.org/p") for i in range(200)] + [(1000, "http://h.b.xyz/p"), (1001, "http://h.d.org/p")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()}
    assert got == {1000: "block", 1001: "allow"} and made == ["s1", "s2"]
    of = {r["page_id"]: [round(v, 9) for v in r[1:]] for r in seen[1][0].where("rule is null").select("page_id", *own).collect()}
    assert of == {i: [round((ones + 10) / 120, 9), round(math.log1p(100), 9)] * 2 for i, ones in ((1000, 100), (1001, 0))}
