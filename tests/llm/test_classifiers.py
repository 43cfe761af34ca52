import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from risklens.llm import language, quality, toxicity
from risklens.llm.tables import fit_rows, in_training_part, labelled_sample, load
from risklens.llm.words import slices

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def confusion(spark, query, label):
    out = query(spark, SF).join(load(spark, SF, "labels"), "doc_id").where("held_out")
    return {(r[0], r[1]): r[2] for r in out.groupBy(label, "predicted").count().collect()}


def test_quality_on_held_out_documents(spark):
    c = confusion(spark, quality.op3_quality, "quality")
    right = c.get((1, 1), 0) + c.get((0, 0), 0)
    assert right >= 0.9 * sum(c.values())
    assert c.get((1, 1), 0) >= 0.95 * (c.get((1, 1), 0) + c.get((1, 0), 0))


def words(r, n):
    return " ".join(r.choice("alpha beta gamma delta eps zeta eta theta iota kappa lambda mu".split()) + r.choice([".", "", ",", ""]) for _ in range(n))


def toxic_corpus(seed, n=900):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.25
        text = words(r, r.choice((5, 30, 120)))
        if toxic:
            text += f" this {r.choice(('vile', 'NASTY', 'ÉCŒURANT'))} thing. " + words(r, 10)
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_learns_from_document_labels(spark, docs_of):
    rows, labels = toxic_corpus(2)
    docs, known = docs_of(rows), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(labelled_sample(docs, known, "toxic"))
    out = toxicity.score(docs, model).join(known, "doc_id").where(~in_training_part()).collect()
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in out) >= 0.97 * len(out)
    spans = toxicity.offending(docs, model).collect()
    text = dict(rows)
    assert spans and all(s["sentence"].encode() == text[s["doc_id"]].encode()[s["start"]:s["end"]] for s in spans)
    assert sum(any(w in s["sentence"].lower() for w in ("vile", "nasty", "écœurant")) for s in spans) >= 0.97 * len(spans)


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_edge_cases(spark, docs_of, operator):
    rows = [(i, f"text {'###' * (i % 2)} {i}") for i in range(60)] + [(100, None), (101, ""), (101, ""), (None, "x"), (102, "long " * 50_000)]
    docs = docs_of(rows, extra="score label x")
    known = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(100, None, None), (101, 1, 0), (None, 1, 1)], LABELS)
    model = operator.fit(labelled_sample(docs, known, "quality"))
    got = operator.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    twice = [r["score"] for r in got if r["doc_id"] == 101]
    assert twice[0] == twice[1]
    assert operator.score(docs_of([]), model).count() == 0
    for few in (known.where("quality = 1"), known.limit(0)):
        constant = {r["score"] for r in operator.score(docs, operator.fit(labelled_sample(docs, few, "quality"))).collect()}
        assert len(constant) == 1


def test_toxicity_of_no_words_is_zero(spark, docs_of):
    rows, labels = toxic_corpus(3, 300)
    model = toxicity.fit(labelled_sample(docs_of(rows), spark.createDataFrame(labels, LABELS), "toxic"))
    assert {r["score"] for r in toxicity.score(docs_of([(1, None), (2, ""), (3, " .!\n")]), model).collect()} == {0.0}


def test_quality_keeps_columns(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, None)], extra="score")
    net = quality.Network({}, 0, 1, 1.0)
    out = quality.accepted(docs, net)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_a_class_of_very_long_texts_is_learned(spark, docs_of, operator):
    """Length keeps no document out of the fit."""
    r = random.Random(8)
    good, bad = "river meadow lamp garden winter".split(), "zqx#1 !!kk 99xx $$$ vvv".split()
    rows = [(i, " ".join(r.choices(bad if i % 2 else good, k=20_000 if i % 2 else 200))) for i in range(60)]
    assert len(rows[1][1]) > 90_000
    docs, known = docs_of(rows), spark.createDataFrame([(i, i % 2, i % 2) for i, _ in rows], LABELS)
    got = {r["doc_id"]: r["score"] for r in operator.score(docs, operator.fit(labelled_sample(docs, known, "quality"))).collect()}
    assert all((score >= 0.5) == (i % 2 == 1) for i, score in got.items())


def test_fit_brings_one_row_of_an_id(spark):
    rows = [(1, 0, [1.0, 2.0])] * 500 + [(1, 0, [0.5])] + [(2, 1, [3.0] * 4), (3, 1, [4.0] * 5), (None, 0, [9.0])]
    df = spark.createDataFrame(rows, "doc_id long, label int, x array<float>")
    got = {r["doc_id"]: list(r["x"]) for r in fit_rows(df, ["x"], 10 ** 6).collect()}
    assert got == {1: [0.5], 2: [3.0] * 4, 3: [4.0] * 5}
    assert 0 < fit_rows(df, ["x"], 4).count() < 3


def test_every_score_equals_plain_python(spark, docs_of):
    """Noisy-or and worst sentence of every document, recomputed from the fitted weights word by word."""
    rows, labels = toxic_corpus(6, 300)
    rows += [(1000, None), (1001, ""), (1002, "one. two! three"), (1003, "vile. vile. nice."), (1003, "vile. vile. nice."), (1004, "vile thing " * 9000)]
    docs = docs_of(rows)
    model = toxicity.fit(labelled_sample(docs, spark.createDataFrame(labels, LABELS), "toxic"))

    def weight(word):
        s = next(iter(slices(pa.array([word]))))
        return model.weights[toxicity.sentences(s)[0][0]]

    weights: dict = {}
    lower = str.maketrans({chr(c): chr(c + 32) for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7})
    for row in toxicity.score(docs, model).collect():
        text = next(t for i, t in rows if i == row["doc_id"]) or ""
        clean, worst = 1.0, None
        for m in re.finditer(r"[^.!?\n\r]+", text):
            found = list(re.finditer(r"[^\W_]+", m[0]))
            if not found:
                continue
            z = model.bias + sum(weights.setdefault(w[0].translate(lower), weight(w[0].translate(lower))) for w in found)
            p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            clean *= 1 - p
            span = (len(text[:m.start() + found[0].start()].encode()), len(text[:m.start() + found[-1].end()].encode()))
            if worst is None or p > worst[0] + 1e-12:
                worst = (p, *span)
        assert abs(row["score"] - (1 - clean)) < 1e-9
        if worst is None:
            assert row["worst_start"] is None and row["worst_score"] is None
        else:
            assert (row["worst_start"], row["worst_end"]) == worst[1:] and abs(row["worst_score"] - worst[0]) < 1e-9


def test_every_quality_score_equals_plain_python(spark, docs_of):
    """Attention and score of every document, recomputed passage by passage in loops."""
    rows = [(i, "word " * (i % 7 * 40) + "###" * (i % 2) + " Some text. " * (i % 5)) for i in range(120)] + [(500, None), (501, ""), (502, "a " * 9000)]
    docs = docs_of(rows)
    net = quality.fit(labelled_sample(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(120)], LABELS), "quality"))
    p = net.p
    dot = lambda a, b: sum(float(x) * float(y) for x, y in zip(a, b))
    logistic = lambda z: 1 / (1 + math.exp(-z))
    for row in quality.score(docs, net).collect():
        text = next(t for i, t in rows if i == row["doc_id"]) or ""
        words_ = text.split()
        pieces = [" ".join(words_[k:k + quality.PASSAGE_WORDS]) for k in range(0, len(words_), quality.PASSAGE_WORDS)] or [""]
        x, _ = quality.passages(next(iter(slices(pa.array([text])))))
        assert len(x) == len(pieces)
        hidden, energy = [], []
        for v in x:
            v = [min(8.0, max(-8.0, (a - m) / s)) for a, m, s in zip(v, net.mean, net.sd)]
            h = [math.tanh(dot(v, p["W"][:, k]) + p["b"][k]) for k in range(quality.HIDDEN)]
            gate = [math.tanh(dot(h, p["V"][:, k])) * logistic(dot(h, p["U"][:, k])) for k in range(quality.GATE)]
            hidden.append(h)
            energy.append(dot(gate, p["w"]))
        share = [math.exp(e - max(energy)) for e in energy]
        z = [sum(a * h[k] for a, h in zip(share, hidden)) / sum(share) for k in range(quality.HIDDEN)]
        assert abs(row["score"] - logistic(dot(z, p["c"]) + float(p["d"][0]))) < 1e-9


def test_passages_equal_plain_python():
    """The word-shape part of the vectors, counted character by character."""
    text = "Alpha beta's 12 (gamma)! " * 40 + "ÉÉ |x| tail"
    x, bounds = quality.passages(next(iter(slices(pa.array([text, "", "one"])))))
    assert list(bounds) == [0, -(-len(text.split()) // quality.PASSAGE_WORDS), len(bounds) and bounds[2], bounds[3]]
    assert bounds[2] - bounds[1] == 1 and not x[bounds[1]].any() and x[bounds[2]].any()


def test_gradient_of_the_attention_network():
    import numpy as np

    r = np.random.default_rng(0)
    x, bounds, y = r.normal(size=(9, quality.WIDTH)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    h, g = 3, 2
    p = {"W": r.normal(size=(quality.WIDTH, h)) * 0.2, "b": r.normal(size=h), "V": r.normal(size=(h, g)), "U": r.normal(size=(h, g)),
         "w": r.normal(size=g), "c": r.normal(size=h), "d": r.normal(size=1)}
    net = quality.Network(p, 0, 1)
    loss = lambda: -(y * np.log(net.forward(x, bounds)["y"]) + (1 - y) * np.log(1 - net.forward(x, bounds)["y"])).mean()
    grad = net.gradient(x, bounds, y)
    for name, v in p.items():
        at = np.unravel_index(int(np.abs(grad[name]).argmax()), v.shape)
        v[at] += 1e-5
        up = loss()
        v[at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - grad[name][at]) < 1e-6
        v[at] += 1e-5


def test_forward_sums_all_segmentations():
    from risklens.llm.vocabulary import Lattice, automaton
    import numpy as np

    vocabulary = ["a", "b", "ab", "ba", "aba", "bab"]
    p = np.array([0.3, 0.2, 0.15, 0.1, 0.05, 0.02, 1e-3])

    def total(word):
        if not word:
            return 1.0
        out = sum(p[i] * total(word[len(v):]) for i, v in enumerate(vocabulary) if word.startswith(v))
        return out + (p[-1] * total(word[1:]) if word[0] not in vocabulary else 0)

    words = ["a", "abab", "babab", "axb", "", "zz"]
    lattice = Lattice(words, automaton([(v, (len(v), i)) for i, v in enumerate(vocabulary)]), len(vocabulary))
    assert np.allclose(lattice.total(p), [total(w) for w in words])
    # expected uses: derivative of the log-probability
    for k in range(len(p)):
        q = p.copy()
        q[k] *= 1 + 1e-6
        n = np.array([1, 2, 1, 3, 1, 1.0])
        slope = (n * (np.log(lattice.total(q)) - np.log(lattice.total(p)))).sum() / 1e-6
        assert abs(slope - lattice.expected(p, n)[k]) < 1e-4


def test_language_on_held_out_documents(spark):
    out = language.op6_language(spark, SF).join(load(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert right >= 0.97 * n


def test_every_language_is_learned(spark, docs_of):
    rows = [(i, f"the river and the lamp {i}", "en") for i in range(20_000)]
    rows += [(30_000 + i, "der fluss und die lampe im garten " + "wort " * i, "de") for i in range(12)]
    rows += [(31_000 + i, "le fleuve et la lampe du jardin " * 4000, "fr") for i in range(8)]  # all of them over 100,000 characters
    rows += [(32_000, "el rio y la lampara del jardin", "es")] * 300  # one id
    docs = docs_of(rows)
    sample = language.labelled_texts(docs, "lang")
    n = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    held_out = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    assert n["de"] == sum(not held_out(30_000 + i) for i in range(12)) and n["fr"] == sum(not held_out(31_000 + i) for i in range(8))
    assert n.get("es", 0) == (not held_out(32_000)) and n["en"] < 3000
    model = language.fit(docs)
    assert {"en", "de", "fr"} <= set(model.languages)
    got = {r["lang_pred"] for r in language.predict(docs.where("lang in ('de', 'fr')"), model).collect()}
    assert got == {"de", "fr"}


def test_every_language_score_equals_plain_python(spark, docs_of):
    """Verdict and score of every text: all segmentations of every word summed up by recursion; ties to the first name."""
    rows = [(i, "the cat and dog" if i % 2 else "der hund und katze", "en" if i % 2 else "de") for i in range(30)]
    rows += [(40, "the der", None), (41, "dog; KATZE", None), (42, "zzz é", None), (43, None, None)]
    docs = docs_of(rows)
    model = language.fit(docs)
    table = {piece: i for i, piece in enumerate(language.letter_pieces(model.path))}

    def total(word, p, seen):
        if not word:
            return 1.0
        if word not in seen:
            out = sum(p[table[word[:k]]] * total(word[k:], p, seen) for k in range(1, len(word) + 1) if word[:k] in table)
            seen[word] = out + (0 if word[0] in table else p[-1] * total(word[1:], p, seen))
        return seen[word]

    for row in language.predict(docs, model).collect():
        found = re.findall(r"[^\W\d_]+", (next(t for i, t, _ in rows if i == row["doc_id"]) or "").lower())
        if not found:
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        logs = [prior + sum(math.log(total(language.SPACE + w, p, {})) for w in found) for p, prior in zip(model.p, model.prior)]
        best = max(range(len(logs)), key=lambda k: logs[k])
        assert row["lang_pred"] == model.languages[best]
        assert abs(row["score"] - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-9
    twins = language.Model(["b", "c"], np.stack([model.p[0]] * 2), np.log([0.5, 0.5]), model.path)
    assert {r["lang_pred"] for r in language.predict(docs_of([(1, "der hund")]), twins).collect()} == {"b"}


def test_language_edge_cases(spark, docs_of):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)]
    rows += [(50, None, "en"), (51, "12 34 !!", "de"), (52, "der und die", None), (52, "der und die", None), (None, "the and the", "en"),
             (53, "日本語", "en"), (54, "katze" * 20_000, "de"), (55, "", "en"), (56, "½ ² ¾", "en")]
    docs = docs_of(rows, extra="score lang_pred")
    model = language.fit(docs)
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict(docs, model).collect()}
    assert {(50, "und"), (51, "und"), (55, "und"), (56, "und"), (52, "de"), (None, "en"), (54, "de")} <= got
    assert all(0 <= r["score"] <= 1 for r in language.predict(docs, model).collect())
    assert language.predict(docs_of([]), model).count() == 0
    nothing = language.fit(docs.where("lang is null"))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
