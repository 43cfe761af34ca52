"""Quality classifier: attention-based multiple-instance learning on passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is
encoded as a vector of text statistics and of hashed words; a hidden layer
follows, gated attention gives each passage of a document a weight
(softmax of w . (tanh(V h) * sigmoid(U h))), and the weighted mean of the
hidden vectors is scored. Hidden layer, attention and score are learned
together from document labels alone.

The fit uses at most about ``FIT_DOCS`` labelled documents, one row of each id,
and of these, in order of a hash of the id, as many as have ``FIT_VALUES``
numbers in their passages' vectors (see ``labelled_sample``, ``fit_rows``);
scoring covers every whole text, slice by slice.

Edge cases: a text without words is a bag of one passage of zeros and is scored
like any other; with labels of one class only, or none, every text scores the
share of good labels (1 without any: nothing is rejected); repeated rows get
equal scores; an empty table gives no rows; other columns are ignored by
``score`` and kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.tables import bound_batches, fit_rows, in_training_part, labelled_sample, load, texts
from risklens.llm.words import Slice, slices

PASSAGE_WORDS = 64
HASHED = 16
HIDDEN, GATE = 24, 12
STEPS, RATE, DECAY, SEED = 150, 0.02, 1e-4, 5
THRESHOLD = 0.3
FIT_VALUES = 6_000_000

_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".!?", ",;:'\"-", "|", "#$%&*+/<=>@\\^_`~", "()[]{}", "\n\r")
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)  # the rest: white space and control bytes
for _k, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = len(_CLASSES) + 1
N_CLASSES = len(_CLASSES) + 2
WIDTH = N_CLASSES + 8 + HASHED


def passages(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of a slice, and the bounds of the rows in them."""
    starts, ends, rows = s.words()
    per_row = np.maximum(1, -(-np.diff(rows) // PASSAGE_WORDS))
    bounds = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros((bounds[-1], WIDTH))
    if not len(starts):
        return out, bounds
    place = np.arange(len(starts)) - np.repeat(rows[:-1], np.diff(rows))
    of_word = np.repeat(bounds[:-1], np.diff(rows)) + place // PASSAGE_WORDS
    n = len(out)
    words = np.bincount(of_word, minlength=n)
    first = np.searchsorted(of_word, np.arange(n))
    full = words > 0
    # shares of byte classes between a passage's first and last word
    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    lo[full], hi[full] = starts[first[full]], ends[first[full] + words[full] - 1]
    kinds = _CLASS[s.data]
    size = np.maximum(1, hi - lo)
    for k in range(N_CLASSES):
        sums = np.concatenate([[0], np.cumsum(kinds == k)])
        out[:, k] = (sums[hi] - sums[lo]) / size
    h = s.hashes(starts, ends)
    length = (ends - starts).astype(float)
    n_words = np.maximum(1, words)
    mean = np.bincount(of_word, length, n) / n_words
    spread = np.bincount(of_word, length * length, n) / n_words - mean * mean
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    key = np.unique((of_word.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    distinct = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n)
    ending = _CLASS[s.data[ends - 1]]
    k = N_CLASSES
    out[:, k] = np.log1p(words)
    out[:, k + 1] = mean
    out[:, k + 2] = np.sqrt(np.maximum(0, spread))
    out[:, k + 3] = np.bincount(of_word, same, n) / n_words
    out[:, k + 4] = distinct / n_words
    out[:, k + 5] = np.bincount(of_word, ending == 6, n) / n_words  # words that end in a symbol
    out[:, k + 6] = np.bincount(of_word, ending == 3, n) / n_words  # ... in a sentence's end
    out[:, k + 7] = np.bincount(of_word, length > 25, n) / n_words
    sign = np.where((h >> np.uint64(8)) & np.uint64(1), 1.0, -1.0)
    cell = of_word * HASHED + (h >> np.uint64(60)).astype(np.int64)
    out[:, k + 8:] = np.bincount(cell, sign, n * HASHED).reshape(n, HASHED) / np.sqrt(n_words)[:, None]
    return out, bounds


def _per_bag(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, bounds[:-1], axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Network:
    """Hidden layer, gated attention and score; parameters in ``p``."""

    def __init__(self, p: dict[str, np.ndarray], mean: np.ndarray, sd: np.ndarray, constant: float | None = None):
        self.p, self.mean, self.sd, self.constant = p, mean, sd, constant

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8)

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(bounds)
        h = np.tanh(x @ p["W"] + p["b"])
        t, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bounds[:-1]), n))
        a = e / np.repeat(_per_bag(e, bounds), n)
        z = _per_bag(a[:, None] * h, bounds)
        return {"h": h, "t": t, "u": u, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"][0])}

    def gradient(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f, n = self.p, self.forward(x, bounds), np.diff(bounds)
        g = (f["y"] - y) / len(y)
        gz = np.repeat(g[:, None] * p["c"], n, axis=0)
        ga = (gz * f["h"]).sum(1)
        ge = f["a"] * (ga - np.repeat(_per_bag(f["a"] * ga, bounds), n))
        gt = ge[:, None] * p["w"] * f["u"] * (1 - f["t"] ** 2)
        gu = ge[:, None] * p["w"] * f["t"] * f["u"] * (1 - f["u"])
        gh = (f["a"][:, None] * gz + gt @ p["V"].T + gu @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ gh, "b": gh.sum(0), "V": f["h"].T @ gt, "U": f["h"].T @ gu,
                "w": (f["t"] * f["u"]).T @ ge, "c": f["z"].T @ g, "d": np.array([g.sum()])}

    def scores(self, s: Slice) -> np.ndarray:
        if self.constant is not None:
            return np.full(s.rows, self.constant)
        x, bounds = passages(s)
        return self.forward(self.standard(x), bounds)["y"]

    def attention(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Weight of every passage in its document, and the bounds of the rows."""
        x, bounds = passages(s)
        if self.constant is not None:
            return np.repeat(1 / np.diff(bounds), np.diff(bounds)), bounds
        return self.forward(self.standard(x), bounds)["a"], bounds


def fit(sample: DataFrame) -> Network:
    """Fit on ``doc_id, label, text``, a sample of bounded size."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                x, bounds = passages(s)
                cut = pa.array((bounds * WIDTH).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, s.rows), batch.column("label").slice(s.first, s.rows),
                     pa.ListArray.from_arrays(cut, pa.array(x.astype(np.float32).ravel()))], names=["doc_id", "label", "x"])

    got = fit_rows(sample.mapInArrow(encode, "doc_id long, label int, x array<float>"), ["x"], FIT_VALUES).toPandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")
    y = got["label"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        return Network({}, np.zeros(WIDTH), np.ones(WIDTH), float(y.mean()) if len(y) else 1.0)
    bags = [np.asarray(v, dtype=float).reshape(-1, WIDTH) for v in got["x"]]
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    x = np.concatenate(bags)
    mean, sd = x.mean(0), x.std(0) + 1e-3
    r = np.random.default_rng(SEED)
    p = {"W": r.normal(0, WIDTH ** -0.5, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN),
         "V": r.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
         "w": r.normal(0, GATE ** -0.5, GATE), "c": r.normal(0, HIDDEN ** -0.5, HIDDEN),
         "d": np.array([np.log(y.mean() / (1 - y.mean()))])}
    net = Network(p, mean, sd)
    x = net.standard(x)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, STEPS + 1):
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / STEPS))
        for k, g in net.gradient(x, bounds, y).items():
            g = g + DECAY * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return net


def _scoring(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [net.scores(s) for s in slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(made) if made else np.zeros(0))],
                                             names=["doc_id", "score"])

    return run


def score(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, score`` of every row."""
    return texts(docs).mapInArrow(
        _scoring(net), "doc_id long, score double")


def accepted(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(at)):
                yield batch.slice(s.first, s.rows).filter(pa.array(net.scores(s) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    net = fit(labelled_sample(docs, load(spark, sf_dir, "labels"), "quality"))
    return (score(docs, net).withColumn("held_out", ~in_training_part())
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
            .select("doc_id", "held_out", "score", "predicted"))
