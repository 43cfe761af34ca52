"""Toxicity by multiple-instance learning on sentences.

A document is a bag of sentences. A sentence's probability of being toxic is
logistic in the hashed words it holds; the document's is their noisy-or,
1 - prod(1 - p). Weights are learned from document labels alone, by gradient
descent on the documents' log-likelihood, so that the model itself finds out
which sentences of a toxic document offend. Words whose presence in a document
says little about its label (log-likelihood ratio under ``LEAST_GAIN``) have
weight 0. ``offending`` returns the sentences whose own probability reaches the
threshold, ``score`` the worst sentence of every text.

Words are runs of ASCII letters and digits and non-ASCII bytes, lower-cased in
ASCII and Latin-1; a sentence ends at ``.``, ``!``, ``?`` or a line's end. The fit uses
at most about ``FIT_DOCS`` labelled documents, one row of each id, and of these,
in order of a hash of the id, as many as hold ``FIT_WORDS`` words (see
``labelled_sample``, ``fit_rows``); scoring covers every whole text.

Edge cases: a text without words (null, empty, white space) scores 0; with
labels of one class only, or none, every text scores the share of toxic labels
(0 without any) and no sentence is the worst; of sentences with equal scores
the first is; repeated rows get equal scores; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.tables import fit_rows, in_training_part, labelled_sample, load, texts
from risklens.llm.words import ALNUM, Slice, segment_sums, slices

BITS = 18
STEPS, RATE, DECAY, LEAST_GAIN = 150, 0.1, 1e-5, 15.0
THRESHOLD = 0.5
FIT_WORDS = 8_000_000

_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n\r"]] = True


def sentences(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words of a slice: bucket of each word, bounds of the sentences in
    words, bounds of the rows in sentences, and the words' starts and ends."""
    starts, ends, rows = s.words(ALNUM)
    bucket = (s.hashes(starts, ends, latin=True) >> np.uint64(64 - BITS)).astype(np.int64)
    if not len(starts):
        return bucket, np.zeros(1, np.int64), np.zeros(len(rows), np.int64), starts, ends
    closed = np.cumsum(_END[s.data], dtype=np.int64)[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = closed[1:] != closed[:-1]
    new[rows[:-1][rows[:-1] < len(starts)]] = True
    first = np.flatnonzero(new)
    return bucket, np.append(first, len(starts)), np.searchsorted(first, rows), starts, ends


def _log_clean(logit: np.ndarray) -> np.ndarray:
    """log(1 - p) of a logit."""
    return -np.logaddexp(0, logit)


class Model:
    """Word weights by bucket, and the sentence's bias."""

    def __init__(self, weights: np.ndarray, bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant = weights, bias, constant

    def logits(self, bucket: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return segment_sums(self.weights[bucket], bounds) + self.bias

    def scores(self, s: Slice) -> np.ndarray:
        if self.constant is not None:
            return np.full(s.rows, self.constant)
        bucket, bounds, rows, _, _ = sentences(s)
        return -np.expm1(segment_sums(_log_clean(self.logits(bucket, bounds)), rows))


def _gain(pairs: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each bucket the log-likelihood ratio between documents' labels and
    holding one of its words; ``pairs``: document * 2**BITS + bucket, distinct."""
    bucket, label = pairs & ((1 << BITS) - 1), y[pairs >> BITS]
    n, ones = np.bincount(bucket, minlength=1 << BITS), np.bincount(bucket, label, 1 << BITS)
    table = ((ones, n, y.sum()), (n - ones, n, len(y) - y.sum()),
             (y.sum() - ones, len(y) - n, y.sum()), (len(y) - y.sum() - n + ones, len(y) - n, len(y) - y.sum()))
    out = np.zeros(1 << BITS)
    for seen, row, column in table:
        expected = np.maximum(row * column / len(y), 1e-12)
        out += 2 * seen * np.log(np.maximum(seen, 1e-300) / expected)
    return out


def fit(sample: DataFrame) -> Model:
    """Fit on ``doc_id, label, text``, a sample of bounded size."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("doc_id"), batch.column("label")
            for s in slices(batch.column("text")):
                bucket, bounds, rows, _, _ = sentences(s)
                out = []
                for i in range(s.rows):
                    b = bounds[rows[i]:rows[i + 1] + 1]
                    words = bucket[b[0]:b[-1]] if len(b) > 1 else bucket[:0]
                    out.append((words.astype(np.int32), np.diff(b).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(s.first, s.rows), labels.slice(s.first, s.rows),
                     pa.array([w for w, _ in out], pa.list_(pa.int32())), pa.array([n for _, n in out], pa.list_(pa.int32()))],
                    names=["doc_id", "label", "words", "sizes"])

    got = fit_rows(sample.mapInArrow(hashed, "doc_id long, label int, words array<int>, sizes array<int>"),
                   ["words", "sizes"], FIT_WORDS).toPandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")
    y = got["label"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 0.0, float(y.mean()) if len(y) else 0.0)
    words = np.concatenate([np.asarray(w, dtype=np.int64) for w in got["words"]])
    sizes = np.concatenate([np.asarray(n, dtype=np.int64) for n in got["sizes"]])
    n_sentences = np.array([len(n) for n in got["sizes"]])
    of_word, of_sentence = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(y)), n_sentences)
    pairs = np.unique(of_sentence[of_word] * (1 << BITS) + words)
    kept = _gain(pairs, y)[words] >= LEAST_GAIN
    words, of_word = words[kept], of_word[kept]
    used, words = np.unique(words, return_inverse=True)
    w, bias = np.zeros(len(used)), float(np.log(y.mean() / max(1.0, n_sentences.mean())))
    moments = np.zeros((2, len(used) + 1))
    for step in range(1, STEPS + 1):
        logit = np.bincount(of_word, w[words], len(sizes)) + bias
        clean = np.bincount(of_sentence, _log_clean(logit), len(y))
        p = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-12)
        # d loss / d logit of a sentence: (1 - y) * p_s - y * p_s * (1 - p) / p
        by_doc = (1 - y) - y * (1 - p) / p
        g = by_doc[of_sentence] / (1 + np.exp(-np.clip(logit, -500, 500)))
        grad = np.append(np.bincount(words, g[of_word], len(used)) / len(y) + DECAY * w, g.sum() / len(y))
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad * grad
        move = RATE * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.99 ** step)) + 1e-6)
        w -= move[:-1]
        bias -= move[-1]
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return Model(weights, bias)


def worst_sentences(model: Model, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a slice: whether it has a sentence, and the start and end (in bytes) and probability of the worst."""
    start, end, p = np.zeros(s.rows, np.int64), np.zeros(s.rows, np.int64), np.zeros(s.rows)
    bucket, bounds, rows, starts, ends = sentences(s)
    has = np.diff(rows) > 0
    if model.constant is not None or not has.any():
        return np.zeros(s.rows, dtype=bool), start, end, p
    logit = model.logits(bucket, bounds)
    most = np.maximum.reduceat(logit, rows[:-1][has])
    at = np.flatnonzero(logit == np.repeat(most, np.diff(rows)[has]))
    row, first = np.unique(np.searchsorted(rows, at, side="right") - 1, return_index=True)
    at = at[first]
    start[row], end[row] = starts[bounds[at]] - s.offsets[row], ends[bounds[at + 1] - 1] - s.offsets[row]
    p[row] = 1 / (1 + np.exp(-logit[at]))
    return has, start, end, p


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, worst_start, worst_end, worst_score`` of every row: the
    document's probability, and place (in UTF-8 bytes) and probability of its
    worst sentence, null where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                has, start, end, p = worst_sentences(model, s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, s.rows), pa.array(model.scores(s)),
                     pa.array(start, mask=~has), pa.array(end, mask=~has), pa.array(p, mask=~has)],
                    names=["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    return texts(docs).mapInArrow(
        run, "doc_id long, score double, worst_start long, worst_end long, worst_score double")


def offending(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, start, end, sentence, score``: every sentence whose own
    probability reaches the threshold; start and end in UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                bucket, bounds, rows, starts, ends = sentences(s)
                if not len(starts) or model.constant is not None:
                    continue
                p = 1 / (1 + np.exp(-model.logits(bucket, bounds)))
                at = np.flatnonzero(p >= threshold)
                row = np.searchsorted(rows, at, side="right") - 1
                lo, hi = starts[bounds[at]], ends[bounds[at + 1] - 1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row + s.first)), pa.array(lo - s.offsets[row]), pa.array(hi - s.offsets[row]),
                     pa.array([bytes(s.data[a:b]).decode() for a, b in zip(lo, hi)], pa.string()), pa.array(p[at])],
                    names=["doc_id", "start", "end", "sentence", "score"])

    return texts(docs).mapInArrow(
        run, "doc_id long, start long, end long, sentence string, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs, load(spark, sf_dir, "labels"), "toxic"))
    return (score(docs, model).withColumn("held_out", ~in_training_part())
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
            .select("doc_id", "held_out", "score", "predicted", "worst_start", "worst_end", "worst_score"))
