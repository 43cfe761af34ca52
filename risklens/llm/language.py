"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability in a language is the sum over all its segmentations into
pieces, by the forward algorithm over the matches an Aho-Corasick automaton
gives; a text's is the product over its words. Words are maximal runs of
letters, lower-cased, with the vocabulary's word-start sign before them; runs of
over ``LONGEST`` letters are cut. A letter that is no piece has the same small
probability in all languages.

The piece probabilities are learned by expectation-maximisation (expected uses
by forward and backward sums) on the words of a bounded sample of labelled
texts, language by language: of each the ids of the smallest hashes, about its
share of ``FIT_DOCS`` and ``LEAST_DOCS`` at least, one row of an id, and of these
as many as hold its share of ``FIT_CHARS`` characters, so that every labelled
language is learned. Prediction covers every whole text.

Edge cases: a text that is null or has no letter is ``und`` with score 0; with no
labelled text every text is ``und``; equal scores go to the first language in
order of code points; repeated rows get equal results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklens.llm.tables import bound_batches, in_training_part, join_small, load, texts, written
from risklens.llm.vocabulary import SPACE, Lattice, automaton, default_vocabulary, pieces
from risklens.llm.words import kept, text_slices

FIT_DOCS, FIT_CHARS, LEAST_DOCS = 4_000, 24_000_000, 200
ROUNDS, ADDED = 3, 0.05
LONGEST = 40
UNKNOWN_LETTER = 1e-7
CACHED_WORDS = 400_000
BATCH_WORDS = 20_000

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    found = _LETTERS.findall(text.lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i:i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def letter_pieces(path: str) -> list[str]:
    """The vocabulary's pieces that can occur in a word: lower-case letters, with or without a word start."""
    return kept(f"letter pieces of {path}", lambda: _letter_pieces(path))


def _letter_pieces(path: str) -> list[str]:
    out = []
    for piece, _ in pieces(path):
        body = piece.removeprefix(SPACE)
        if body.isalpha() and body == body.lower():
            out.append(piece)
    return [*out, SPACE]


def _trie(path: str):
    return automaton([(p, (len(p), i)) for i, p in enumerate(letter_pieces(path))])


class Model:
    """``p[language, piece]``; the last piece stands for a letter that is none."""

    def __init__(self, languages: list[str], p: np.ndarray, prior: np.ndarray, path: str):
        self.languages, self.p, self.prior, self.path = languages, p, prior, path


class Scorer:
    """Log-probabilities of words, kept for the task's next texts."""

    def __init__(self, model: Model):
        self.model, self.trie = model, kept(f"letters of {model.path}", lambda: _trie(model.path))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages)))

    def learn(self, words: list[str]) -> None:
        made = [self.rows]
        for lo in range(0, len(words), BATCH_WORDS):
            part = words[lo:lo + BATCH_WORDS]
            lattice = Lattice([SPACE + w for w in part], self.trie, self.model.p.shape[1] - 1)
            made.append(np.stack([np.log(lattice.total(p)) for p in self.model.p], axis=1))
            n = len(self.known)
            self.known.update(zip(part, range(n, n + len(part))))
        self.rows = np.concatenate(made)

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        split = [words_of(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.clear()
        self.learn(list({w for words in split for w in words if w not in self.known}))
        known = self.known
        at = np.fromiter((known[w] for words in split for w in words), np.int64)
        n = np.array([len(words) for words in split])
        sums = np.zeros((len(at) + 1, self.rows.shape[1]))
        np.cumsum(self.rows[at], axis=0, out=sums[1:])
        ends = np.cumsum(n)
        total = sums[ends] - sums[ends - n] + self.model.prior
        total -= total.max(1, keepdims=True)
        best = total.argmax(1)
        score = 1 / np.exp(total).sum(1)
        # runs of word characters can be fractions or superscripts alone
        known = [k > 0 and any(map(str.isalpha, t)) for k, t in zip(n, texts)]
        names = [self.model.languages[b] if k else "und" for b, k in zip(best, known)]
        return names, np.where(known, score, 0.0)


def labelled_texts(docs: DataFrame, lang: str) -> DataFrame:
    """``lang, text`` of the sample that is learned from."""
    known = docs.where(F.col(lang).isNotNull() & in_training_part()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    held = written(known.groupBy(F.col("lang").alias("s_lang")).agg(F.approx_count_distinct("doc_id").alias("ids")), "languages")
    n = max(1, held.count())
    most, chars = max(LEAST_DOCS, FIT_DOCS // n), FIT_CHARS // n
    # a tenth more than the share, for the count is approximate
    below = F.least(F.lit(1.0), 1.1 * most / F.col("ids")) * (1 << 32)
    rank = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 32))
    sample = written(join_small(known, held, F.col("lang") == F.col("s_lang"), "inner").where(rank < below)
                     .groupBy("lang", "doc_id").agg(F.min("text").alias("text")), "language-sample")
    order = Window.partitionBy("lang").orderBy(rank, "doc_id")  # of the sampled ids alone
    ahead = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    taken = sample.select("lang", "doc_id", F.coalesce(ahead, F.lit(0)).alias("ahead")).where(F.col("ahead") < chars)
    return sample.join(taken.select("lang", "doc_id"), ["lang", "doc_id"]).select("lang", "text")


def fit(docs: DataFrame, lang: str = "lang", vocabulary: str | None = None) -> Model:
    """Learn the piece probabilities of the languages in column ``lang`` of the training part."""
    bound_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    sample = labelled_texts(docs, lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            langs, out = batch.column("lang").to_pylist(), {}
            for first, texts in text_slices(batch.column("text")):
                for i, t in enumerate(texts):
                    out.setdefault(langs[first + i], Counter()).update(words_of(t))
            rows = [(k, w, n) for k, c in out.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                              pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    counts = (sample.mapInArrow(count, "lang string, word string, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "word"], kind="stable"))
    trie, n_pieces = _trie(path), len(letter_pieces(path)) + 1
    languages = sorted(counts["lang"].unique(), key=lambda x: x.encode())
    probabilities, totals = [], []
    for name in languages:
        own = counts[counts["lang"] == name]
        lattice = Lattice([SPACE + w for w in own["word"]], trie, n_pieces - 1)
        n = own["n"].to_numpy(float)
        p = np.full(n_pieces, 1 / n_pieces)
        for _ in range(ROUNDS):
            p[-1] = UNKNOWN_LETTER
            used = lattice.expected(p, n)[:-1] + ADDED
            p = np.append(used / used.sum(), UNKNOWN_LETTER)
        probabilities.append(p)
        totals.append(n.sum())
    return Model(languages, np.array(probabilities).reshape(len(languages), n_pieces),
                 np.log(np.array(totals) / max(1.0, sum(totals))) if languages else np.zeros(0), path)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model.languages else None
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in text_slices(batch.column("text")):
                names, score = scorer(texts) if scorer else (["und"] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(names, pa.string()), pa.array(score)],
                                                 names=["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return (predict(docs, fit(docs)).withColumn("held_out", ~in_training_part())
            .select("doc_id", "held_out", "lang_pred", "score"))
