"""Token counts by a count-only Viterbi search over a unigram vocabulary.

The tokenizer is the tokenizers library's Unigram model on the pieces and
scores of a public vocabulary, with byte fallback, after a metaspace
pre-tokeniser (each space becomes a word start; one is put before the text).
Per word, an Aho-Corasick automaton enumerates all pieces that match, and for
each position only the best score and the number of pieces are kept: no
segmentation is built. Ties as in the library: of equal scores, the piece that
starts first wins; a character that is no piece scores the vocabulary's lowest
score less 10, and counts its UTF-8 bytes.

Words are counted once per task while they stay in a cache of bounded size.

Edge cases: a null or empty text has 0 tokens; an empty table gives no rows;
repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.tables import load, texts
from risklens.llm.vocabulary import SPACE, automaton, default_vocabulary, pieces
from risklens.llm.words import kept, text_slices

UNKNOWN_PENALTY = 10.0
#: Words that a Python worker keeps, and characters of the longest one it keeps: a text without spaces is one word.
CACHED_WORDS, CACHED_CHARS = 300_000, 64


class Counter:
    """Number of tokens, and score, of a word."""

    def __init__(self, path: str):
        vocabulary = pieces(path)
        self.trie = automaton([(p, (len(p), s)) for p, s in vocabulary if p])
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def word(self, word: str) -> tuple[int, float]:
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        matches = self.trie.iter(word)  # in order of their ends
        last, piece = next(matches, (n, None))
        for end in range(1, n + 1):
            here = []
            while last < end:
                here.append(piece)
                last, piece = next(matches, (n, None))
            single = False
            top = tokens = None
            if len(here) > 1:
                here.sort(reverse=True)  # first starts first
            for size, score in here:
                single = single or size == 1
                got = best[end - size] + score
                if top is None or got > top:
                    top, tokens = got, count[end - size] + 1
            if not single:
                got = best[end - 1] + self.unknown
                if top is None or got > top:
                    top, tokens = got, count[end - 1] + len(word[end - 1].encode())
            best[end], count[end] = top, tokens
        return count[n], best[n]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        words = (text[1:] if text.startswith(SPACE) else text).split(SPACE)
        known, total = self.known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.word(SPACE + w)[0]
                if len(w) <= CACHED_CHARS:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    known[w] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``doc_id, text``."""
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(f"counts of {path}", lambda: Counter(path))
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(texts)), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(np.fromiter(map(counter, texts), np.int64, len(texts)))], names=["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs)
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"))
