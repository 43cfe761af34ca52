"""Benchmark decontamination: CGK embedding and bit-sampling search.

A document leaks a benchmark item of L words if some stretch of it is within
``floor(EDITS * L)`` word edits (insertions, deletions, substitutions) of the
item. Words are runs of ASCII letters and digits and non-ASCII bytes,
lower-cased in ASCII and Latin-1, so that case and punctuation don't count.

1. Windows. A stretch within k edits of an item holds a run of at least
   g = ceil((L - k) / (k + 1)) of its words unchanged, so only item-sized windows
   on the diagonal of a shared g-gram can match; no other window is embedded.
2. Search. The Chakraborty-Goldenberg-Koucky random walk embeds a window of L
   words into 3L symbols so that edits become few substitutions. Each of several
   walks is sampled at few positions, several times; a window and an item of the
   same length that agree in one sample are a candidate pair. The number of walks
   is the least that finds ``RECALL`` of items with k random edits, measured by
   simulation on the items themselves.
3. Verification. The exact least number of word edits between the item and any
   stretch around the window, by dynamic programming.

The items are a stated query set; they are compared with the documents in
blocks of ``BLOCK_WORDS`` words, each block in one pass over the documents
without a shuffle. The driver holds one block's index at a time.

Edge cases: items and texts that are null or have no words take no part; items
of under 5 words match without edits only; repeated rows give a row each; an
empty table of either kind finds nothing; other columns are ignored by
``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.tables import bound_batches, load, texts, written
from risklens.llm.words import ALNUM, Slice, mix64, ragged, slices

EDITS, RECALL = 0.2, 0.97
SAMPLES, POSITIONS, MOST_WALKS = 8, 2, 16
BLOCK_WORDS = 500_000
WINDOWS = 2048
SEED = 3

_U = np.uint64
_PLACE = mix64(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def grams(words: np.ndarray, g: int) -> np.ndarray:
    """Hash of the g words from each position on."""
    n = len(words) - g + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(g):
        out += words[i:i + n] * _PLACE[i]
    return mix64(out)


def walk(symbols: np.ndarray, walks: int, steps: int) -> np.ndarray:
    """CGK embedding of the rows of ``symbols`` (0: past the end): ``[step, walk, row]``.
    At every step a walk writes its row's current symbol and goes on to the
    next one or stays, as a random function of step and symbol says."""
    n, width = symbols.shape
    padded = np.concatenate([symbols, np.zeros((n, 1), np.uint64)], axis=1)
    choice = mix64(np.arange(steps * MOST_WALKS, dtype=np.uint64) + _U(SEED << 32)).reshape(steps, MOST_WALKS)[:, :walks] | _U(1)
    at, row = np.zeros((walks, n), np.int64), np.arange(n)[None, :]
    out = np.zeros((steps, walks, n), np.uint64)
    for j in range(steps):
        now = padded[row, at]
        out[j] = now
        at = np.minimum(at + ((now * choice[j][:, None]) >> _U(63)).astype(np.int64), width)
    return out


def keys(embedded: np.ndarray, length: int) -> np.ndarray:
    """Keys of all samples of embeddings of sequences of ``length`` words: ``[row, sample]``."""
    walks = embedded.shape[1]
    r = np.random.default_rng([SEED, length])
    chosen = r.integers(0, 3 * length, (MOST_WALKS, SAMPLES, POSITIONS))[:walks]
    out = []
    for c in range(walks):
        for b in range(SAMPLES):
            key = np.full(embedded.shape[2], (length << 20) + (c << 8) + b, dtype=np.uint64)
            for x in chosen[c, b]:
                key = mix64(key + embedded[x, c])
            out.append(key)
    return np.stack(out, axis=1)


def allowed(length: np.ndarray | int) -> np.ndarray | int:
    return np.floor(EDITS * np.asarray(length) + 1e-9).astype(np.int64)


def distances(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between row i of ``items`` and any stretch of row i of
    ``texts`` (0: past the end), and the end of the first such stretch."""
    n, width = texts.shape
    across = np.arange(width + 1)
    before = np.zeros((n, width + 1), np.int64)
    for i in range(items.shape[1]):
        now = before + 1
        now[:, 1:] = np.minimum(now[:, 1:], before[:, :-1] + (texts != items[:, i:i + 1]))
        before = np.minimum.accumulate(now - across, axis=1) + across
    end = before.argmin(axis=1)
    return before[np.arange(n), end], end


class Index:
    """Anchors and sampled keys of a block of items. ``words``: their word hashes."""

    def __init__(self, ids: list[int], words: list[np.ndarray]):
        self.ids = np.array(ids, dtype=np.int64)
        self.words = words
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        k = allowed(self.length)
        size = -(-(self.length - k) // (k + 1))
        self.anchors = {}
        for g in sorted(set(size.tolist())):
            found = [(h, i, q) for i in np.flatnonzero(size == g) for q, h in enumerate(grams(words[i], g).tolist())]
            found.sort()
            self.anchors[g] = tuple(np.array(x, dtype=t) for x, t in zip(zip(*found), (np.uint64, np.int64, np.int64)))
        self.walks, self.recall = self.calibrate()
        self.sampled = self.recall >= RECALL
        pairs = []
        for length in set(self.length.tolist()):
            own = np.flatnonzero(self.length == length)
            made = keys(walk(np.stack([words[i] for i in own]), self.walks, 3 * length), length)
            pairs += [(x, i) for i, row in zip(own.tolist(), made.tolist()) for x in row]
        pairs = sorted(set(pairs))
        self.keys = np.array([x for x, _ in pairs], dtype=np.uint64)
        self.key_item = np.array([i for _, i in pairs], dtype=np.int64)

    def calibrate(self, trials: int = 4, most_items: int = 200) -> tuple[int, float]:
        """The least number of walks that finds RECALL of the items after as many
        random edits as are allowed, amid other words, by the windows that the
        search would look at; and the share that they find."""
        r = np.random.default_rng(SEED)
        fresh = lambda n: r.integers(1, 1 << 62, n).tolist()
        found = []
        for i in np.argsort(mix64(self.ids.astype(np.uint64)))[:most_items]:
            length = int(self.length[i])
            own = keys(walk(self.words[i][None, :], MOST_WALKS, 3 * length), length).reshape(MOST_WALKS, SAMPLES)
            for _ in range(trials):
                words = self.words[i].tolist()
                for _ in range(int(allowed(length))):
                    at, kind = int(r.integers(0, len(words))), int(r.integers(0, 3))
                    words[at:at + (kind != 0)] = fresh(1) if kind != 1 or len(words) == 1 else []
                text = np.array(fresh(length) + words + fresh(length), dtype=np.uint64)
                start, item = self.anchored(text, np.array([0, len(text)]))
                start = np.unique(start[self.length[item] == length])
                symbols = text[np.minimum(start[:, None] + np.arange(length), len(text) - 1)]
                made = keys(walk(symbols, MOST_WALKS, 3 * length), length).reshape(-1, MOST_WALKS, SAMPLES)
                found.append((made == own).any(axis=(0, 2)))
        hit = np.maximum.accumulate(np.stack(found), axis=1).mean(axis=0)
        walks = int(np.argmax(hit >= RECALL)) + 1 if (hit >= RECALL).any() else MOST_WALKS
        return walks, float(hit[walks - 1])

    def anchored(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and items of the distinct item-sized windows on the diagonals of shared anchors."""
        starts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g, (hashes, item, offset) in self.anchors.items():
            got = grams(words, g)
            maybe = np.zeros(1 << 20, dtype=bool)
            maybe[hashes >> _U(44)] = True
            at = np.flatnonzero(maybe[got >> _U(44)])
            lo, hi = np.searchsorted(hashes, got[at], "left"), np.searchsorted(hashes, got[at], "right")
            at, posting = np.repeat(at, hi - lo), ragged(lo, hi - lo)
            row = np.searchsorted(rows, at, side="right") - 1
            inside = at + g <= rows[row + 1]
            at, posting, row = at[inside], posting[inside], row[inside]
            starts.append(np.maximum(at - offset[posting], rows[row]))
            items.append(item[posting])
        found = np.unique(np.stack([np.concatenate(starts), np.concatenate(items)], axis=1), axis=0)
        return found[:, 0], found[:, 1]

    def candidates(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window starts and items that agree in a sample, or all of them where sampling isn't enough."""
        starts, items = self.anchored(words, rows)
        if not self.sampled:
            return starts, items
        found = np.unique(np.stack([starts, self.length[items]], axis=1), axis=0)
        starts, lengths = found[:, 0], found[:, 1]
        out = [np.zeros((0, 2), np.int64)]
        order = np.argsort(lengths, kind="stable")
        for lo in range(0, len(order), WINDOWS):
            own = order[lo:lo + WINDOWS]
            start, length = starts[own], lengths[own]
            width = int(length.max())
            end = np.minimum(start + length, rows[np.searchsorted(rows, start, side="right")])
            at = start[:, None] + np.arange(width)
            symbols = np.where(at < end[:, None], words[np.minimum(at, len(words) - 1)], _U(0))
            embedded = walk(symbols, self.walks, 3 * width)
            for n in np.unique(length):
                same = np.flatnonzero(length == n)
                made = keys(embedded[:, :, same], int(n))
                left, right = np.searchsorted(self.keys, made, "left"), np.searchsorted(self.keys, made, "right")
                hit = np.flatnonzero((right > left).any(axis=1))
                for h in hit:
                    for i in np.unique(self.key_item[ragged(left[h], right[h] - left[h])]):
                        out.append(np.array([[start[same[h]], i]]))
        both = np.unique(np.concatenate(out), axis=0)
        return both[:, 0], both[:, 1]

    def leaks(self, words: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Row, item, edits, and first and last word + 1 of every verified stretch; the best one for a row and item."""
        start, item = self.candidates(words, rows)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n in np.unique(self.length[item]):
            own = np.flatnonzero(self.length[item] == n)
            k = int(allowed(int(n)))
            for lo in range(0, len(own), WINDOWS):
                part = own[lo:lo + WINDOWS]
                row = np.searchsorted(rows, start[part], side="right") - 1
                first, last = np.maximum(rows[row], start[part] - 2 * k), np.minimum(rows[row + 1], start[part] + n + 2 * k)
                at = first[:, None] + np.arange(int((last - first).max()))
                texts = np.where(at < last[:, None], words[np.minimum(at, len(words) - 1)], _U(0))
                items = np.stack([self.words[i] for i in item[part]])
                off, end = distances(items, texts)
                for x in np.flatnonzero(off <= k):
                    # the same from the end backwards gives the stretch's first word
                    back, size = distances_to_end(items[x], texts[x, :end[x]])
                    key = (int(row[x]), int(item[part[x]]))
                    stop = int(first[x] + end[x])
                    made = (int(off[x]), stop - size, stop)
                    if key not in best or made < best[key]:
                        best[key] = made
        for (row, i), (off, lo, hi) in sorted(best.items()):
            yield row, i, off, lo, hi


def distances_to_end(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edits between ``item`` and a suffix of ``text``, and the length of the shortest such suffix."""
    item, text = item[::-1], text[::-1]
    across = np.arange(len(text) + 1)
    before = across.copy()
    for w in item:
        now = before + 1
        now[1:] = np.minimum(now[1:], before[:-1] + (text != w))
        before = np.minimum.accumulate(now - across) + across
    return int(before.min()), int(before.argmin())


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the items of ``item_id, text``, each over about BLOCK_WORDS words, one after the other."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                starts, ends, rows = s.words(ALNUM)
                h = s.hashes(starts, ends, latin=True).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").slice(s.first, s.rows), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(h))],
                    names=["item_id", "words"])

    items = written(benchmark.where(F.col("item_id").isNotNull())
                    .select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
                    .mapInArrow(split, "item_id long, words array<long>").where(F.size("words") > 0), "benchmark")
    total = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    n = -(-total // BLOCK_WORDS)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == b).orderBy("item_id", "words").collect()
        if rows:
            yield Index([r["item_id"] for r in rows], [np.array(r["words"], dtype=np.int64).view(np.uint64) for r in rows])


def _hashed(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, rows = s.words(ALNUM)
    return s.hashes(starts, ends, latin=True), rows, starts, ends


#: Rows that ``leaks`` finds.
LEAK = "doc_id long, item_id long, edits int, start long, end long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, start, end``: the best stretch (in UTF-8 bytes) of every item that a document leaks."""
    def finding(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in slices(batch.column("text")):
                    words, rows, starts, ends = _hashed(s)
                    got = list(index.leaks(words, rows))
                    if got:
                        row, item, off, lo, hi = (np.array(x) for x in zip(*got))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array(row + s.first)), pa.array(index.ids[item]), pa.array(off.astype(np.int32)),
                             pa.array(starts[lo] - s.offsets[row]), pa.array(ends[np.maximum(hi - 1, lo)] - s.offsets[row])],
                            names=["doc_id", "item_id", "edits", "start", "end"])

        return run

    rows, out, last = texts(docs), docs.sparkSession.createDataFrame([], LEAK), None
    for index in blocks(benchmark):
        if last is not None:  # written, so that the index before needn't be kept
            out = out.unionAll(written(rows.mapInArrow(finding(last), LEAK), "leaks"))
        last = index
    return out if last is None else out.unionAll(rows.mapInArrow(finding(last), LEAK))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that leak no item."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def keeping(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in slices(batch.column(at)):
                    words, rows, _, _ = _hashed(s)
                    kept = np.ones(s.rows, dtype=bool)
                    kept[[x[0] for x in index.leaks(words, rows)]] = False
                    yield batch.slice(s.first, s.rows).filter(pa.array(kept))

        return run

    last = None
    for index in blocks(benchmark):
        if last is not None:
            docs = written(docs.mapInArrow(keeping(last), docs.schema), "clean")
        last = index
    return docs if last is None else docs.mapInArrow(keeping(last), docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
