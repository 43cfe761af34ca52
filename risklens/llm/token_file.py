"""Token-id output: ORC files of token ids, sorted by document id.

Layout. A folder of ORC files, one for each range of document ids; a row holds
one document:

``doc_id`` long, ``ids`` array<int> (its token ids and the end id; ORC stores
integer streams run-length encoded), ``n_tokens`` long (length of ``ids``),
``part`` int (number of the file in id order) and ``ahead`` long (ids of the
documents before it in the same file).

Rows stand in ascending doc_id order within and across files, so the row index
(minimum and maximum per stripe and row group) prunes id ranges, and a Bloom
filter on doc_id prunes point look-ups. Each stripe is read on its own, so one
file can feed many tasks.

Edge cases: a null text is an empty text and gives the end id alone; a null
doc_id sorts first; repeated doc_ids stand next to each other, in one file or
in files that follow each other, in order of their texts' hashes; an empty table gives an empty folder that reads back empty; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklens.llm.tables import bound_batches, load, new_folder, texts
from risklens.llm.words import Slice, kept, ragged, segment_sums, slices

SCHEMA = "doc_id long, ids array<int>, n_tokens long, part int, ahead long"
END_ID = 1
STRIPE_BYTES = 64 << 20
ROWS_PER_INDEX_ENTRY = 1000

#: Words, and ids of them, that a Python worker keeps; it starts afresh beyond.
CACHED_WORDS, CACHED_IDS = 1_000_000, 8_000_000


#: Plain words joined in one text that the library gets.
JOINED_WORDS = 4096

#: Letters that normalisation keeps single letters, with one sign behind them or not; or digits.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+([.,;:!?]?)|[0-9]+")


def word_ends(word: str) -> int:
    """Pre-tokens of a plain word, each of which ends with one word-end id: a run
    of letters is one, and so are a sign and every digit. 0 for other words."""
    m = _PLAIN.fullmatch(word)
    if m is None:
        return 0
    return len(word) if m[1] is None else 1 + len(m[1])


class WordEncoder:
    """Token ids of texts, for the word-end BPE tokenizer.

    Its pre-tokeniser drops white space and never joins what white space
    separates, so the ids of a text are those of its words one after the other.
    Words are told apart by 64-bit hashes; each new one goes through the
    tokenizers library once per worker. Plain words, whose number of word-end ids
    follows from their form (see ``word_ends``), are joined for that, many in one
    text; all others go on their own.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS, cached_ids: int = CACHED_IDS):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        self.tokenizer, self.cached, self.cached_ids = Tokenizer.from_file(path), cached, cached_ids
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.word_end[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the number of ids of each."""
        ends = np.fromiter(map(word_ends, words), np.int64, len(words))
        plain, other = np.flatnonzero(ends), np.flatnonzero(ends == 0)
        joined = [" ".join([words[i] for i in plain[lo:lo + JOINED_WORDS]]) for lo in range(0, len(plain), JOINED_WORDS)]
        made = [e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        of_plain = np.fromiter(chain.from_iterable(made), np.int32)
        last = np.flatnonzero(self.word_end[of_plain])[np.cumsum(ends[plain]) - 1] + 1
        made = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False)]
        sizes = np.zeros(len(words), np.int64)
        sizes[plain], sizes[other] = np.diff(last, prepend=0), np.fromiter(map(len, made), np.int64, len(made))
        starts = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()), np.int32)
        ids[ragged(starts[plain], sizes[plain])] = of_plain
        ids[ragged(starts[other], sizes[other])] = np.fromiter(chain.from_iterable(made), np.int32)
        return ids, sizes

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """``hashes``: ascending."""
        ids, sizes = self.encode(words)
        starts = self.used + np.cumsum(sizes) - sizes
        if len(self.ids) < self.used + len(ids):
            grown = np.zeros(max(2 * len(self.ids), self.used + len(ids)), np.int32)
            grown[:self.used] = self.ids[:self.used]
            self.ids = grown
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts, self.sizes = np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)

    def __call__(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, and the number of ids of each row."""
        starts, ends, rows = s.words()
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(s.rows, np.int64)
        if len(self.hashes) > self.cached or self.used > self.cached_ids:
            self.clear()
        found, first, word = np.unique(s.hashes(starts, ends, lower=False), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, found)
        new = np.ones(len(found), dtype=bool)
        new[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] != found[at < len(self.hashes)]
        if new.any():
            lo, n = starts[first[new]], (ends - starts)[first[new]]
            spaced = np.full(int((n + 1).sum()), 32, dtype=np.uint8)
            spaced[ragged(np.cumsum(n + 1) - (n + 1), n)] = s.data[ragged(lo, n)]
            self.learn(found[new], spaced[:-1].tobytes().decode().split(" "))
            at = np.searchsorted(self.hashes, found)
        sizes = self.sizes[at][word]
        return self.ids[ragged(self.starts[at][word], sizes)], segment_sums(sizes, rows)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Encode ``doc_id, text`` of ``docs`` and write the token files to ``path``."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ahead = TaskContext.get().partitionId(), 0
        encoder = kept(f"words of {tokenizer_path}", lambda: WordEncoder(tokenizer_path))
        for batch in batches:
            for s in slices(batch.column("text")):
                ids, n = encoder(s)
                bounds = np.concatenate([[0], np.cumsum(n + 1)])
                coded = np.full(len(ids) + s.rows, end_id, dtype=np.int32)
                coded[ragged(bounds[:-1], n)] = ids
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(s.first, s.rows),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(coded)),
                    pa.array(n + 1), pa.array(np.full(s.rows, part, dtype=np.int32)),
                    pa.array(ahead + bounds[:-1])], names=["doc_id", "ids", "n_tokens", "part", "ahead"])
                ahead += int(bounds[-1])

    rows = texts(docs)
    order = ["doc_id", F.xxhash64("text")]
    (rows.repartitionByRange(*order)
     .sortWithinPartitions(*order)
     .mapInArrow(encode, SCHEMA)
     .write.option("compression", "zstd")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(ROWS_PER_INDEX_ENTRY))
     .option("orc.stripe.size", str(stripe_bytes))
     .orc(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The token files as rows; filters on doc_id prune files, stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents of the given ids: an IN predicate, which ORC answers from its Bloom filters."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, part, ahead, n_tokens, ids_crc32`` of each document, from the ids in the files."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            bounds = ids.offsets.to_numpy()
            data = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("part"), batch.column("ahead"),
                pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "part", "ahead", "n_tokens", "ids_crc32"])

    bound_batches(tokens.sparkSession)
    return tokens.select("doc_id", "part", "ahead", "ids").mapInArrow(
        crc, "doc_id long, part int, ahead long, n_tokens long, ids_crc32 long")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files at
    ``path``; ``start`` counts the ids of all documents before it. The running
    sum over files runs in one task, on one short row per file.
    """
    rows = checksums(read(spark, path))
    sizes = read(spark, path).select("part", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = (sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
            .select(F.col("part").alias("base_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    return (rows.join(base, rows["part"] == base["base_part"])
            .select("doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` to a fresh shared folder; their digest."""
    spark = docs.sparkSession
    path = new_folder(spark, "token-ids")
    write(docs, path, tokenizer_path or default_tokenizer())
    return digest(spark, path)


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents"))
