"""A fixed public vocabulary of pieces and the matches of its pieces in words."""

from __future__ import annotations

import numpy as np

SPACE = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> list[tuple[str, float]]:
    """Piece and score of every id, in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def automaton(words: list[tuple[str, object]]):
    """Aho-Corasick automaton that gives the value of every match."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, value in words:
        a.add_word(word, value)
    a.make_automaton()
    return a


class Lattice:
    """All matches of vocabulary pieces in a list of words, as arrays.

    ``word``, ``start``, ``end``, ``piece``: one entry per match, ordered by
    end. A character that is no piece itself gets an entry with piece
    ``unknown``, so that every word has a segmentation.
    """

    def __init__(self, words: list[str], trie, unknown: int):
        word, start, end, piece = [], [], [], []
        for i, w in enumerate(words):
            single = set()
            for last, (n, k) in trie.iter(w):
                word.append(i)
                start.append(last + 1 - n)
                end.append(last + 1)
                piece.append(k)
                if n == 1:
                    single.add(last)
            if len(single) < len(w):
                for at in range(len(w)):
                    if at not in single:
                        word.append(i)
                        start.append(at)
                        end.append(at + 1)
                        piece.append(unknown)
        order = np.argsort(np.array(end, dtype=np.int32), kind="stable")
        self.word, self.start, self.end, self.piece = (np.array(x, dtype=np.int32)[order] for x in (word, start, end, piece))
        self.length = np.array([len(w) for w in words], dtype=np.int32)
        self.longest = int(self.length.max()) if len(words) else 0
        self.bounds = np.searchsorted(self.end, np.arange(self.longest + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """``alpha[position, word]``: probability that pieces of probability
        ``p[piece]`` spell the word's first ``position`` characters, summed
        over all segmentations."""
        alpha = np.zeros((self.longest + 1, len(self.length)))
        alpha[0] = 1
        for j in range(1, self.longest + 1):
            at = slice(self.bounds[j], self.bounds[j + 1])
            alpha[j] = np.bincount(self.word[at], alpha[self.start[at], self.word[at]] * p[self.piece[at]], len(self.length))
        return alpha

    def total(self, p: np.ndarray) -> np.ndarray:
        return self.forward(p)[self.length, np.arange(len(self.length))]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece when word i occurs ``counts[i]`` times."""
        alpha = self.forward(p)
        n = np.arange(len(self.length))
        beta = np.zeros_like(alpha)
        beta[self.length, n] = 1
        for j in range(self.longest, 0, -1):
            at = slice(self.bounds[j], self.bounds[j + 1])
            np.add.at(beta, (self.start[at], self.word[at]), beta[j, self.word[at]] * p[self.piece[at]])
        share = counts / alpha[self.length, n]
        use = alpha[self.start, self.word] * p[self.piece] * beta[self.end, self.word] * share[self.word]
        return np.bincount(self.piece, use, len(p))
