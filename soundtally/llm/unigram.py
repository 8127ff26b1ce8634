"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches; dynamic programming
keeps, for each end, the best score and its piece count. Matches that end at one
place come longest first and replace only what they beat, which is the rule of
public unigram tokenizers: among equal scores the earliest start wins. A character
without a piece of its own costs the smallest score less ten, counts as its bytes
where the vocabulary has byte pieces, and joins neighbours into one piece else.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import with_arrow

MARK = "▁"
PENALTY = 10.0
#: Stretches of text a worker remembers, of up to so many characters; then it forgets them all, which bounds its memory.
REMEMBERED, LONGEST = 300_000, 100


class Unigram:
    """vocabulary: (piece, score); unknown: the index of the unknown piece."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0):
        self.ids = {piece: i for i, (piece, _) in enumerate(vocabulary) if piece}
        self.matches = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.matches.add_word(piece, (len(piece), float(vocabulary[i][1]), i == unknown))
        self.matches.make_automaton()
        self.single = {p for p in self.ids if len(p) == 1}
        self.unknown, self.missing = vocabulary[unknown][0], min(v for _, v in vocabulary) - PENALTY
        self.bytes = all(f"<0x{b:02X}>" in self.ids for b in range(256))
        #: no piece has a line break, so a stretch may be cut there
        self.line_cut = self.bytes and not any("\n" in p for p in self.ids)
        self.known: dict[str, tuple[float, int]] = {}

    def run(self, text: str) -> int:
        """Pieces of a run of unknown characters."""
        return len(text.encode("utf-8", "replace")) if self.bytes and text not in self.ids else 1

    def best(self, text: str) -> tuple[float, int]:
        """Score and piece count of the best path over one stretch."""
        n = len(text)
        ends: list[list[tuple[int, float, bool]]] = [[] for _ in range(n)]
        for end, match in self.matches.iter(text):
            ends[end].append(match)
        # closed: pieces before the run of unknown characters that is open there from opened, or -1
        score, closed, opened = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        for end in range(n):
            top = None
            for length, value, odd in ends[end]:
                start = end + 1 - length
                if top is None or score[start] + value > top:
                    top, origin, unknown = score[start] + value, start, odd
            if text[end] not in self.single and (top is None or score[end] + self.missing > top):
                top, origin, unknown = score[end] + self.missing, end, True
            begun = opened[origin]
            score[end + 1], closed[end + 1] = top, closed[origin]
            if unknown:
                opened[end + 1] = begun if begun >= 0 else origin
            else:
                closed[end + 1] += 1 + (self.run(text[begun:origin]) if begun >= 0 else 0)
        return score[n], closed[n] + (self.run(text[opened[n] :]) if opened[n] >= 0 else 0)

    def stretch(self, text: str) -> tuple[float, int]:
        got = self.known.get(text)
        if got is None:
            got = self.best(text)
            if len(text) <= LONGEST:
                self.known[text] = got
        return got

    def count(self, text: str | None) -> tuple[int, float]:
        """Piece count and score of a whole text; spaces are marks, and a mark begins a stretch."""
        if not text:
            return 0, 0.0
        if len(self.known) > REMEMBERED:
            self.known.clear()
        marked = text.replace(" ", MARK)
        parts = (marked if marked.startswith(MARK) else MARK + marked)[1:].split(MARK)
        count, total = 0, 0.0
        for part in parts:
            whole = MARK + part
            if self.line_cut and "\n" in part and self.unknown not in part:
                first, *rest = whole.split("\n")
                for i, x in enumerate((first, *rest)):
                    value, n = self.stretch(x) if x else (0.0, 0)
                    count, total = count + n + (i > 0), total + value + (self.missing if i else 0.0)
            else:
                value, n = self.stretch(whole)
                count, total = count + n, total + value
        return count, total


_loaded: dict[str, Unigram] = {}


def loaded(path: str) -> Unigram:
    """One automaton a worker process, of a vocabulary file's pieces and scores."""
    if path not in _loaded:
        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        _loaded[path] = Unigram([(pieces.id_to_piece(i), pieces.get_score(i)) for i in range(pieces.get_piece_size())], pieces.unk_id())
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and score of the best path over every whole text.

    A null or empty text has 0 and 0.0; texts of any length, also without white space,
    are counted as a whole. Of paths with equal scores the library's is taken. Repeated
    rows and rows without doc_id are rows like others. Other columns stay, but for those
    of the two names. An empty table gives an empty result.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        model = loaded(path)
        got = [model.count(t) for t in batch.column(text).to_pylist()]
        return [pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())]

    return with_arrow(docs, "n_tokens long, score double", make)
