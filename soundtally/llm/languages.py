"""Language of a text by unigram models that sum over all segmentations into pieces.

The pieces are a fixed public vocabulary's. A language is a probability of each; a word
is scored by the forward algorithm, the sum over all ways to cut it into pieces of the
products of their probabilities, and a text by its words. The probabilities are
expected counts: the forward-backward algorithm under the vocabulary's own ranks deals
every word of the documents of a language out to its pieces.

Pieces are found in many words at once, by rolling hashes; the sums then run over the
words' places in step, so that each step is a few operations on flat arrays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MARK = "▁"
#: Languages of one model: bounds it, and a task that counts, to so many numbers a piece. More are learnt in several models.
LANGUAGES = 100
#: Expected counts are kept as integers, so that their sums don't depend on the order of tasks.
UNIT = 1 << 20
#: Pieces' worth of the vocabulary's own ranks in each language.
PRIOR = 1_000.0
#: Words of one flat array, and numbers that a task remembers of words.
AT_ONCE, REMEMBERED = 20_000, 4_000_000
_WORD = re.compile(r"[^\W\d_]+")
#: Bits of a slot for hashes of characters.
_SLOTS = 22


def counted(text: str | None) -> Counter:
    """The words of a whole text: runs of letters, lower-cased."""
    found = Counter(_WORD.findall((text or "").lower()))
    if found and not "".join(found).isalpha():
        # numerals that aren't decimal digits
        for w in [w for w in found if not w.isalpha()]:
            n, kept = found.pop(w), "".join(c for c in w if c.isalpha())
            if kept:
                found[kept] += n
    return found


class Vocabulary:
    """Pieces of lower-case letters with an initial mark or without, and one for any other letter; base: log probabilities from their ranks.

    Pieces are found by rolling hashes of their characters: ``begins`` and ``whole`` have
    the slots of pieces' beginnings and of pieces, so that most places of a text drop out
    early, and what is left is compared with the piece character by character.
    """

    def __init__(self, pieces: list[str]):
        fit = [p for p in pieces if p == MARK or p.lower() == p and p.removeprefix(MARK).isalpha()]
        self.pieces = list(dict.fromkeys(["", *fit]))
        weight = 1.0 / (10 + np.arange(len(self.pieces)))
        weight[0] = weight[-1]
        self.base = np.log(weight / weight.sum())
        self.begins, self.whole = np.zeros(1 << _SLOTS, bool), np.zeros(1 << _SLOTS, bool)
        self.longest = max(map(len, self.pieces))
        size = np.array([len(p) for p in self.pieces])
        #: by length: hashes in order, numbers and characters of the pieces
        self.sized = {}
        held = np.zeros((len(self.pieces), self.longest), np.uint32)
        for i, p in enumerate(self.pieces):
            held[i, : len(p)] = _codes(p)
        hashes = np.zeros(len(self.pieces), np.uint64)
        for n in range(1, self.longest + 1):
            hashes = _rolled(hashes, held[:, n - 1])
            self.begins[_slot(hashes[size >= n])] = True
            some = np.flatnonzero(size == n)
            self.whole[_slot(hashes[some])] = True
            some = some[np.argsort(hashes[some])]
            self.sized[n] = hashes[some], some, held[some, :n]

    def found(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(start, length, piece) of all places of pieces in a text's characters, by length."""
        start, hashes = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for n in range(1, self.longest + 1):
            inside = start + n <= len(codes)
            start, hashes = start[inside], hashes[inside]
            hashes = _rolled(hashes, codes[start + n - 1])
            slot = _slot(hashes)
            there = self.whole[slot]
            known, pieces, letters = self.sized[n]
            if there.any() and len(known):
                at = start[there]
                k = np.minimum(np.searchsorted(known, hashes[there]), len(known) - 1)
                same = known[k] == hashes[there]
                for j in range(n):
                    same &= letters[k, j] == codes[at + j]
                yield at[same], n, pieces[k[same]]
            on = self.begins[slot]
            start, hashes = start[on], hashes[on]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _rolled(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (hashes + codes) * np.uint64(0x9E3779B97F4A7C15)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)


@lru_cache(maxsize=2)
def loaded(path: str) -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return Vocabulary([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))])


class Lattice:
    """All pieces of many words: matches go from node start to node end, and a word from its first node to its last one."""

    def __init__(self, words: list[str], known: Vocabulary):
        text = "\n".join([MARK + w for w in words]) + "\n"
        codes = _codes(text)
        strange, parts = codes != 0x0A, []
        for start, n, piece in known.found(codes):
            parts.append((start, start + n, piece))
            if n == 1:
                strange[start] = False
        at = np.flatnonzero(strange)
        parts.append((at, at + 1, np.zeros_like(at)))
        start, end, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        turn = np.argsort(end, kind="stable")
        self.start, self.end, self.piece = start[turn], end[turn], piece[turn]
        self.nodes = len(text)
        size = np.array([len(w) + 1 for w in words])
        self.last = np.cumsum(size + 1) - 1
        self.first = self.last - size
        self.word = np.searchsorted(self.first, self.start, side="right") - 1

    def _sums(self, value: np.ndarray, origin: np.ndarray, here: np.ndarray, to: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Log sums of paths to each node, step by step: far is a match's distance from where its word begins, and matches to a node stand together."""
        reached = np.full((self.nodes, value.shape[1]), -np.inf)
        reached[here] = 0.0
        turn = np.argsort(far.astype(np.int16) if far.max() < 1 << 15 else far, kind="stable")
        far, to, origin, value = far[turn], to[turn], origin[turn], value[turn]
        steps = np.flatnonzero(np.diff(far, prepend=-1))
        for a, b in zip(steps, np.r_[steps[1:], len(far)], strict=True):
            node = to[a:b]
            new = np.diff(node, prepend=-1) != 0
            group = np.flatnonzero(new)
            paths = reached[origin[a:b]] + value[a:b]
            most = np.maximum.reduceat(paths, group, axis=0)
            paths -= most[np.cumsum(new) - 1]
            reached[node[group]] = most + np.log(np.add.reduceat(np.exp(paths, out=paths), group, axis=0))
        return reached

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """(node, language): logs of the sums over all ways from a word's first node; logs: (piece, language)."""
        return self._sums(logs[self.piece], self.start, self.first, self.end, self.end - self.first[self.word])

    def totals(self, logs: np.ndarray) -> np.ndarray:
        """(word, language): log probability of each word."""
        return self.forward(logs)[self.last]

    def expected(self, base: np.ndarray) -> np.ndarray:
        """Of every match the probability that a segmentation of its word has it."""
        value = base[self.piece][:, None]
        before = self.forward(base[:, None])
        turn = np.argsort(self.start, kind="stable")
        start = self.start[turn]
        after = self._sums(value[turn], self.end[turn], self.last, start, self.last[self.word[turn]] - start)
        return np.exp((before[self.start] + value + after[self.end] - before[self.last[self.word]])[:, 0])


def learnable() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


class Model:
    """names: languages in order; logs: (piece, language) log probabilities; prior: log shares of the documents."""

    def __init__(self, path: str, names: list[str], logs: np.ndarray, prior: np.ndarray):
        self.path, self.names, self.logs, self.prior = path, names, logs, prior
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, len(names)))

    def __reduce__(self):
        return Model, (self.path, self.names, self.logs, self.prior)

    def _learn(self, words: list[str]) -> None:
        vocabulary = loaded(self.path)
        tables = [Lattice(words[i : i + AT_ONCE], vocabulary).totals(self.logs) for i in range(0, len(words), AT_ONCE)]
        self.place |= {w: i for i, w in enumerate(words, len(self.known))}
        self.known = np.concatenate([self.known, *tables])

    def best(self, texts: list[str | None]) -> list[tuple[str | None, float, float]]:
        """Of each text the likeliest of the languages, its log weight, and the sum of all weights as a multiple of its own; no language if the text has no word."""
        words = [counted(t) for t in texts]
        new = sorted(set().union(*words).difference(self.place))
        if (len(self.place) + len(new)) * len(self.names) > REMEMBERED:
            self.place, self.known = {}, self.known[:0]
            new = sorted(set().union(*words))
        if new:
            self._learn(new)
        out = []
        for c in words:
            if not c:
                out.append((None, -np.inf, 0.0))
                continue
            at, n = np.fromiter(map(self.place.__getitem__, c), np.int64, len(c)), np.fromiter(c.values(), np.float64, len(c))
            logs = np.round(self.prior + (self.known[at] * n[:, None]).sum(axis=0), 6)
            best = int(logs.argmax())
            out.append((self.names[best], float(logs[best]), float(np.exp(logs - logs[best]).sum())))
        return out


def better(one: tuple[str | None, float, float], two: tuple[str | None, float, float]) -> tuple[str | None, float, float]:
    """What ``Model.best`` would say of the languages of both; of equal ones the first's counts."""
    if one[0] is None or two[0] is None:
        return two if one[0] is None else one
    high, low = (two, one) if two[1] > one[1] else (one, two)
    return high[0], high[1], high[2] + low[2] * float(np.exp(low[1] - high[1]))


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """(lang, piece, n): expected counts in units of 1 / UNIT of docs (lang, text), over all of their words.

    A task gathers words until it has many, deals them out to pieces and adds these up,
    so that it gives a row a piece and language, or several where it meets more than
    LANGUAGES languages and starts anew.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = loaded(path)
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, Counter] = {}

        def deal() -> None:
            for lang, found in waiting.items():
                total = sums.setdefault(lang, np.zeros(len(vocabulary.pieces), np.int64))
                words, n = list(found), np.fromiter(found.values(), np.int64, len(found))
                for i in range(0, len(words), AT_ONCE):
                    lattice = Lattice(words[i : i + AT_ONCE], vocabulary)
                    np.add.at(total, lattice.piece, np.round(lattice.expected(vocabulary.base) * UNIT).astype(np.int64) * n[i : i + AT_ONCE][lattice.word])
            waiting.clear()

        def given() -> Iterator[pd.DataFrame]:
            deal()
            for lang, total in sums.items():
                piece = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "piece": piece, "n": total[piece]})
            sums.clear()

        for pdf in pdfs:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if lang not in sums and lang not in waiting and len(sums.keys() | waiting.keys()) >= LANGUAGES:
                    yield from given()
                waiting.setdefault(lang, Counter()).update(counted(text))
                if sum(map(len, waiting.values())) > 10 * AT_ONCE:
                    deal()
        yield from given()

    return docs.select("lang", "text").mapInPandas(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, path: str) -> Iterator[Model]:
    """Learns all languages of all documents that may be learnt from, by their ids, and have one: whole texts, null ones as empty.

    One model after the other, each of LANGUAGES languages at most, in order of names;
    the driver gets a number a language and piece of one model at a time.
    """
    known = docs.where(learnable() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    every, total = sorted(n), sum(n.values())
    if not every:
        return
    counted_once = piece_counts(known, path)
    if len(every) > LANGUAGES:
        counted_once = stored(counted_once)
    vocabulary = loaded(path)
    for i in range(0, len(every), LANGUAGES):
        names = every[i : i + LANGUAGES]
        rows = (counted_once.where(F.col("lang").isin(names)) if len(every) > LANGUAGES else counted_once).toPandas()
        counts = np.zeros((len(vocabulary.pieces), len(names)))
        counts[rows["piece"].to_numpy(np.int64), rows["lang"].map({name: k for k, name in enumerate(names)}).to_numpy(np.int64)] = rows["n"].to_numpy(np.float64) / UNIT
        logs = np.log(counts + PRIOR * np.exp(vocabulary.base)[:, None]) - np.log(counts.sum(axis=0) + PRIOR)
        yield Model(path, names, logs, np.log(np.array([n[name] for name in names], np.float64) / total))


def predicted(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, lang, text).

    held_out rows teach nothing, and neither do those without doc_id or lang; lang is no
    input of a prediction. A text that is null or has no letter is ``und`` with score 0,
    and so is every text where nothing could be learnt. score is the posterior
    probability of lang_pred among all languages that were learnt; equal ones go to the
    first name. Where there are more than LANGUAGES of them, each further model is a
    pass over the texts, which carry what the models before it found. Rows that share a
    doc_id are predicted singly, a very long text as a whole. Other columns are ignored.
    An empty table gives an empty result.
    """
    models = fit(docs, path)
    model = next(models, None)
    found = F.lit(None).cast(FOUND)
    state = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    before = None
    while model is not None:
        after = next(models, None)
        found = _found(state, model)(*["text", *([] if before is None else [before])])
        if after is not None:
            state, before = stored(state.select("doc_id", "held_out", "text", found.alias("found"))), "found"
        model = after
    told = state.select("doc_id", "held_out", found.alias("found"))
    return told.select("doc_id", "held_out", F.coalesce("found.lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce(F.round(1 / F.col("found.sum"), 9), F.lit(0.0)).alias("score"))


FOUND = "struct<lang_pred: string, log: double, sum: double>"


def _found(docs: DataFrame, model: Model) -> Callable[..., Column]:
    """A function of text, and perhaps of what earlier models found, for the best of all languages so far."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, *before = batch if isinstance(batch, tuple) else (batch,)  # a single column comes bare
            rows = [r for i in range(0, len(texts), 256) for r in held.value.best(texts.iloc[i : i + 256].tolist())]
            for old in before:
                was = [(r[0] if isinstance(r[0], str) else None, *r[1:]) for r in old.itertuples(index=False, name=None)]
                rows = [better(a, b) for a, b in zip(was, rows, strict=True)]
            out = pd.DataFrame(rows, columns=["lang_pred", "log", "sum"])
            yield out.assign(lang_pred=out["lang_pred"].astype(object), sum=out["sum"].where(out["lang_pred"].notna()))

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, FOUND)
