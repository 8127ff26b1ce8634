"""BPE encoding and decoding by batched numpy merge rounds.

The words of an Arrow batch that a task has not met before are laid out as one
flat array of symbols. Each round looks every neighbouring pair up by binary
search over the sorted pair keys, takes the lowest rank of each word, and merges
all its occurrences from the left. A word leaves the array when none of its pairs
has a rank. The vocabulary file is a parameter and is read from each executor's
own installation.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_arrow

NO_RANK = np.iinfo(np.int64).max
#: Stretches of text a worker remembers, of up to so many characters; then it forgets them all, which bounds its memory.
REMEMBERED, LONGEST = 300_000, 100
_SPACE = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: bytes that print keep their own, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(other)) for b in range(256)]


class MergeTable:
    """Vocabulary, pair ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.tokens = np.empty(max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1, dtype=object)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.base = len(self.tokens)
        self.full = all(t is not None for t in self.tokens)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], dtype=np.int64)
        first_use = np.full(self.base, NO_RANK)
        np.minimum.at(first_use, left, np.arange(len(left)))
        np.minimum.at(first_use, right, np.arange(len(left)))
        if (first_use[made] <= np.arange(len(made))).any():
            raise ValueError("a merge uses a symbol that a later merge makes; rounds can't merge all of a word's equal pairs at once")
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", _SPACE))
        self.space = regex.compile(f"[{_SPACE}]+")
        # str.split() also cuts at these, which aren't white space here
        self.odd = re.compile("[\x1c-\x1f]")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a stretch, in order; a special token is its own string."""
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(part)
            elif part:
                # capital sigma lowers to the plain form wherever it stands
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += self.pattern.findall(plain)
        return out

    def merged(self, words: list[str]) -> list[np.ndarray]:
        """Token ids of each word; none is empty."""
        if not words:
            return []
        raw = [w.encode("utf-8") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        symbols[np.cumsum(length) - 1] = self.last[flat[np.cumsum(length) - 1]]
        word = np.repeat(np.arange(len(raw)), length)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NO_RANK)
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(np.r_[rank, NO_RANK], start)
            size = np.diff(np.r_[start, len(symbols)])
            live = np.repeat(best != NO_RANK, size)
            hit = (rank == np.repeat(best, size)[:-1]) & live[:-1]
            # in a run of overlapping hits every second one merges, from the left
            place = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, np.diff(place) != 1]) - 1
            head = np.flatnonzero(np.r_[True, np.diff(place) != 1]) if len(place) else place
            place = place[(np.arange(len(place)) - head[run]) % 2 == 0] if len(place) else place
            symbols[place] = self.made[at[place]]
            stay = np.ones(len(symbols), bool)
            stay[place + 1] = False
            out = stay & ~live
            done.append((word[out], symbols[out]))
            stay &= live
            symbols, word = symbols[stay], word[stay]
        owner, ids = (np.concatenate([d[k] for d in done]) if done else np.empty(0, np.int64) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        flat_ids, stop = ids[order].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(raw))).tolist()
        return [flat_ids[a:b] for a, b in zip([0, *stop], stop, strict=False)]

    def encode(self, texts: list[str], known: dict[str, bytes]) -> list[np.ndarray]:
        """Token ids of each text. known: what this task has met, by the stretch between white space, as little int32 arrays' bytes."""
        if len(known) > REMEMBERED:
            known.clear()
        split = [self.stretches(t) if t else [] for t in texts]
        fresh = {w for parts in split for w in parts if w not in known}
        if fresh:
            pieces = {w: self.pieces(w) for w in fresh}
            words = list({p for parts in pieces.values() for p in parts if p not in self.special})
            ids = {w: i.tobytes() for w, i in zip(words, self.merged(words), strict=True)}
            ids |= {t: np.int32(i).tobytes() for t, i in self.special.items()}
            made = {w: b"".join([ids[p] for p in parts]) for w, parts in pieces.items()}
            known.update({w: i for w, i in made.items() if len(w) <= LONGEST})
            if any(len(w) > LONGEST for w in made):
                return [np.frombuffer(b"".join([made[w] if w in made else known[w] for w in parts]), np.int32) for parts in split]
        return [np.frombuffer(b"".join([known[w] for w in parts]), np.int32) for parts in split]

    def stretches(self, text: str) -> list[str]:
        """What stands between white space; no word or special token spans any."""
        return self.space.split(text) if self.odd.search(text) else text.split()

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by one space, as this vocabulary has no decoder; an unknown id is left out."""
        ids = np.asarray(ids, dtype=np.int64)
        ids = ids[(ids >= 0) & (ids < self.base)]
        found = self.tokens[ids].tolist()
        return " ".join(found if self.full else [t for t in found if t is not None])


_loaded: dict[str, tuple[MergeTable, dict[str, bytes]]] = {}


def loaded(path: str) -> tuple[MergeTable, dict[str, bytes]]:
    """One table a worker process, and what it has met."""
    if path not in _loaded:
        _loaded[path] = MergeTable(path), {}
    return _loaded[path]


def _ids(path: str, texts: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    table, known = loaded(path)
    ids = table.encode(texts.to_pylist(), known)
    stop = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return ids, pa.ListArray.from_arrays(pa.array(stop), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """docs with the token ids of every whole text. A null or empty text has an empty array; other columns stay."""
    return with_arrow(docs, f"`{into}` array<int>", lambda batch: [_ids(path, batch.column(text))[1]])


def decode(df: DataFrame, path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """df with the text of every id array; a null array gives an empty text."""
    return with_arrow(df, f"`{into}` string", lambda batch: [pa.array(["" if a is None else loaded(path)[0].decode(a) for a in batch.column(ids).to_pylist()], pa.string())])


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with token_ids and, decoded from these, decoded; encode() and decode() in one pass over the rows.

    A null or empty text has no ids and an empty text decoded; texts of any length, also
    without white space, are encoded as a whole. Repeated rows and rows without doc_id
    are rows like others; columns of the two names are replaced. An empty table gives an
    empty result.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        ids, column = _ids(path, batch.column(text))
        return [column, pa.array([loaded(path)[0].decode(i) for i in ids], pa.string())]

    return with_arrow(docs, "token_ids array<int>, decoded string", make)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (decimal, joined by a space) and of the decoded text, for each row of round_trip(); of a null or empty text those of an empty one."""
    joined = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return df.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
