"""Vector code compression: product quantisation in integers, by memoised grid cells.

Components become integers and vectors are cut into equal parts. A codebook of each part
is moved to its parts' means for a few rounds. To find the nearest entry of a part, its
coarse grid cell is looked up in a memo: for a new cell the squared distances from its
box to every entry are bounded from below and above, and the entries whose lower bound
lies above the smallest upper bound are dominated, everywhere in the box. Only what is
left of the codebook is evaluated exactly, for all parts of a batch in one flat array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components beyond this are refused: their squared distances would leave 64 bits.
LARGEST = 1 << 28
#: Cells that a task remembers of a part; when there are more, it begins anew.
CELLS = 100_000


@dataclass
class Codebooks:
    """entries: (part, entry, position) integers; at most PARTS * ENTRIES entries whatever the input."""

    entries: np.ndarray
    memos: list = field(default_factory=list, repr=False)

    def __reduce__(self):
        return Codebooks, (self.entries,)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, ties to the lower one, and its squared distance; vectors: (row, part, position)."""
        if not self.memos:
            self.memos = [Cells(book) for book in self.entries]
        both = [memo.nearest(vectors[:, p]) for p, memo in enumerate(self.memos)]
        return np.stack([i for i, _ in both], axis=1), np.stack([d for _, d in both], axis=1)


class Cells:
    """The undominated entries of the grid cells met so far, of one part's codebook."""

    def __init__(self, book: np.ndarray):
        self.book = book
        # narrower cells have fewer entries left, wider ones are met more often
        self.width = max(1, int(book.std(axis=0).mean() * 0.75)) if book.size else 1
        self._forget()

    def _forget(self) -> None:
        self.place, self.lists = {}, []

    def _undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        low = cells[:, None, :] * self.width
        high = low + self.width - 1
        over, under = self.book[None] - high, low - self.book[None]
        least = (np.maximum(np.maximum(over, under), 0) ** 2).sum(axis=2)
        most = (np.maximum(np.abs(self.book[None] - low), np.abs(self.book[None] - high)) ** 2).sum(axis=2)
        return [np.flatnonzero(row) for row in least <= most.min(axis=1, keepdims=True)]

    def _places(self, cells: np.ndarray) -> np.ndarray:
        """Number of each row's cell among those remembered."""
        raw = np.ascontiguousarray(cells)
        names, first, of = np.unique(raw.view(np.dtype((np.void, raw.itemsize * raw.shape[1]))).ravel(), return_index=True, return_inverse=True)
        keys = [n.tobytes() for n in names]
        if len(self.place) + len(keys) > CELLS:
            self._forget()
        new = [i for i, k in enumerate(keys) if k not in self.place]
        for at in range(0, len(new), 1024):
            some = new[at : at + 1024]
            for i, kept in zip(some, self._undominated(raw[first[some]]), strict=True):
                self.place[keys[i]] = len(self.lists)
                self.lists.append(kept)
        return np.array([self.place[k] for k in keys], dtype=np.int64)[of]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = self._places(rows // self.width)
        used, of = np.unique(places, return_inverse=True)
        lists = [self.lists[p] for p in used]
        length = np.array([len(k) for k in lists])
        flat, begin = np.concatenate(lists), np.r_[0, np.cumsum(length)[:-1]]
        many = length[of]
        start = np.r_[0, np.cumsum(many)[:-1]]
        row = np.repeat(np.arange(len(rows)), many)
        entry = flat[np.arange(len(row)) - start[row] + begin[of][row]]
        far = ((rows[row] - self.book[entry]) ** 2).sum(axis=1)
        best = np.minimum.reduceat(far, start)
        return np.minimum.reduceat(np.where(far == best[row], entry, ENTRIES), start), best


def _batches(pdfs: Iterator[pd.DataFrame], parts: int, rows: int = 4096) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for pdf in pdfs:
        for at in range(0, len(pdf), rows):
            some = pdf[at : at + rows]
            flat = np.stack(some["v"].to_numpy()).astype(np.int64)
            yield some, flat.reshape(len(some), parts, -1)


def integers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the vectors that take part, as floors of scaled components.

    Null vectors and those with null or non-finite components are left out, and so are
    vectors whose length isn't that of the smallest vec_id with a positive multiple of
    ``parts``. A component beyond LARGEST after scaling is an error.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = vectors.select("vec_id", "label", x.alias("embedding")).where(F.coalesce(sound, F.lit(False)) & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), F.size("embedding")).select(F.size("embedding").alias("d")).first()
    whole = lambda e: F.when(F.abs(e * scale) <= LARGEST, F.floor(e * scale)).otherwise(F.raise_error("a component is too large for integer codes")).cast("int")
    return kept.where(F.size("embedding") == (first["d"] if first else 0)).select("vec_id", "label", F.transform("embedding", whole).alias("v"))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of rows (vec_id, v): the first vectors by vec_id, moved to their parts' means; an entry that no part takes stays.

    Each task sums its parts by entry, Spark adds the sums up, and at most
    parts * entries of them come to the driver.
    """
    seed = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = Codebooks(np.array([r["v"] for r in seed], dtype=np.int64).reshape(len(seed), parts, -1).transpose(1, 0, 2) if seed else np.zeros((parts, 0, 1), np.int64))
    for _ in range(rounds if seed else 0):
        held = rows.sparkSession.sparkContext.broadcast(books)

        def sums(pdfs: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            book = held.value
            total, count = np.zeros_like(book.entries), np.zeros(book.entries.shape[:2], np.int64)
            for _, v in _batches(pdfs, parts):
                found, _ = book.nearest(v)
                for p in range(parts):
                    np.add.at(total[p], found[:, p], v[:, p])
                    count[p] += np.bincount(found[:, p], minlength=count.shape[1])
            part, entry = np.nonzero(count)
            if len(part):
                yield pd.DataFrame({"part": part, "entry": entry, "n": count[part, entry], "total": list(total[part, entry])})

        mine = rows.select("v").mapInPandas(sums, "part int, entry int, n long, total array<long>")
        size = books.entries.shape[2]
        added = mine.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total"))
        moved = books.entries.copy()
        for r in added.collect():  # at most a row an entry
            moved[r["part"], r["entry"]] = np.array(r["total"], np.int64) // r["n"]
        books = Codebooks(moved)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of rows (vec_id, label, v): two hex digits a part, and the squared distances summed."""
    held, parts = rows.sparkSession.sparkContext.broadcast(books), len(books.entries)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some, v in _batches(pdfs, parts):
            found, far = held.value.nearest(v)
            yield pd.DataFrame({"vec_id": some["vec_id"], "label": some["label"], "code": [r.tobytes().hex() for r in found.astype(np.uint8)], "error": far.sum(axis=1)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """codes (code, ...) with embedding: the middle of the integer cell of each part's entry."""
    flat = F.array(*[F.array(*[F.lit(float((x + 0.5) / scale)) for x in entry]) for book in books.entries.tolist() for entry in book])
    each = books.entries.shape[1]
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("embedding", F.flatten(F.array(*[F.element_at(flat, entry(p) + p * each + 1) for p in range(len(books.entries))])))


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part, see ``integers``.

    label_error sums the errors of all rows with the same label, null being one. Rows
    that share a vec_id are coded singly; where they are among the first vectors, the
    smaller vector comes first, and null ids come last. With fewer vectors than entries
    the codebooks are as short. Other columns are ignored. An empty table gives an
    empty result.
    """
    rows = stored(integers(vectors))
    books = fit(rows)
    name: Column = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = stored(encode(rows, books).select("vec_id", "code", "error", name.alias("__label")))
    sums = coded.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("copies"))
    known = salted_join(coded.withColumn("__spread", F.xxhash64("vec_id", "code")), stored(sums), ["__label"], "__spread", coded.count())
    return known.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle(table: str = "embeddings") -> str:
    """SQL for the rows of ``compressed``, every part against every entry."""
    far = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    near = f"select vec_id, p, x, min((d, e)) as best from (select vec_id, p, x, e, {far} as d from parts join {{0}} using (p)) group by all"
    mean = "select p, e, list(m order by i) as y from (select p, best[2] as e, i, floor(sum(x[i])::double / count(*))::bigint as m from {0}, (select unnest(range(1, len(x) + 1)) as i from (select x from parts limit 1)) group by all) group by all"
    moved = f"select p, e, coalesce(n.y, b.y) as y from {{0}} b left join ({mean.format('{1}')}) n using (p, e)"
    return f"""with k as (select vec_id, label, [floor({SCALE} * c::double)::bigint for c in embedding] as v from {table} where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
 parts as (select vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] as x from k, (select unnest(range({PARTS})) as p)),
 b0 as (select p, e, x as y from parts join (select vec_id, row_number() over (order by vec_id) - 1 as e from k qualify e < {ENTRIES}) using (vec_id)),
 a0 as ({near.format("b0")}), b1 as ({moved.format("b0", "a0")}), a1 as ({near.format("b1")}), b2 as ({moved.format("b1", "a1")}), a2 as ({near.format("b2")}),
 c as (select vec_id, string_agg(printf('%02x', best[2]), '' order by p) as code, sum(best[1])::bigint as error from a2 group by 1),
 s as (select sha256(string_agg(z, ',' order by p, e, i)) as codebooks_sha256 from (select p, e, unnest(y) as z, generate_subscripts(y, 1) as i from b2))
 select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from c join k using (vec_id), s"""
