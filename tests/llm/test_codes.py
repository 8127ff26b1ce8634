"""Vector codes against plain product quantisation."""

import hashlib

import numpy as np
import pytest

from soundtally.llm import codes

SF = "/root/testdata/sf0.001"


def plain(rows, parts=16, entries=64, rounds=2):
    """{vec_id: (code, error, label_error, codebooks digest)}; rows: (vec_id, vector, label)."""
    rows = sorted(rows, key=lambda r: r[0])
    x = np.floor(256 * np.array([v for _, v, _ in rows], dtype=np.float64)).astype(np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assigned():
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return far.argmin(axis=2), far.min(axis=2)

    for _ in range(rounds):
        at, _ = assigned()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (at[:, p] == e).any():
                    books[p, e] = [int(s) // int((at[:, p] == e).sum()) for s in x[at[:, p] == e, p].sum(axis=0)]
    at, far = assigned()
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by = {}
    for (_, _, label), e in zip(rows, far.sum(axis=1).tolist(), strict=True):
        by[label] = by.get(label, 0) + e
    return {r[0]: ("".join(f"{i:02x}" for i in c), e, by[r[2]], digest) for r, c, e in zip(rows, at, far.sum(axis=1).tolist(), strict=True)}


def coded(df):
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codes.compressed(df).collect()}


def test_equals_plain_quantisation(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert coded(df) == plain([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])


@pytest.mark.parametrize("n, scale", [(1, 1.0), (40, 1.0), (300, 1e-3), (300, 30.0), (300, 100_000.0)])
def test_few_vectors_ties_and_wide_ranges(spark, n, scale):
    rng = np.random.default_rng(n)
    rows = [(i * 3, (np.round(rng.standard_normal(32) * 2) / 2 * scale).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(1000 + i, rows[0][1], None) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert coded(df) == plain(rows)


def test_what_takes_no_part(spark):
    v = [0.5] * 16
    rows = [(0, None), (1, [float("nan"), *v[1:]]), (2, [None, *v[1:]]), (3, [float("inf"), *v[1:]]), (4, []), (5, [1.0]), (6, v), (7, v * 2), (8, [0.0] * 16)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    assert set(coded(df)) == {6, 8} and codes.compressed(df.limit(0)).count() == 0 and codes.compressed(df.where("vec_id = 0")).count() == 0
    with pytest.raises(Exception, match="too large"):
        codes.compressed(spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<double>, label int")).collect()


def test_dominated_entries_are_never_nearest():
    rng = np.random.default_rng(4)
    book = rng.integers(-500, 500, (64, 4))
    memo = codes.Cells(book)
    rows = rng.integers(-900, 900, (5000, 4))
    far = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
    for _ in range(2):
        entry, best = memo.nearest(rows)
        assert (entry == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
    assert np.mean([len(k) for k in memo.lists]) < 32


def test_memo_forgets_when_full(monkeypatch):
    monkeypatch.setattr(codes, "CELLS", 50)
    rng = np.random.default_rng(5)
    book = rng.integers(-500, 500, (64, 4))
    memo = codes.Cells(book)
    for _ in range(4):
        rows = rng.integers(-900, 900, (300, 4))
        assert (memo.nearest(rows)[0] == ((rows[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_decoded_vectors_are_near(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = codes.integers(df)
    books = codes.fit(rows)
    back = codes.decode(codes.encode(rows, books), books).select("vec_id", "error", "embedding").collect()
    own = {r["vec_id"]: np.array(r["embedding"]) for r in df.collect()}
    for r in back:
        far = ((256 * own[r["vec_id"]] - 256 * np.array(r["embedding"])) ** 2).sum()
        assert abs(far**0.5 - r["error"] ** 0.5) <= 8
