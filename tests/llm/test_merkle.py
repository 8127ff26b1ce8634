"""The manifest against plain trees, and its witnesses against its leaves."""

import zlib
from hashlib import sha256

import duckdb
import pytest

from soundtally.llm import merkle

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def tree(nodes):
    """Root, and of each node its (place, others) by level."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up = []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for p in range(len(run)):
                for i in below[a + p]:
                    paths[i].append((p, run[:p] + run[p + 1 :]))
            up.append((digest(*run), sum(below[a : a + 8], [])))
        nodes, below = [n for n, _ in up], [b for _, b in up]
    return nodes[0], paths


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    langs = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"], leaf(r, r["text"]))):
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([leaf(r, r["text"]) for r in langs[x]]) for x in order]
    if not trees:
        return []
    root, tops = tree([t[0] for t in trees])
    out = []
    for x, (sub, paths), top in zip(order, trees, tops, strict=True):
        for r, path in zip(langs[x], paths, strict=True):
            steps, own = path + top, leaf(r, r["text"])
            touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
            node = leaf(r, r["text"].translate(LOW)) if touched else own
            for place, others in steps:
                node = digest(*others[:place], node, *others[place:])
            out.append((r["doc_id"], own, sub, root, digest(*[d for _, o in steps for d in o]), node, node == root))
    return out


ORDER = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
KEY = lambda t: (t[0] is not None, *map(str, t))


@pytest.mark.parametrize("span", [8, 64, 4096])
def test_manifest_equals_plain_trees(spark, span):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    got = [tuple(r[c] for c in ORDER) for r in merkle.audited(docs, span).collect()]
    assert sorted(got, key=KEY) == sorted(plain(rows), key=KEY)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65, 73, 513])
def test_sizes_around_whole_runs(spark, n):
    rows = [{"doc_id": i, "text": f"Ä Text {i}", "lang": "en" if i % 9 else None, "source": None, "n_chars": i} for i in range(n)]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r[c] for c in ORDER) for r in merkle.audited(docs, 8).collect()]
    assert sorted(got, key=KEY) == sorted(plain(rows), key=KEY)


def test_nulls_and_copies(spark):
    rows = [(None, None, None, None, None), (None, "A", None, "s", 1), (None, "B", "en", "s", 1), (4, "", "", "", 0), (4, "", "", "", 0), (4, "x", "", "", 0), (5, "İÉ Q", "é", "s", 3), (6, "L" * 300_000, "z", "s", 3)]
    names = ("doc_id", "text", "lang", "source", "n_chars")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r[c] for c in ORDER) for r in merkle.audited(docs).collect()]
    assert sorted(got, key=KEY) == sorted(plain([dict(zip(names, r, strict=True)) for r in rows]), key=KEY)


def test_witnesses_grow_as_siblings_are_completed():
    held = merkle.Appender(2)
    nodes = [digest(str(i)) for i in range(20)]
    for i, node in enumerate(nodes):
        held.append(node)
        # the first leaf's witness has all that is known of its run and of the runs after it
        first = held.witnesses[0]
        assert first[0] == [0, nodes[1 : min(i + 1, 8)]]
        assert len(first) == (2 if i >= 7 else 1) and (i < 7 or len(first[1][1]) == (i + 1) // 8 - 1)
    root, paths = tree(nodes)
    assert held.root() == root and [[tuple(s) for s in w] for w in held.witnesses] == paths


def test_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    duckdb.sql(f"create or replace view documents as from '{SF}/documents.parquet'")
    want = duckdb.sql(merkle.oracle()).fetchall()
    assert sorted(want, key=KEY) == sorted([tuple(r[c] for c in ORDER) for r in merkle.audited(docs).collect()], key=KEY)
