import random
import re
import textwrap

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from soundtally.llm import ann, bpe, licences, lines, minhash, mixing, near_vectors, quality, queries, shards, unigram

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, token_ids string, hub string, part int"
LONG = " ".join(f"w{i}" for i in range(20_000))
ODD = [(None, "no id", None, None, 1), (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n ", "en", None, 3), (4, "one two", "en", "b", 7), (4, "one two", "en", "b", 7), (5, "one two", "en", "b", 7), (6, LONG, "en", "b", 1), (7, LONG + " x", "en", "c", 1), (8, "Licensed under the MIT Licence.", "en", "c", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, "x", "h", 1) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_shards(spark, odd, none):
    rows = shards.balanced_shards(odd, 3).collect()
    sizes = sorted(sum(r["shard"] == s for r in rows) for s in range(3))
    assert len(rows) == len(ODD) and sizes[-1] - sizes[0] <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in range(3))
    assert {r["size"] for r in rows if r["doc_id"] == 1} == {1} and shards.balanced_shards(none).count() == 0


def test_shards_keep_copies_together(spark):
    docs = spark.createDataFrame([(i, f"t{i // 3}" if i < 300 else f"u{i}") for i in range(1000)], "doc_id long, text string")
    rows = shards.balanced_shards(docs, 8)
    links = shards.copies(docs)
    r = shards.cut_links(rows, links).first()
    assert r["members"] == 300 and r["kept_together"] >= 290


@pytest.mark.parametrize("hubs, free, least", [([100] * 40, 0, 1.0), ([20] * 150, 1000, 1.0), ([500] + [3] * 333, 1, 0.75)])
def test_shards_keep_whole_hubs(spark, hubs, free, least):
    texts = [f"h{h}" for h, n in enumerate(hubs) for _ in range(n)] + [f"u{i}" for i in range(free)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shards.balanced_shards(docs, 8)
    r, sizes = shards.cut_links(rows, shards.copies(docs)).first(), [x["count"] for x in rows.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and r["members"] == sum(hubs) and r["kept_together"] >= least * sum(hubs)


def test_shards_cut_as_few_links_as_brute_force(spark):
    """Hubs of 2 to 5 rows over 3 shards; every way to give whole hubs to shards is tried for the most rows kept together."""
    rng = random.Random(3)
    for _ in range(3):
        hubs = [rng.randint(2, 5) for _ in range(7)]
        n = sum(hubs) + 4
        room = [n // 3 + (s < n % 3) for s in range(3)]
        best = 0
        for code in range(4 ** len(hubs)):
            to, used = [code // 4**h % 4 for h in range(len(hubs))], [0, 0, 0, 0]
            for h, s in enumerate(to):
                used[s] += hubs[h]
            if all(used[s] <= room[s] for s in range(3)):
                best = max(best, sum(hubs[h] for h in range(len(hubs)) if to[h] < 3))
        texts = [f"h{h}" for h, k in enumerate(hubs) for _ in range(k)] + [f"u{i}" for i in range(4)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        r = shards.cut_links(shards.balanced_shards(docs, 3), shards.copies(docs)).first()
        assert r["kept_together"] >= 0.85 * best


def test_shards_of_rows_in_several_hubs(spark):
    docs = spark.createDataFrame([(i, f"u{i}") for i in range(300)], "doc_id long, text string")
    links = spark.createDataFrame([(i, i // 10) for i in range(300)] + [(i, 1000 + i // 30) for i in range(0, 300, 3)] + [(None, 1), (7, None)], "doc_id long, hub long")
    rows = shards.balanced_shards(docs, 4, links)
    assert [r["count"] for r in rows.groupBy("shard").count().collect()] == [75] * 4
    r = shards.cut_links(rows, links).first()
    # groups of 30 that don't fill shards of 75: two of ten are cut at best
    assert r["kept_together"] >= 0.85 * r["members"]


def test_shards_find_communities(spark):
    """Eight communities that fit shards: each row is in about three hubs of its own community."""
    rng = random.Random(5)
    pairs = sorted({(c * 60 + d, c * 30 + h) for c in range(8) for h in range(30) for d in rng.sample(range(60), 6)})
    docs = spark.createDataFrame([(i * 7 % 480, f"u{i * 7 % 480}") for i in range(480)], "doc_id long, text string")
    links = spark.createDataFrame(pairs, "doc_id long, hub long")
    rows = shards.balanced_shards(docs, 8, links)
    r = shards.cut_links(rows, links).first()
    assert [x["count"] for x in rows.groupBy("shard").count().collect()] == [60] * 8
    assert r["members"] == 1440 and r["kept_together"] >= 0.95 * 1440


def test_labels_join_as_long_as_they_fit(spark):
    """Paths of hubs of two: labels never exceed the cap where no hub does, and no two that meet would fit together."""
    pairs = [(i + k, i) for i in range(40) for k in (0, 1)]
    lead = {r["doc_id"]: r["hub"] for r in shards.labelled(spark.createDataFrame(pairs, "doc_id long, hub long"), 7).collect()}
    sizes = {h: sum(v == h for v in lead.values()) for h in lead.values()}
    assert set(lead) == set(range(41)) and max(sizes.values()) <= 7
    assert all(lead[i] == lead[i + 1] or sizes[lead[i]] + sizes[lead[i + 1]] > 7 for i in range(40))


def test_rows_change_places(spark):
    """Two hubs dealt over two shards, two rows of each on the wrong side."""
    at = {i: int(i >= 6) for i in range(12)} | {0: 1, 1: 1, 6: 0, 7: 0}
    state = spark.createDataFrame([(i, 1, i, s) for i, s in at.items()], "doc_id long, size long, text_crc32 long, shard int")
    links = spark.createDataFrame([(i, i // 6) for i in range(12)], "doc_id long, hub long")
    for turn in range(4):
        state = shards.exchanged(state, links, 12, turn)
    r = shards.cut_links(state, links).first()
    assert [x["count"] for x in state.groupBy("shard").count().collect()] == [6, 6] and r["kept_together"] > 8


def test_licences(spark, odd, none):
    assert {(r["doc_id"], r["line_no"], r["license"]) for r in licences.scan(odd).collect()} == {(8, 0, "MIT")}
    assert licences.scan(none).count() == 0
    text = "Copyright (c) 2020 Me\n" + licences.KNOWN["MIT"][-1].replace("sublicense", "sublicence").upper()
    assert (1, -1, "MIT") in {tuple(r) for r in licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}


def test_licences_whole_and_wrapped(spark):
    whole, out = licences.texts(), {}
    wrap = lambda t, n: "\n\n".join(p if "opyright (" in p else textwrap.fill(" ".join(p.split()), n) for p in re.split(r"\n\s*\n", t))
    mit = whole["MIT"].split("\n\n", 2)[2]
    docs = [(f"{k} {n}", wrap(t, n)) for k, t in whole.items() for n in (60, 78) if k not in ("GPL-2.0", "LGPL-2.1", "MPL-1.1")]
    docs += [(k, t) for k, t in whole.items()]
    docs += [("file", f"The MIT License (MIT)\n\nCopyright (c) 2020 Me\n\n{wrap(mit, 70)}"), ("inside", f"My words\n\n# {wrap(mit, 60)}\n\nmore words")]
    docs += [("header", "def f():\n\n" + textwrap.indent(textwrap.fill('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', 60), "# ") + "\n\nreturn")]
    for r in licences.scan(spark.createDataFrame(docs, "doc_id string, text string")).collect():
        out.setdefault(r["doc_id"], []).append((r["line_no"], r["license"]))
    for k in whole:
        assert {v for d in out if d.split()[0] == k for v in out[d] if v[0] == -1} == {(-1, k)} and (-1, k) in out[k], k
    assert all(out[d].count((-1, d.split()[0])) == 1 for d, _ in docs[:-3]), [d for d, _ in docs[:-3] if (-1, d.split()[0]) not in out.get(d, [])]
    assert (-1, "MIT") in out["file"] and {v for _, v in out["inside"]} == {"MIT"} and out["header"] == [(2, "Apache-2.0")]


def test_unigram_counts_as_the_library(spark, odd, none):
    model = unigram.loaded(PIECES)
    vocabulary = [None] * len(model.ids)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    want = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback=True))
    want.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    rng = random.Random(1)
    letters = [*"aabcdet \n0é漢😀.▁", "<unk>", "the ", "<s>"]
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert model.count(text)[0] == len(want.encode(text, add_special_tokens=False).ids), text
    got = table(unigram.token_counts(odd, PIECES))
    assert got[1]["n_tokens"] == 0 and got[6]["n_tokens"] > 20_000 and unigram.token_counts(none, PIECES).count() == 0


def test_minhash_equals_brute_force(spark, odd, none):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 60))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for _ in range(260):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(len(b))] = f"v{rng.randint(0, 9)}"
        texts.append(" ".join(b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80)):
        sets = [frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) for w in (t.split() for t in texts)]
        low = list(range(len(sets)))
        for _ in range(20):
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    if i != j and 100 * len(a & b) >= percent * len(a | b):
                        low[i] = low[j] = min(low[i], low[j])
        got = table(minhash.near_duplicates(docs, width, percent))
        assert [got[i]["component_id"] for i in range(len(texts))] == low
    got = table(minhash.near_duplicates(odd, 3, 85))
    assert got[5]["component_id"] == 4 and got[7]["component_id"] == 6 and got[2]["component_id"] == 2 and got[1]["n_shingles"] == 0
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_misses_few_pairs_by_its_bands():
    for percent in (80, 85):
        rows = minhash.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (minhash.REGISTERS // rows) <= minhash.MISSED
    keys = minhash.band_keys(np.arange(512, dtype=np.uint16).reshape(2, 256), 7)
    assert keys.shape == (2, 36) and len(np.unique(keys)) == 72


def test_keep_one_of_repeated_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "x"), (1, a, "x"), (2, a + " more", "y"), (3, b, "z"), (3, "later text " + b, "z"), (4, None, "n"), (4, None, "n"), (None, a, "q"), (None, a, "q"), (5, "", "e"), (6, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    for many in (docs, docs.orderBy(docs["text"].desc())):
        got = sorted(map(tuple, minhash.keep_one(many).collect()), key=str)
        assert got == sorted([(1, a, "x"), (3, b, "z"), (4, None, "n"), (None, a, "q"), (None, a, "q"), (5, "", "e"), (6, "", "e")], key=str)


def test_minhash_with_a_frequent_key(spark):
    """A third of all rows near to one text, more than a task's share."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words, f"end{i}"]) for i in range(150)] + [" ".join(f"u{i}x{j}" for j in range(30)) for i in range(300)] + [" ".join(words)] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = table(minhash.near_duplicates(docs, 5, 80))
    assert all(got[i]["component_id"] == (0 if i < 150 or i >= 450 else i) for i in range(490))


def test_bpe_equals_the_library(spark, odd, none):
    mine, theirs = bpe.MergeTable(BPE), Tokenizer.from_file(BPE)
    rng = random.Random(2)
    letters = [*"aaabcit'slv \n\t09éΣσİŉ\x1c\x85 漢😀½.!-<|>", "<|endoftext|>", "'ll"]
    texts = ["a" * 999, "ab" * 300, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000))]
    for text, ids in zip(texts, mine.encode(texts, {}), strict=True):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and mine.decode(ids) == theirs.decode(want, skip_special_tokens=False)
    got = table(bpe.digests(bpe.round_trip(odd, BPE)))
    assert got[1]["n_tokens"] == 0 and got[6]["n_tokens"] == len(theirs.encode(LONG, add_special_tokens=False).ids)
    assert bpe.round_trip(none, BPE).count() == 0 and bpe.decode(bpe.encode(odd, BPE), BPE).columns[:2] == ["doc_id", "text"]


def vectors(spark, x, extra=()):
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


BAD = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (None, [1.0] * 16), (9005, [1.0, 2.0])]


def test_long_texts_without_white_space(spark):
    """Counted and encoded as a whole, and not remembered."""
    text = "".join(random.Random(8).choice("abcdeé語") for _ in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text[:50])], "doc_id long, text string")
    want = Tokenizer.from_file(BPE)
    want.no_truncation()
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs, BPE).collect()}
    assert all(rows[i]["token_ids"] == want.encode(t, add_special_tokens=False).ids for i, t in ((1, text), (2, text), (3, text[:50])))
    counts = {r["doc_id"]: r["n_tokens"] for r in unigram.token_counts(docs, PIECES).collect()}
    assert counts[1] == counts[2] > 1000
    table, model = bpe.MergeTable(BPE), unigram.loaded(PIECES)
    known = {}
    table.encode([text, text[:50]], known)
    model.count(text)
    assert set(known) == {text[:50]} and not any(len(k) > unigram.LONGEST for k in model.known)


def test_many_sources_are_solved_like_few(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 700}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = mixing.mixture(docs, entropy=0.99).agg({"n_tokens": "sum"}).first()[0]
    assert 0.5 * sum(1 + i % 7 for i in range(3000)) <= n <= sum(1 + i % 7 for i in range(3000))


def test_neighbours_recall(spark):
    x = np.random.default_rng(1).standard_normal((3000, 16)).astype(np.float32)
    x[100:400] = x[100]
    df = vectors(spark, x, BAD)
    got = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        hit += len({v for v, _ in found.values()} & set(best.tolist()))
        assert all(abs(d[v] - s) < 1e-9 for v, s in found.values())
    assert len(got) == 30 and hit >= 0.95 * 300 and [v for v, _ in got[100].values()] == list(range(101, 111))
    empty = df.where("vec_id < 0")
    assert ann.search(empty, empty).count() == 0


def test_neighbours_among_noisy_copies(spark, monkeypatch):
    # few of the group are in the sample, as in a large table
    monkeypatch.setattr(ann, "SAMPLE", 2048)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:500] = x[0] + 0.002 / 8 * rng.standard_normal((500, 64))
    df = vectors(spark, x)
    got = {}
    for r in ann.search(df, df.where("vec_id < 500 and vec_id % 20 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hit = 0
    for q, found in got.items():
        d = ((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len({v for _, v in found} & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 25 and hit >= 0.99 * 250


def test_visited_share_falls_with_size_and_groups():
    rng = np.random.default_rng(9)
    even = rng.standard_normal((8192, 32))
    groups = rng.standard_normal((60, 32))[rng.integers(0, 60, 8192)] + 0.05 * rng.standard_normal((8192, 32))
    share = lambda x, n: (lambda i: i.visited / len(i.centroids))(ann.Index(x.astype(np.float32), n, 4, 10))
    assert share(groups, 50_000) < 0.1 < share(even, 1_000_000) < share(even, 50_000) <= 1
    assert ann.lists_for(10_000) == 256 and ann.lists_for(4_000_000) == 2048 and ann.lists_for(10**12) == ann.MOST // ann.A_LIST


def test_a_list_of_copies_is_dealt_over_parts():
    x = np.random.default_rng(10).standard_normal((4000, 16)).astype(np.float32)
    x[:2000] = x[0]
    index = ann.Index(x, 4000, 8, 10)
    hot = index.dealt.argmax()
    assert index.dealt[hot] >= 4 and index.first[hot] + index.dealt[hot] <= index.parts
    after = index.first[hot + 1 :]
    assert not len(after) or after.min() >= index.first[hot] + index.dealt[hot]


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((800, 16)).astype(np.float32)
    x[300:500] = x[:200] + 0.35 * rng.standard_normal((200, 16))
    x[500:560] = x[7]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = table(near_vectors.near_vectors(vectors(spark, x, BAD)), "vec_id")
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(axis=1).tolist()
    assert all(got[i]["component_id"] == got[j]["component_id"] for i, j in zip(*np.nonzero(near), strict=True))
    assert got[9002]["n_links"] == 0 and got[9002]["kept"] and got[None]["kept"]


@pytest.mark.parametrize("cosine", [0.0, 0.5, 0.7, 0.8, 0.85])
def test_near_vectors_with_a_common_mean(spark, cosine):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    mean, n = unit(rng.standard_normal((1, 64))), 2500
    x = unit(np.sqrt(cosine) * mean + np.sqrt(1 - cosine) * unit(rng.standard_normal((n, 64))))
    side = unit(rng.standard_normal((n, 64)))
    side = unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    side = unit(side + cosine * (mean - (mean * x).sum(axis=1, keepdims=True) * x))
    both = np.concatenate([x, 0.901 * x + np.sqrt(1 - 0.901**2) * side]).astype(np.float32)
    u = unit(both.astype(np.float64))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = table(near_vectors.near_vectors(vectors(spark, both)), "vec_id")
    assert near.sum() >= 4000
    # a table of a million such vectors, which is cut into small cells
    lines_ = near_vectors.Lines(64, 1_000_000, 0.9, unit(x))
    pairs = [lines_.cells(part) for part in (u[:n], u[n:])]
    assert (lines_.layout.picks > 0 or cosine > 0.7) and (~(pairs[0] == pairs[1]).any(axis=1)).sum() <= 2
    assert [got[i]["n_links"] for i in range(2 * n)] == near.sum(axis=1).tolist()


def test_near_vectors_in_small_cells_of_clusters(spark, monkeypatch):
    # as if cells cost nothing to open and pairs much to count, so that a small table is cut finely
    monkeypatch.setattr(near_vectors, "OPENED", 1.0)
    monkeypatch.setattr(near_vectors, "COUNTED", 1.0)
    monkeypatch.setattr(near_vectors, "BLOCK", 64)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 32))
    x = (centres[rng.integers(0, 20, 3000)] + 0.33 * rng.standard_normal((3000, 32))).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    assert near_vectors.layout(u, len(x), 0.9).picks > 0
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = table(near_vectors.near_vectors(vectors(spark, x)), "vec_id")
    lost = near.sum() - sum(r["n_links"] for r in got.values())
    assert 0 <= lost <= 1e-4 * near.sum() and near.sum() > 10_000


def test_collisions_are_counted_exactly():
    rng = np.random.default_rng(7)
    for nx, ny in ((1, 1), (3, 200), (130, 64), (65, 129)):
        px, py = (rng.standard_normal((n, 9)).astype(np.float32) for n in (nx, ny))
        count = (np.abs(px[:, None] - py[None]) <= np.float32(0.7)).sum(axis=2)
        for least in (1, 4, 5, 9, 10):
            a, b = near_vectors.colliding(px, py, np.float32(0.7), least)
            assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(count >= least)), strict=True))


def test_quality(spark, odd, none):
    # the smallest table has 19 held-out labels, too few to tell
    larger = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.9
    model = quality.fit(docs, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows) and quality.score(none, model).count() == 0
    assert quality.classify(odd, labels.where("doc_id < 0")).count() == len(ODD)


def test_quality_of_repeated_ids_in_any_order(spark):
    rows = [(i, f"text {i} of many words", i % 2) for i in range(1, 60)]
    extra = [(i, f"{'Z' * i} 99 !! {i}", i % 2) for i in range(1, 60)]
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    docs = spark.createDataFrame([r[:2] for r in rows + extra], "doc_id long, text string")
    back = spark.createDataFrame([r[:2] for r in (rows + extra)[::-1]], "doc_id long, text string")
    one, two = (sorted((r["doc_id"], r["score"]) for r in quality.classify(d, labels).collect()) for d in (docs, back))
    # the last neighbour may be one of two that are equally near
    assert np.allclose([s for _, s in one], [s for _, s in two], atol=0.05) and [i for i, _ in one] == [i for i, _ in two]


def test_words_with_the_same_letters_differ():
    assert (quality.features("listen") != quality.features("silent")).any()


def test_lines(spark, odd, none):
    a = "the quick brown fox jumps over the lazy dog today"
    docs = spark.createDataFrame([(1, f"{a}\nkeep me"), (2, f"{a.replace('fox', 'cat')}\nother"), (3, a), (4, a + " again"), (5, "keep me\n\nmine")], "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): r["edits"] for r in lines.dropped_lines(docs).collect()}
    assert got == {(2, 0): 1, (3, 0): 0, (4, 0): 1, (5, 0): 0}
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()} == {1: f"{a}\nkeep me", 2: "other", 5: "\nmine"}
    kept = {r["doc_id"] for r in lines.dedup_lines(odd).collect()}
    assert {None, 1, 2, 3, 4, 6, 8} == kept and lines.dedup_lines(none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want[got.columns].values.tolist()))


def test_mixing(spark, odd, none):
    docs = spark.createDataFrame([(i, "a b c d", "big" if i % 10 else "small") for i in range(1000)], "doc_id long, text string, source string")
    assert mixing.mixed(docs, entropy=1.0).groupBy("source").count().where("count between 495 and 500").count() == 2
    capped = {r["source"]: r["count"] for r in mixing.mixed(docs, entropy=None, most_repeats=2.0).groupBy("source").count().collect()}
    assert 195 <= capped["small"] <= 200 and 795 <= capped["big"] <= 800
    assert mixing.passes(odd).count() == len(ODD) and mixing.mixture(none).count() == 0 and mixing.mixed(odd).columns == odd.columns


def test_mixed_keeps_rows_without_id(spark):
    rows = [(i if i % 5 else None, f"a b c {i}", None if i % 7 == 0 else "big" if i % 10 else "small") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    often = {tuple(r) for r in mixing.passes(docs, entropy=1.0).where("doc_id is null").select("source", "passes").collect()}
    got = [tuple(r) for r in mixing.mixed(docs, entropy=1.0).collect()]
    assert len(often) == 3 and max(n for _, n in often) > 1
    assert all(got.count(r) == dict(often)[r[2]] for r in rows if r[0] is None) and len(got) == mixing.mixture(docs, entropy=1.0).count()


def test_pipeline(spark):
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, SF).cache()
        n = docs.select("doc_id").distinct().count()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and (before is None or n <= before), i
        before = n
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == docs.count() > 100


def test_stages_keep_null_and_repeated_ids(spark):
    """Exact rows of the stages after the classifier, which only scores rows singly."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, a, "en", "s", 1), (None, a, "en", "s", 1), (1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, "", "en", "s", 0), (3, None, "en", "s", None), (4, b, "en", "s", 5), (4, b + " more", "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    counted = lambda df: sorted(map(tuple, df.select(*docs.columns).collect()), key=str)
    lines_, near, mix, encode = (f for _, f in corpus_pipeline.STAGES[1:])
    one = lines_(spark, docs, SF)
    # the second row of document 4 has a line that is one word away from the first's, which has the same place
    assert counted(one) == sorted(rows, key=str)
    kept = [*rows[:3], *rows[4:7]]
    two = near(spark, one, SF)
    assert counted(two) == sorted(kept, key=str)
    three = mix(spark, two, SF)
    assert counted(three) == sorted(kept, key=str)
    four = encode(spark, three, SF).collect()
    assert sorted(((r["doc_id"], r["n_tokens"] > 0) for r in four), key=str) == sorted(((r[0], bool(r[1])) for r in kept), key=str)


def test_mixture_of_a_tiny_source_beside_a_large_one(spark):
    """One word beside a million: passes beyond 32 bits, written out only as far as they are asked for."""
    docs = spark.createDataFrame([(0, "tiny", "word")] + [(i, "large", "w " * 1000) for i in range(1, 1001)], "doc_id long, source string, text string")
    often = {r["doc_id"]: r["passes"] for r in mixing.passes(docs, entropy=0.95, budget=20_000_000_000).where("doc_id < 2").collect()}
    plan = {r["source"]: r["quota"] for r in mixing.weights(spark.createDataFrame([("tiny", 1), ("large", 1_000_000)], "source string, tokens long"), 0.95, None, 20_000_000_000).collect()}
    assert often[0] == plan["tiny"] > 1 << 31
    rows = mixing.mixture(docs.where("doc_id = 0"), entropy=None, most_repeats=None, budget=100_000)
    assert rows.count() == 100_000 and rows.select("epoch").distinct().count() == 100_000 and rows.agg({"epoch": "max"}).first()[0] == 99_999
    assert mixing.mixed(docs.where("doc_id = 0"), entropy=None, most_repeats=None, budget=70_000).count() == 70_000
    assert len(mixing.mixture(docs, entropy=0.95, budget=20_000_000_000).limit(3).collect()) == 3


def test_entropy_and_repetition_limit_together(spark):
    sizes = spark.createDataFrame([("a", 1_000_000), ("b", 1_000), ("c", 10)], "source string, tokens long")
    both = mixing.solve(sizes, 0.9, 5.0)[0]
    assert both == max(mixing.solve(sizes, 0.9, None)[0], mixing.solve(sizes, None, 5.0)[0])
    assert mixing.solve(sizes, 0.2, 1e9)[0] == mixing.solve(sizes, 0.2, None)[0]


def test_classifier_keeps_columns_and_breaks_ties(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    kept = quality.keep_good(docs.selectExpr("*", "7.5D as score", "doc_id as __quality"), labels)
    assert {r["score"] for r in kept.select("score").distinct().collect()} == {7.5} and kept.columns[-2:] == ["score", "__quality"]
    counts = np.stack([quality.features("equal words")] * 60)
    model = quality.Model(counts, np.array([0, 1] * 30))
    # all are equally near: those of label 1 come first, 25 of 30
    assert model.score(counts[:1])[0] == pytest.approx(1.0)
