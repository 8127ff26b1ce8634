"""Registered queries whose rows SQL can't express, against brute force over the same whole tables."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from soundtally.llm import mixing, quality, queries

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
QUERIES = queries.queries()


def read(name, sf=SF):
    return duckdb.sql(f"select * from '{sf}/{name}.parquet'").df().to_dict("records")


@pytest.fixture(scope="module")
def docs():
    return read("documents")


def run(spark, name, sf=SF):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def reach(ids, linked):
    """Smallest id reachable of each id."""
    low = {i: i for i in ids}

    def head(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in linked:
        x, y = head(a), head(b)
        low[max(x, y)] = min(x, y)
    return {i: head(i) for i in ids}


def groups(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, reach(sets, linked)


def test_op1(spark, docs):
    rows = run(spark, "op1_balanced_shards")
    text = {d["doc_id"]: d["text"] or "" for d in docs}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in text.items()}
    held = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
    assert all(h == list(range(len(h))) for h in held) and max(map(len, held)) - min(map(len, held)) <= 1
    assert len(rows) == len(docs) and {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_op3(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], 0, byte_fallback=True))
    want.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    got = {r["doc_id"]: r["n_tokens"] for r in run(spark, "op3_token_counts")}
    assert got == {d["doc_id"]: len(want.encode(d["text"] or "", add_special_tokens=False).ids) for d in docs}


def test_op4(spark, docs):
    sets, low = groups({d["doc_id"]: d["text"] for d in docs}, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, "op4_minhash_near_dedup")}
    assert got == {i: (len(sets[i]), low[i], low[i] == i) for i in sets}


def encoded(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(" ".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False))


def library():
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_op5(spark, docs):
    want = {d["doc_id"]: encoded(library(), d["text"]) for d in docs}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op5_bpe_round_trip")} == want


def vectors():
    return {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in read("embeddings") if r["embedding"] is not None}


def test_op6(spark):
    held, hit, n = vectors(), 0, 0
    found = {}
    for r in run(spark, "op6_nearest_neighbours"):
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    assert set(found) == {i for i in held if i % 100 == 0}
    for q, ranks in found.items():
        far = {i: math.sqrt(((x - held[q]) ** 2).sum()) for i, x in held.items() if i != q}
        best = sorted((d, i) for i, d in far.items())[:10]
        assert sorted(ranks) == list(range(1, 11)) and [ranks[k] for k in sorted(ranks)] == sorted(ranks.values())
        assert all(abs(far[i] - d) < 1e-12 for d, i in ranks.values())
        hit, n = hit + len({i for _, i in best} & {i for _, i in ranks.values()}), n + 10
    assert hit >= 0.9 * n


def plain_features(text):
    """Hashed counts of a text, byte by byte."""
    raw, u32 = (text or "").encode(), 0xFFFFFFFF
    out = [0.0] * (quality.SHAPES + quality.WORDS)
    kinds = []
    for c in raw:
        k = 0x61 if chr(c).isalpha() and 0x61 <= c <= 0x7A or c >= 0x80 else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else 0x0A if 0x09 <= c <= 0x0D else c
        if not kinds or kinds[-1] != k:
            kinds.append(k)
    for n in (1, 2, 3, 5):
        for i in range(len(kinds) - n + 1):
            h = n * 2654435761 & u32
            for k in kinds[i : i + n]:
                h = (h ^ k) * 0x9E3779B1 & u32
                h ^= h >> 15
            out[h % quality.SHAPES] += 1
    word = None
    for c in [*raw, 0x20]:
        if c > 0x20:
            total, place = word or (0, 0)
            word = (total + ((c * 0x85EBCA6B & u32) ^ (c << 9)) * (place * 0x9E3779B2 + 1)) & u32, place + 1
        elif word:
            h = word[0] ^ word[0] >> 13
            out[quality.SHAPES + ((h * 0xC2B2AE35 & u32) >> 8) % quality.WORDS] += 1
            word = None
    return out


def voted(texts, sf=SF):
    """Scores by a plain loop over all labelled texts, which are all that may be learnt from at this size."""
    docs, marks = {d["doc_id"]: d["text"] for d in read("documents", sf)}, {}
    for r in read("labels", sf):
        marks.setdefault(r["doc_id"], set()).add(r["quality"])
    ids = sorted(i for i, m in marks.items() if len(m) == 1 and i in docs and zlib.crc32(str(i).encode()) % 5)
    labels = [min(marks[i]) for i in ids]
    counts = np.array([plain_features(docs[i]) for i in ids])
    idf = [math.log((1 + len(ids)) / (1 + sum(c > 0))) + 1 for c in counts.T]

    def weighted(c):
        x = np.log1p(c) * idf
        return x / max(np.linalg.norm(x), 1e-9)

    axes = np.linalg.svd(np.array([weighted(c) for c in counts]))[2][: quality.DIMENSIONS]
    latent = lambda c: (lambda v: v / max(np.linalg.norm(v), 1e-9))(axes @ weighted(c))
    known, out = [latent(c) for c in counts], []
    for text in texts:
        own = np.array(plain_features(text))
        here = latent(own)
        near = sorted((-round(float(here @ k), 9), -v, i) for k, v, i in zip(known, labels, ids, strict=True))[: quality.NEIGHBOURS]
        weight = [max(-s, 0.0) ** quality.SHARPNESS for s, _, _ in near]
        out.append(sum(-v * w for w, (_, v, _) in zip(weight, near, strict=True)) / sum(weight) if own.any() and sum(weight) else sum(labels) / len(labels))
    return out


def test_op7(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op7_quality_classifier")}
    want = voted([d["text"] for d in docs])
    assert len(got) == len(docs)
    for d, score in zip(docs, want, strict=True):
        r = got[d["doc_id"]]
        assert abs(r["score"] - score) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)


def test_op8(spark):
    held = vectors()
    ids = [i for i, x in sorted(held.items()) if np.isfinite(x).all() and x.any()]
    x = np.stack([held[i] / np.linalg.norm(held[i]) for i in ids])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    low = reach(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    got = {r["vec_id"]: r for r in run(spark, "op8_embedding_near_dedup")}
    assert [got[i]["n_links"] for i in ids] == near.sum(axis=1).tolist()
    assert all(got[i]["component_id"] == low[i] and got[i]["kept"] == (low[i] == i) for i in ids)


def mixture(rows, entropy=0.95):
    """{doc_id: passes}; rows: (doc_id, source, text)."""
    tokens = {i: len((t or "").encode().split()) for i, _, t in rows}
    sources = {}
    for i, s, _ in rows:
        sources.setdefault(s, []).append(i)
    total = {s: sum(tokens[i] for i in many) for s, many in sources.items()}
    every = sum(total.values())
    p = {s: t / every for s, t in total.items() if t}
    low, high = 0.0, 1.0
    for _ in range(50):
        a = (low + high) / 2
        w = [x**a / sum(y**a for y in p.values()) for x in p.values()]
        low, high = (low, a) if -sum(x * math.log(x) for x in w) < entropy * math.log(len(p)) else (a, high)
    a = round(low, 6)
    z = sum(y**a for y in p.values())
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    out = {}
    for s, many in sources.items():
        if not total[s]:
            out |= dict.fromkeys(many, 1)
            continue
        quota = math.floor(round(p[s] ** a / z, 9) * every)
        blocks = math.ceil(total[s] / max(mixing.BLOCK_TOKENS, math.ceil(total[s] / mixing.MOST_BLOCKS)))
        block = {i: int(md5(f"0:{i}")[:8], 16) % blocks for i in many}
        turn = sorted(many, key=lambda i: (md5(f"0:{s}:{block[i]}"), block[i], md5(f"0:{i}"), i))
        used = 0
        for i in turn:
            used += tokens[i]
            out[i] = quota // total[s] + (used <= quota % total[s])
    return out


def test_op10(spark, docs):
    want = mixture([(d["doc_id"], d["source"], d["text"]) for d in docs])
    rows = run(spark, "op10_mixture")
    assert Counter(r["doc_id"] for r in rows) == {i: n for i, n in want.items() if n}
    assert len({(r["doc_id"], r["epoch"]) for r in rows}) == len(rows)


def one_word_apart(a, b):
    first = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    last = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
    return abs(len(a) - len(b)) <= 1 and first + last >= max(len(a), len(b)) - 1


def without_lines(texts, least=8):
    """Texts without the lines that an earlier one makes superfluous; {doc_id: text}."""
    first, gone = {}, set()
    for i in sorted(texts):
        for n, line in enumerate((texts[i] or "").split("\n")):
            line = line.strip(" ")
            if line and line in first:
                gone.add((i, n))
            elif line:
                first[line] = (i, n)
    sized = {}
    for line, at in first.items():
        words = line.split(" ")
        if len(words) >= least:
            near = (o for n in range(len(words) - 1, len(words) + 2) for o in sized.get(n, []))
            if any((o[0] == words[0] or o[-1] == words[-1]) and one_word_apart(o, words) for o in near):
                gone.add(at)
            sized.setdefault(len(words), []).append(words)
    out = {}
    for i, t in texts.items():
        parts = [] if t is None else t.split("\n")
        kept = [x for n, x in enumerate(parts) if (i, n) not in gone]
        if len(kept) == len(parts) or any(x.strip(" ") for x in kept):
            out[i] = t if t is None else "\n".join(kept)
    return out


def test_pipeline(spark, docs):
    known = {d["doc_id"]: d for d in docs}
    good = [i for i, s in zip(known, voted([d["text"] for d in docs]), strict=True) if s >= 0.3]
    texts = without_lines({i: known[i]["text"] for i in good})
    _, low = groups(texts, 5, 80)
    kept = {i: t for i, t in texts.items() if low[i] == i}
    times = mixture([(i, known[i]["source"], t) for i, t in kept.items()])
    tokenizer = library()
    want = Counter({(i, known[i]["source"], *encoded(tokenizer, kept[i])): n for i, n in times.items() if n})
    digest = lambda ids: hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["source"], r["n_tokens"], digest(r["token_ids"]), r["decoded_sha256"]) for r in got) == want


@pytest.mark.parametrize("empty", [False, True])
def test_queries_over_odd_tables(spark, tmp_path, empty):
    """Null fields, empty and repeated rows, and columns whose names the operators use themselves; also no rows at all."""
    rows = [(None, "no id", None, None, 1), (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n ", "en", None, 3), (4, "one two", "en", "b", 7), (4, "one two", "en", "b", 7), (5, "one two", "en", "b", 7), (6, "w " * 30_000, "en", "b", 1)]
    clash = "score double, token_ids string, hub string, part int, block int, c long, id long, list int, n_tokens string, component_id string, shard string, line_no string"
    extra = (0.5, "x", "h", 1, 1, 1, 1, 1, "x", "x", "x", "x")
    more, odd = ", key string, at long, node string, more string, root string, piece int, n long, held_out int", ("k", 1, "n", "m", "r", 1, 1, 1)
    put = lambda name, data, schema: spark.createDataFrame([] if empty else data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("documents", [(*r, *extra, *odd) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clash}{more}")
    put("labels", [(4, 1, 0), (5, None, None), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    vectors = [(0, [1.0, 0.5]), (100, [1.0, 0.5]), (100, [1.0, 0.5]), (1, None), (2, []), (3, [0.0, 0.0]), (None, [1.0, 2.0]), (4, [1.0, None])]
    vectors = [(i, None if v is None else [x for x in v for _ in range(8)], 7 if i else None, *extra, "c", 1, 1) for i, v in vectors]
    put("embeddings", vectors, f"vec_id long, embedding array<float>, label int, {clash}, code string, error long, v int")
    got = {name: [r.asDict() for r in q(spark, str(tmp_path)).collect()] for name, q in QUERIES.items()}
    got["pipeline"] = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    if empty:
        assert not any(got.values())
        return
    for name in ("op1_balanced_shards", "op3_token_counts", "op4_minhash_near_dedup", "op5_bpe_round_trip", "op7_quality_classifier", "op11_merkle_manifest", "op13_language"):
        assert Counter(r["doc_id"] for r in got[name]) == Counter(r[0] for r in rows), name
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got["op6_nearest_neighbours"]} == {(0, 1, 100, 0.0), (100, 1, 0, 0.0)}
    assert {r["vec_id"]: r["n_links"] for r in got["op8_embedding_near_dedup"]} == {0: 1, 100: 1, 1: 0, 2: 0, 3: 0, 4: 0, None: 0}
    assert {r["component_id"] for r in got["op4_minhash_near_dedup"] if r["doc_id"] in (4, 5)} == {4}
    assert all(r["verified"] for r in got["op11_merkle_manifest"]) and len({r["root"] for r in got["op11_merkle_manifest"]}) == 1
    coded = {(r["vec_id"], r["error"], r["label_error"]) for r in got["op12_vector_codes"]}
    assert coded == {(0, 0, 0), (100, 0, 0), (3, 0, 0), (None, 0, 0)} and len(got["op12_vector_codes"]) == 5
    assert {r["doc_id"]: r["lang_pred"] for r in got["op13_language"]} == {None: "en", 1: "und", 2: "und", 3: "und", 4: "en", 5: "en", 6: "en"}
    assert {r["doc_id"] for r in got["pipeline"]} <= {None, 1, 2, 3, 4, 6}
