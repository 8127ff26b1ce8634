"""Language models against sums over every segmentation, and on held-out documents."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest

from soundtally.llm import languages

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(text, ids, single):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        piece = text[:n] if text[:n] in ids else "" if n == 1 and text not in single and text[0] not in single else None
        if piece is not None:
            for rest in segmentations(text[n:], ids, single):
                yield [piece, *rest]


WORDS = ["a", "the", "letter", "éclair", "straße", "ωβ", "xq", "東京", "ﬁ", "aaaa", "\U0001d4d0x", "ation"]


def test_forward_sums_every_segmentation():
    known = languages.loaded(PATH)
    ids = {p: i for i, p in enumerate(known.pieces)}
    single = {p for p in known.pieces if len(p) == 1}
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.ones(len(known.pieces)), 3).T)
    lattice = languages.Lattice(WORDS, known)
    totals, expected = lattice.totals(logs), lattice.expected(logs[:, 0])
    for k, w in enumerate(WORDS):
        paths = [[ids[p] for p in path] for path in segmentations(languages.MARK + w, ids, single)]
        for lang in range(3):
            assert totals[k, lang] == pytest.approx(math.log(sum(math.exp(logs[path, lang].sum()) for path in paths)), rel=1e-9)
        share = np.array([math.exp(logs[path, 0].sum()) for path in paths])
        want = {}
        for path, s in zip(paths, share / share.sum(), strict=True):
            for i in path:
                want[i] = want.get(i, 0) + s
        got = {}
        for i, e in zip(lattice.piece[lattice.word == k], expected[lattice.word == k], strict=True):
            got[i] = got.get(i, 0) + e
        assert {i: round(v, 9) for i, v in got.items() if round(v, 9)} == {i: round(v, 9) for i, v in want.items() if round(v, 9)}


def test_very_long_words_keep_their_precision():
    known = languages.loaded(PATH)
    logs = known.base[:, None]
    one, two = languages.Lattice(["qz" * 20_000], known).totals(logs)[0, 0], languages.Lattice(["qz" * 10_000], known).totals(logs)[0, 0]
    assert math.isfinite(one) and one == pytest.approx(2 * two, rel=1e-2)


def test_words():
    assert languages.counted(None) == {} and languages.counted("12 ½ ² _ -") == {}
    assert languages.counted("Ab ab1AB x²y") == {"ab": 3, "xy": 1}


def test_counts_add_up_to_words(spark):
    docs = spark.createDataFrame([("a", "the the cat"), ("b", "le chat"), ("a", None), ("c", "")], "lang string, text string")
    rows = languages.piece_counts(docs, PATH).collect()
    known = languages.loaded(PATH)
    for lang, letters in (("a", len("▁the▁the▁cat")), ("b", len("▁le▁chat"))):
        assert sum(r["n"] / languages.UNIT * len(known.pieces[r["piece"]] or "?") for r in rows if r["lang"] == lang) == pytest.approx(letters, abs=1e-3)
    assert {r["lang"] for r in rows} == {"a", "b"}


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = languages.predicted(docs, PATH).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in lang}
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out]) > 0.99 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_is_no_input(spark):
    """Held-out rows are predicted alike whatever they say of themselves."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "case when crc32(string(doc_id)) % 3 = 1 then 'xx' else lang end as lang")
    pick = lambda d: {r["doc_id"]: (r["lang_pred"], r["score"]) for r in languages.predicted(d, PATH).collect()}
    assert pick(docs) == pick(other)


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    rows = languages.predicted(spark.createDataFrame([(1, "text", None), (None, "text", "en")], schema), PATH).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}
    assert languages.predicted(spark.createDataFrame([], schema), PATH).count() == 0


def test_more_languages_than_a_model_has(spark, monkeypatch):
    """All of 130 languages can be predicted, and models of a few languages find what one of all finds."""
    ids = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 3 != 1]
    new = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 3 == 1]
    word = lambda k: "".join(chr(97 + (k * 7 + j * (k % 5 + 3)) % 26) for j in range(9)) + chr(0x430 + k % 32)
    lang = lambda k: f"l{k:03d}"
    rows = [(i, " ".join([word(j % 130)] * 20), lang(j % 130)) for j, i in enumerate(ids)] + [(i, word(j % 130) + " " + word(j % 130), None) for j, i in enumerate(new)] + [(None, "1", None), (None, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pick = lambda: {(r["doc_id"], r["held_out"]): (r["lang_pred"], r["score"]) for r in languages.predicted(docs, PATH).where("doc_id is not null").collect()}
    two = pick()
    assert len(two) == 1200 and all(two[i, True][0] == lang(j % 130) for j, i in enumerate(new))
    monkeypatch.setattr(languages, "LANGUAGES", 1000)
    one = pick()
    assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in two.items()} and all(abs(one[k][1] - two[k][1]) <= 2e-9 for k in one)
