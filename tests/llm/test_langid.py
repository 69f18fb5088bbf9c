"""Language ID: the forward sum against all segmentations, learning, and held-out accuracy."""

import math
from itertools import product

import numpy as np
import public_tokenizers

from spendlake.llm import langid
from spendlake.llm.queries import op4_langid

VOCAB = public_tokenizers.path("piece_bpe_32k.model")
RAW = open(VOCAB, "rb").read()
ROWS = "doc_id long, text string, lang string, lang_pred int"


def segmentations(word):
    for cuts in product([0, 1], repeat=len(word) - 1):
        parts, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[last:i])
                last = i
        yield [*parts, word[last:]]


def test_forward_sums_all_segmentations():
    p = langid.Pieces(RAW, 8)
    rng = np.random.default_rng(1)
    prob = rng.random((p.size, 2))
    prob[p.none] = 0
    index = {t: i for i, t in enumerate(p.texts)}
    for word in ("the", "lañción", "x漢z", "a"):
        at, codes = next(langid.by_length([word]))
        got = langid.forward(p.cover(codes), codes.shape[1], prob)[0, -1]
        want = np.zeros(2)
        for s in segmentations(langid.START + word):
            ids = [index.get(x, p.unknown if len(x) == 1 else p.none) for x in s]
            want += np.prod(prob[ids], axis=0)
        assert np.allclose(got, want)
        uses = langid.expected(p, [word], np.array([3.0]), prob[:, 0])
        slow = np.zeros(p.size)
        for s in segmentations(langid.START + word):
            ids = [index.get(x, p.unknown if len(x) == 1 else p.none) for x in s]
            for i in ids:
                slow[i] += 3 * np.prod(prob[ids, 0]) / want[0]
        slow[p.none] = 0
        assert np.allclose(uses, slow)


def test_long_pieces_take_part():
    p = langid.Pieces(RAW)
    rng = np.random.default_rng(2)
    prob = rng.random((p.size, 2))
    prob[p.none] = 0
    index = {t: i for i, t in enumerate(p.texts)}
    longest = max(map(len, p.texts))
    assert longest > 8 and p.max_piece == longest
    for word in (max((t for t in p.texts if t[0] == langid.START and len(t) <= 13), key=len)[1:], "information"):
        _, codes = next(langid.by_length([word]))
        want = np.zeros(2)
        for s in segmentations(langid.START + word):
            want += np.prod(prob[[index.get(x, p.unknown if len(x) == 1 else p.none) for x in s]], axis=0)
        assert np.allclose(langid.log_probability(p, codes, prob, langid.logarithm(prob)), np.log(want))


def test_training_takes_the_longest_piece(spark):
    docs = spark.createDataFrame([(1, "the information", "en", 0)], ROWS)
    model = langid.train(docs, VOCAB)
    assert len(model.prob) == langid.Pieces(RAW).size > langid.Pieces(RAW, 8).size


def test_learns_odd_rows(spark):
    rows = [(i, "the cat and the dog " * 3, "en", 0) for i in range(8)] + [(i, "der hund und die katze", "de", 0) for i in range(8, 16)]
    rows += [(20, None, "en", 1), (21, "", "de", 1), (22, "12 !!", "en", 1), (23, "the dog", None, 1), (None, "die katze", None, 1), (8, rows[8][1], "de", 0)]
    rows += [(24, "z" * 200_000 + " die " * 3, None, 1), (25, "THE\nDOG", None, 1)]
    docs = spark.createDataFrame(rows, ROWS)
    model = langid.train(docs, VOCAB)
    assert model.langs == ["de", "en"] and np.allclose(model.prob.sum(0), 1)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[20] == by[21] == by[22] == ("und", 0.0)
    assert by[23][0] == by[25][0] == "en" and by[None][0] == "de" and by[24][0] in ("de", "en")
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)


def test_empty_and_unlabelled_tables(spark):
    docs = spark.createDataFrame([(1, "the", None, 1)], ROWS)
    model = langid.train(docs, VOCAB)
    assert [tuple(r) for r in langid.predict(docs, model).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert langid.predict(docs.limit(0), model).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_langid(spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert len(held) > 100
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) / len(held) > 0.97


def test_long_unseen_runs_in_a_large_table():
    p = langid.Pieces(RAW, 8)
    counts = np.full((p.size, 3), 0.01)
    counts[p.none] = 0
    for k, word in enumerate(["der", "the", "les"]):
        counts[p.texts.index(langid.START + word), k] += 1e10 * (k + 1)
    model = langid.Model(["de", "en", "fr"], np.ones(3) / 3, counts / counts.sum(0), RAW, 8)
    texts = ["the the", "the the " + "漢" * 40, "漢" * 40, "ก" * 3000 + " der", "z" * 100]
    langs, score = model.predict(texts)
    assert langs[0] == "en" and langs[2] == "de"  # a smaller total leaves more to unseen letters
    assert np.isfinite(score).all() and (score > 0).all() and (score <= 1).all()
    assert langid.runs("Z" * 100) == ["z" * 100]
    rng = np.random.default_rng(3)
    prob = rng.random((p.size, 2))
    prob[p.none] = 0
    _, codes = next(langid.by_length(["internationalisierungsmaßnahmen"]))
    n, cover = codes.shape[1], p.cover(codes)
    plain = langid.forward(cover, n, prob)
    assert np.allclose(langid.log_forward(cover, n, langid.logarithm(prob), p.none), np.log(plain))
    # the long words' uses, scaled, add up to all their characters
    for unseen in (1e-1, 1e-14):
        got = langid.expected(p, ["漢" * 200], np.array([2.0]), np.where(np.arange(p.size) == p.unknown, unseen, np.r_[np.full(p.none, 1e-3), 0]))
        assert np.isclose(got[p.unknown], 400)
