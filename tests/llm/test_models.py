import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, frame, prose, words
from pyspark.sql import functions as F

from flowlens.llm import language, toxicity
from flowlens.llm.common import crc_mod, letters_grams

STEMS = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "éüñßç"}


def sentences(seed, n):
    rng = random.Random(seed)
    return [(k, prose(rng, rng.randint(3, 40), STEMS[lang]), lang) for k in range(n) for lang in [rng.choice(list(STEMS))]]


def test_language_of_held_out_texts():
    train, test = sentences(1, 200), sentences(2, 100)
    model = language.train([t for _, t, _ in train], [x for *_, x in train])
    got, score, ambiguous = language._decide(model)(pa.array([t for _, t, _ in test]))
    right = [a == x for a, (*_, x) in zip(got.to_pylist(), test, strict=True)]
    assert np.mean(right) > 0.97
    assert all(0 <= s <= 1 for s in score.to_pylist()) and np.mean(ambiguous.to_pylist()) < 0.1


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    apart = (code.shape[1] - code @ code.T) / 2
    assert code.shape[0] == n and (apart + np.eye(n) * 99).min() >= 1
    assert (np.abs(code.sum(axis=0)) < n).all()  # every bit splits the languages


def test_whole_text_counts():
    """A text's decision is the same read at once or joined from its parts."""
    train = sentences(1, 100)
    model = language.train([t for _, t, _ in train], [x for *_, x in train])
    text = "abc " * 10 + "klmno " * 100_000
    assert language._decide(model)(pa.array([text]))[0].to_pylist() == ["cc"]


def test_letter_grams_by_hand():
    grams = {s: sorted(zip(*map(np.ndarray.tolist, next(letters_grams(["Ab", "1c!", "..", "é"], (s,), 1 << 40))), strict=True)) for s in (1, 2, 3)}
    assert [w for w, _ in grams[1]] == [0, 0, 1, 3]  # a b c é
    assert [w for w, _ in grams[2]] == [0, 0, 0, 1, 1, 3, 3]  # _a ab b_ _c c_ _é é_
    assert [w for w, _ in grams[3]] == [0, 0, 1, 3]  # _ab ab_ _c_ _é_


def test_language_edges(spark):
    docs = frame(spark)
    model = language.fit(docs.filter(crc_mod("doc_id", 5) != 0))
    got = language.identified(docs, model)
    assert got.columns == [*docs.columns, "lang_pred", "lang_score", "lang_ambiguous"]
    rows = got.collect()
    assert len(rows) == len(corpus())
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.lang_score, r.lang_ambiguous) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("x", "y") and 0 < r.lang_score <= 1
    again = language.identified(got, model)  # its own columns in the input are replaced
    assert again.columns == got.columns
    nothing = language.fit(docs.filter(F.lit(False)))
    assert {r.lang_pred for r in language.identified(docs, nothing).collect()} == {"und"}
    assert language.identified(frame(spark, []), model).count() == 0


# --- toxicity ----------------------------------------------------------------------------------


def toxic_rows(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        text, bad = prose(rng, rng.randint(1, 150)).split(" "), k % 3 == 0
        if bad:
            for _ in range(2):
                text[rng.randrange(len(text))] = "zork" + rng.choice(["", "ab", "cd", "e"])
        out.append((k, " ".join(text), int(bad)))
    return out


def test_held_out_toxicity():
    train, test = toxic_rows(1, 240), toxic_rows(2, 120)
    model = toxicity.train([t for _, t, _ in train], [y for *_, y in train], 1 / 3)
    net, slope, offset = model
    best, where = toxicity.largest(net, pa.array([t for _, t, _ in test]))
    score = 1 / (1 + np.exp(-(slope * best + offset)))
    bad = np.array([y for *_, y in test], bool)
    assert (score[bad] >= 0.7).mean() > 0.9 and (score[~bad] >= 0.7).mean() < 0.1
    inside = [any(w.startswith("zork") for w in words(t)[a : a + toxicity.WINDOW]) for (_, t, _), a, b in zip(test, where, bad, strict=True) if b]
    assert np.mean(inside) > 0.9


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    words_ = toxicity.Words(pa.array(["abcd", "efgh", "zork", "ab", "x"]))
    net = toxicity.Network(seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes = rng.integers(0, 6, (7, toxicity.WINDOW))  # 5 is padding
    codes[:, 0] = 2
    y = rng.integers(0, 2, 7).astype(float)

    def loss():
        logits = net.forward(codes, net.projected(net.inputs(words_)))
        return float((np.logaddexp(0, logits) - y * logits).sum())

    keep = {}
    x = net.inputs(words_)
    logits = net.forward(codes, net.projected(x), keep)
    got = net.gradients(keep, 1 / (1 + np.exp(-logits)) - y, x, words_)
    for name, value in net.p.items():
        flat = value.reshape(-1)
        used = np.flatnonzero(np.abs(got[name].reshape(-1)) > 1e-4)
        for at in used[:: max(1, len(used) // 6)]:
            old, step = flat[at], 1e-3
            flat[at] = old + step
            up = loss()
            flat[at] = old - step
            down = loss()
            flat[at] = old
            assert abs((up - down) / (2 * step) - got[name].reshape(-1)[at]) < 2e-2 * max(1, abs(got[name].reshape(-1)[at])), name


def test_windows_cover_every_word():
    offsets = np.cumsum([0, 0, 1, 24, 25, 36, 37, 200])
    doc, first = toxicity.windows_of(offsets)
    for d, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        own = np.sort(first[doc == d])
        covered = {w for a in own for w in range(a, min(a + toxicity.WINDOW, hi))}
        assert covered == set(range(lo, hi))
        assert (np.diff(own) <= toxicity.STRIDE).all() and (own >= lo).all()


def test_toxicity_edges(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)] + [(1, 0, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, crc_mod("doc_id", 3) != 1)
    rows = toxicity.toxicity(docs, model).collect()
    assert len(rows) == len(corpus())
    assert all(0 <= r.toxic_score <= 1 and r.predicted == int(r.toxic_score >= 0.7) for r in rows)
    assert all(r.toxic_score == 0 for r in rows if not words(r.text))
    assert toxicity.fit(docs, labels.filter("toxic = 1"), F.lit(True)) is None
    assert {r.toxic_score for r in toxicity.toxicity(docs, None).collect()} == {0.0}
    assert toxicity.toxicity(frame(spark, []), model).count() == 0


def test_languages_are_learned_outside_the_driver(spark, monkeypatch):
    rows = sentences(6, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    at_hand, real = [], language.train
    alone = real([t for _, t, _ in rows], [x for *_, x in rows])
    monkeypatch.setattr(language, "train", lambda *a: at_hand.append(1) or real(*a))
    model = language.fit(docs)
    assert at_hand == [] and model.languages == alone.languages and model.weights.shape == alone.weights.shape
    assert language.fit(docs.filter("false")).languages == []


def test_training_counts_a_few_texts_at_once():
    rng = random.Random(7)
    texts = [prose(rng, 200, "abcdefghijklmnopqrstuvwxyz") for _ in range(600)]
    apart = np.zeros((600, language.SLOTS), np.float32)
    for k, text in enumerate(texts):
        language._features([text], apart[k : k + 1])
    together = np.zeros_like(apart)
    tracemalloc.start()
    language._features(texts, together)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (together == apart).all() and most < 15 << 20
