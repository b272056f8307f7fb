"""Language of a text by error-correcting output codes.

Every language gets a codeword. One binary classifier per bit (logistic, over the frequencies of
letter 1- to 3-grams) predicts the bits of a text; loss-weighted decoding picks the codeword of least
loss, each bit weighed by how well it tells that language apart in training. ``score`` is the share of
the winner in a softmax over the losses, and ``ambiguous`` flags winners with less than ``AMBIGUOUS``.

A text's n-gram frequencies are sums over its words, so each distinct word is scored once per slice and
the whole text is read, however long.

Training uses at most ``SAMPLE`` labelled rows in all (and a quarter more), spread evenly over the
languages: the documented bound of the classifier. It runs in one task; the driver gets the weights alone.

**Edge cases.** A null text or one without any letter is ``und`` with score 0, and ambiguous; so is
every text where no labelled row exists. With one language all other texts are that language. Ties go to
the first language by code point. Null languages and texts are not learned from. Repeated rows count each.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import appended, coded, hash_sample, letters_grams, ranges, task, words_of

SAMPLE = 1000
SLOTS = 1 << 13
SIZES = (1, 2, 3)
AMBIGUOUS = 0.6
UNKNOWN = "und"
# Characters of text that are worked on at once; what that takes is some fifty times as many bytes.
SLICE = 512 << 10
# The same for training, where each n-gram of each text is a number.
TRAINING_SLICE = 64 << 10


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """(languages, bits) of -1 and 1: all splits for few languages, else the best of random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.arange(1, 2 ** (n - 1))
        return 1.0 - 2.0 * ((splits >> np.arange(n)[:, None]) & 1)
    bits, rng, best, most = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None, -1
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if apart.min() > most and (np.abs(code.sum(axis=0)) < n).all():
            best, most = code, apart.min()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    trust: np.ndarray  # the same shape: weight of each bit for each language
    weights: np.ndarray  # SLOTS x bits
    bias: np.ndarray


def word_sums(words: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per distinct word: summed weights of its n-grams, and their number."""
    sums, counts = np.zeros((len(words), weights.shape[1])), np.zeros(len(words))
    for word, slot in letters_grams(words, SIZES, SLOTS):
        for k in range(weights.shape[1]):  # one bit at a time: a number per n-gram, not one per bit of it
            sums[:, k] += np.bincount(word, weights[slot, k], minlength=len(words))
        counts += np.bincount(word, minlength=len(words))
    return sums, counts


def _features(texts: list[str], out: np.ndarray) -> None:
    """N-gram frequencies per text, into the zeros of ``out``."""
    for lo, hi in ranges(np.array([len(t) for t in texts], np.int64), TRAINING_SLICE):
        _slice_features(texts[lo:hi], out[lo:hi])


def _slice_features(texts: list[str], out: np.ndarray) -> None:
    offsets, words = words_of(pa.array(texts, pa.string()))
    codes, distinct = coded(words)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    grams = [(w, s) for w, s in letters_grams(distinct.to_pylist(), SIZES, SLOTS)]
    pair, times = np.unique(doc * max(1, len(distinct)) + codes, return_counts=True)
    by_doc, by_word = np.divmod(pair, max(1, len(distinct)))
    for word, slot in grams:
        order = np.argsort(word, kind="stable")
        word, slot = word[order], slot[order]
        first, size = np.searchsorted(word, by_word), np.bincount(word, minlength=len(distinct))[by_word]
        rows = np.repeat(by_doc, size)
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        np.add.at(out, (rows, slot[at]), np.repeat(times, size))
    out /= np.maximum(out.sum(axis=1, keepdims=True), 1)


def _losses(margins: np.ndarray, codes: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """(texts, languages): logistic loss of each codeword, weighed by bit."""
    signed = margins[:, None, :] * codes[None]
    return (np.logaddexp(0, -signed) * trust[None]).sum(axis=2)


def train(texts: list[str], languages: list[str], rounds: int = 80) -> LanguageModel:
    names = sorted(set(languages))
    codes = codewords(len(names))
    bits = codes.shape[1]
    if len(names) < 2:
        return LanguageModel(names, codes, np.ones_like(codes), np.zeros((SLOTS, bits)), np.zeros(bits))
    own = np.array([names.index(x) for x in languages])
    # Short pieces beside whole texts, so that short texts are judged as surely.
    pieces = [" ".join(t.split()[3 : 3 + 8]) or t for t in texts]
    x = np.zeros((2 * len(texts), SLOTS), np.float32)
    _features(texts, x[: len(texts)])
    _features(pieces, x[len(texts) :])
    y, own = codes[np.concatenate([own, own])], np.concatenate([own, own])
    spread = np.concatenate([x[:, lo : lo + 512].std(axis=0) for lo in range(0, SLOTS, 512)])
    scale = (1 / (spread + 1e-4)).astype(np.float32)
    x *= scale
    balance = 1 / np.bincount(own)[own]
    balance = (balance / balance.sum()).astype(np.float32)
    y = y.astype(np.float32)
    w, b = np.zeros((SLOTS, bits), np.float32), np.zeros(bits, np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, rounds + 1):  # Adam, on all rows at once
        pull = -y / (1 + np.exp(np.clip(y * (x @ w + b), -60, 60))) * balance[:, None]
        gw, gb = x.T @ pull + np.float32(1e-5) * w, pull.sum(axis=0)
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.999 * vw + 0.001 * gw**2, 0.999 * vb + 0.001 * gb**2
        rate = np.float32(0.03 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
        w -= rate * mw / (np.sqrt(vw) + 1e-8)
        b -= rate * mb / (np.sqrt(vb) + 1e-8)
    right = (np.sign(x @ w + b) == y).astype(float)
    trust = np.stack([right[own == k].mean(axis=0) for k in range(len(names))]) + 1e-3
    return LanguageModel(names, codes, trust / trust.mean(axis=1, keepdims=True), w * scale[:, None], b)


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from a bounded sample of ``docs`` (doc_id, text, lang)."""
    rows = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    n = rows.select("lang").distinct().count()
    found = hash_sample(rows, "lang", max(1, sample // max(1, n))).select("sample_key", "doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked = sorted(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        model = pickle.dumps(train([r[3] for r in picked], [r[2] for r in picked]))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    made = found.coalesce(1).mapInArrow(task(run), "model binary").first()
    return pickle.loads(bytes(made[0])) if made else train([], [])


def _decide(model: LanguageModel):
    def run(texts: pa.Array) -> list[pa.Array]:
        n = len(texts)
        offsets, words = words_of(texts)
        codes, distinct = coded(words)
        sums, counts = word_sums(distinct.to_pylist(), model.weights)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        grams = np.bincount(doc, counts[codes], minlength=n) if len(codes) else np.zeros(n)
        margins = np.stack(
            [np.bincount(doc, sums[codes, k], minlength=n) if len(codes) else np.zeros(n) for k in range(len(model.bias))],
            axis=1,
        ) / np.maximum(grams, 1)[:, None] + model.bias
        known = grams > 0
        if not model.languages:
            known[:] = False
        if known.any():
            loss = _losses(margins, model.codes, model.trust)
            share = np.exp(loss.min(axis=1, keepdims=True) - loss)
            best = loss.argmin(axis=1)
            score = np.where(known, 1 / share.sum(axis=1), 0.0)
            names = np.array([*model.languages, UNKNOWN], object)[np.where(known, best, len(model.languages))]
        else:
            score, names = np.zeros(n), np.full(n, UNKNOWN, object)
        return [pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score < AMBIGUOUS))]

    return run


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_ambiguous, read from ``text`` alone."""
    fields = [("lang_pred", "string"), ("lang_score", "double"), ("lang_ambiguous", "boolean")]
    return appended(docs, fields, _decide(model), SLICE)
