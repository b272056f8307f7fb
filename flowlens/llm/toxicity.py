"""Toxicity of a text by a bidirectional gated recurrent network with attention pooling, in numpy.

Every word enters as a word vector (hashed table) beside the mean of the vectors of its letter n-grams
(hashed table), so inflected and unseen forms are read by their characters. Two gated recurrent layers
read a window of ``WINDOW`` words in both directions, attention pools their states, and a logistic unit
gives the window's logit. Windows overlap by half and cover the whole text, the last one ends with it.
A text's score is the calibrated largest logit of its windows; ``window`` is where it starts, in words.

Input projections are computed once per distinct word of a slice; the recurrent steps run over blocks of
windows at a time, so memory is bounded whatever the length of a text.

Training (driver, numpy, Adam) uses at most ``SAMPLE`` labelled documents per class (and a quarter
more) and at most ``PER_DOC`` windows of each: the documented bounds. Windows of a toxic document are
chosen by the log-odds of their words' features, later by the network, for only some of its windows are
toxic; clean documents give their most suspect windows and others. Every fourth document of the sample
calibrates only, weighed by the share of toxic documents among all labelled ones.

**Edge cases.** Null and blank texts have no window and score 0. Conflicting labels of one document
count as toxic; documents without a label are not learned from. Without both classes in the sample the
score is 0 everywhere. Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import appended, coded, hash_sample, letters_grams, word_hashes, words_of

SAMPLE = 900
PER_DOC = 6
WINDOW, STRIDE = 24, 12
WORD_SLOTS, GRAM_SLOTS, DIM, HIDDEN = 1 << 12, 1 << 14, 8, 8
GRAMS = (3, 4, 5)
THRESHOLD = 0.7


def windows_of(offsets: np.ndarray, size: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of windows that cover every word; a last one ends with the text."""
    lengths = np.diff(offsets)
    many = np.where(lengths > size, -(-(lengths - size) // stride) + 1, (lengths > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(lengths)), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = np.minimum(k * stride, np.maximum(lengths - size, 0)[doc])
    return doc, offsets[:-1][doc] + start


def window_codes(codes: np.ndarray, ends: np.ndarray, first: np.ndarray, pad: int) -> np.ndarray:
    """(windows, WINDOW) word codes; places after the text hold ``pad``."""
    at = first[:, None] + np.arange(WINDOW)
    return np.where(at < ends[:, None], np.append(codes, pad)[np.minimum(at, len(codes))], pad)


class Words:
    """Features of distinct words: a hashed word and hashed letter n-grams."""

    def __init__(self, distinct: pa.Array) -> None:
        words = distinct.to_pylist()
        self.n = len(words)
        lower = pa.array([w.lower() for w in words], pa.string())
        self.word = (word_hashes(lower) % np.uint64(WORD_SLOTS)).astype(np.int64)
        parts = list(letters_grams(words, GRAMS, GRAM_SLOTS)) or [(np.zeros(0, np.int64),) * 2]
        self.owner = np.concatenate([w for w, _ in parts])
        self.gram = np.concatenate([s for _, s in parts])
        order = np.argsort(self.owner, kind="stable")
        self.owner, self.gram = self.owner[order], self.gram[order]
        self.share = 1 / np.maximum(np.bincount(self.owner, minlength=self.n), 1)

    def mean(self, table: np.ndarray) -> np.ndarray:
        """Mean of the n-grams' rows per word."""
        out = np.zeros((self.n, table.shape[1]), np.float32)
        step = 1 << 18
        for lo in range(0, len(self.owner), step):
            owner, rows = self.owner[lo : lo + step], table[self.gram[lo : lo + step]]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[first]] += np.add.reduceat(rows, first, axis=0)
        return out * self.share[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, 2 * DIM

        def init(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "word": init(WORD_SLOTS, DIM, scale=0.1), "gram": init(GRAM_SLOTS, DIM, scale=0.3),
            "attend": init(2 * h, h, scale=0.3), "query": init(h, scale=0.3),
            "out": init(2 * h, scale=0.3), "bias": np.zeros(1, np.float32),
        }
        for side in "fb":
            self.p["x" + side] = init(d, 3 * h, scale=1 / np.sqrt(d))
            self.p["h" + side] = init(h, 3 * h, scale=1 / np.sqrt(h))
            self.p["c" + side] = np.zeros(3 * h, np.float32)

    def inputs(self, words: Words) -> np.ndarray:
        return np.concatenate([self.p["word"][words.word], words.mean(self.p["gram"])], axis=1)

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Input part of both layers' gates, with a last row for padding."""
        zero = np.zeros((1, x.shape[1]), np.float32)
        x = np.concatenate([x, zero])
        return {side: x @ self.p["x" + side] + self.p["c" + side] for side in "fb"}

    def _layer(self, side: str, z: np.ndarray, real: np.ndarray, keep: list | None) -> np.ndarray:
        """States (WINDOW, windows, HIDDEN); padding leaves the state as it is."""
        h, u = HIDDEN, self.p["h" + side]
        state = np.zeros((z.shape[1], h), np.float32)
        out = np.zeros((WINDOW, z.shape[1], h), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            gates = _sigmoid(z[t, :, : 2 * h] + state @ u[:, : 2 * h])
            r, s = gates[:, :h], gates[:, h:]
            new = np.tanh(z[t, :, 2 * h :] + (r * state) @ u[:, 2 * h :])
            live = s * real[t][:, None]
            if keep is not None:
                keep.append((t, state, r, s, new))
            state = state + live * (new - state)
            out[t] = state
        return out

    def forward(self, codes: np.ndarray, z: dict[str, np.ndarray], keep: dict | None = None) -> np.ndarray:
        """Logits of windows given as word codes (the code after the last word is padding)."""
        codes = codes.T
        real = (codes < len(z["f"]) - 1).astype(np.float32)
        tapes: dict[str, list | None] = {s: [] if keep is not None else None for s in "fb"}
        states = np.concatenate([self._layer(s, z[s][codes], real, tapes[s]) for s in "fb"], axis=2)
        hidden = np.tanh(states @ self.p["attend"])
        marks = np.where(real > 0, hidden @ self.p["query"], np.float32(-1e9))
        weight = np.exp(marks - marks.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep.update(codes=codes, real=real, tapes=tapes, states=states, hidden=hidden, weight=weight, pooled=pooled)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, k: dict, pull: np.ndarray, x: np.ndarray, words: Words) -> dict[str, np.ndarray]:
        """Of the loss whose derivative by the logits is ``pull``."""
        p, h = self.p, HIDDEN
        g = {"bias": np.array([pull.sum()], np.float32), "out": k["pooled"].T @ pull}
        d_pooled = pull[:, None] * p["out"]
        d_states = k["weight"][:, :, None] * d_pooled[None]
        d_weight = (k["states"] * d_pooled[None]).sum(axis=2)
        d_marks = k["weight"] * (d_weight - (k["weight"] * d_weight).sum(axis=0))
        g["query"] = np.tensordot(k["hidden"], d_marks, axes=((0, 1), (0, 1)))
        d_hidden = d_marks[:, :, None] * p["query"] * (1 - k["hidden"] ** 2)
        g["attend"] = np.tensordot(k["states"], d_hidden, axes=((0, 1), (0, 1)))
        d_states = d_states + d_hidden @ p["attend"].T
        d_x = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        padded = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        for i, side in enumerate("fb"):
            u, gu = p["h" + side], np.zeros_like(p["h" + side])
            d_z = np.zeros((*k["codes"].shape, 3 * h), np.float32)
            carry = np.zeros((k["codes"].shape[1], h), np.float32)
            for t, state, r, s, new in reversed(k["tapes"][side]):
                carry = carry + d_states[t, :, i * h : (i + 1) * h]
                live = k["real"][t][:, None]
                d_new = carry * s * live * (1 - new**2)
                d_s = carry * (new - state) * live * s * (1 - s)
                d_rs = d_new @ u[:, 2 * h :].T
                d_r = d_rs * state * r * (1 - r)
                d_gates = np.concatenate([d_r, d_s], axis=1)
                d_z[t] = np.concatenate([d_gates, d_new], axis=1)
                gu[:, : 2 * h] += state.T @ d_gates
                gu[:, 2 * h :] += (r * state).T @ d_new
                carry = carry * (1 - s * live) + d_rs * r + d_gates @ u[:, : 2 * h].T
            g["h" + side] = gu
            flat, flat_z = k["codes"].ravel(), d_z.reshape(-1, 3 * h)
            by_word = np.stack([np.bincount(flat, flat_z[:, c], minlength=len(padded)) for c in range(3 * h)], axis=1)
            by_word = by_word.astype(np.float32)
            g["x" + side] = padded.T @ by_word
            g["c" + side] = by_word.sum(axis=0)
            d_x += by_word @ p["x" + side].T
        d_x = d_x[:-1]
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], words.word, d_x[:, :DIM])
        np.add.at(g["gram"], words.gram, (d_x[:, DIM:] * words.share[:, None])[words.owner])
        return g


def _log_odds(words: Words, codes: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Per word: largest log-odds of its features between toxic and clean documents."""
    n = max(words.n, 1)
    pair = np.unique(doc * n + codes)
    docs, word = np.divmod(pair, n)
    size = np.bincount(words.owner, minlength=words.n)
    first = np.cumsum(size) - size
    reps = size[word]
    at = np.repeat(first[word] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    seen = np.unique(np.repeat(docs, reps) * GRAM_SLOTS + words.gram[at])
    d, gram = np.divmod(seen, GRAM_SLOTS)
    bad = np.bincount(gram, toxic[d], minlength=GRAM_SLOTS)
    good = np.bincount(gram, ~toxic[d], minlength=GRAM_SLOTS)
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((~toxic).sum() + 1))
    odds[bad + good < 3] = 0
    out = np.zeros(words.n)
    np.maximum.at(out, words.owner, odds[words.gram])
    return out


def _hard(logits: np.ndarray, doc: np.ndarray, rng: np.random.Generator) -> tuple:
    """Windows to learn from: the most suspect ones of each document, and of clean ones some others."""
    order = np.lexsort((-logits, doc))
    rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
    other = rng.random(len(order)) < PER_DOC / 2 / np.maximum(np.bincount(doc)[doc[order]], 1)
    return order, (rank < PER_DOC // 2), other


def train(texts: list[str], toxic: list[int], share: float, rounds: int = 8, seed: int = 3):
    """(network, calibration slope, offset), or None without both classes.

    ``share`` is that of toxic documents among all labelled ones. Every fourth text calibrates only.
    """
    toxic = np.array(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    rng = np.random.default_rng(seed)
    learn = np.arange(len(texts)) % 4 < 3
    offsets, flat = words_of(pa.array([t for t, own in zip(texts, learn, strict=True) if own], pa.string()))
    codes, distinct = coded(flat)
    words, bad = Words(distinct), toxic[learn]
    doc, first = windows_of(offsets)
    grid = window_codes(codes, offsets[1:][doc], first, words.n)
    odds = _log_odds(words, codes, np.repeat(np.arange(len(bad)), np.diff(offsets)), bad)
    suspect = np.append(odds, -99)[grid].max(axis=1) + rng.random(len(grid)) * 1e-3
    net = Network()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, pool = 0, np.zeros(0, np.int64)
    for turn in range(rounds):
        if turn and turn % 2 == 0:  # from here on the network itself says which windows are suspect
            z = net.projected(net.inputs(words))
            suspect = np.concatenate([net.forward(part, z) for part in np.array_split(grid, len(grid) // 4096 + 1)])
        if turn % 2 == 0:
            order, top, other = _hard(suspect, doc, rng)
            own = bad[doc[order]]
            # Clean windows that were hard once stay in.
            pool = np.union1d(pool[~bad[doc[pool]]], order[np.where(own, top, top | other)])
        y = bad[doc[pool]].astype(np.float32)
        for batch in np.array_split(rng.permutation(len(pool)), max(1, len(pool) // max(16, min(256, len(pool) // 40)))):
            step += 1
            own, back = np.unique(grid[pool[batch]], return_inverse=True)
            own = own[own < words.n]
            part = Words(distinct.take(pa.array(own)))
            x, keep = net.inputs(part), {}
            logits = net.forward(back.reshape(-1, WINDOW), net.projected(x), keep)
            pull = (_sigmoid(logits) - y[batch]) / len(batch)
            for name, g in net.gradients(keep, pull.astype(np.float32), x, part).items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                rate = 0.01 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                net.p[name] -= (rate * m / (np.sqrt(v) + 1e-6)).astype(np.float32)
    best, _ = largest(net, pa.array(texts, pa.string()))
    held = np.isfinite(best) & (~learn if len(set(toxic[~learn])) == 2 else True)
    x, y = best[held], toxic[held].astype(float)
    weight = np.where(y > 0, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    return net, *_calibrated(x, y, weight)


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's steps with a small penalty on the slope."""
    if not len(x):
        return 1.0, 0.0
    center, spread = x.mean(), x.std() + 1e-6
    a = np.stack([(x - center) / spread, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(a @ w)
        gradient = a.T @ ((p - y) * weight) + 1e-3 * w * [1, 0]
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-6])
        w -= np.clip(np.linalg.solve(curve, gradient), -2, 2)
    slope = max(float(w[0] / spread), 1e-3)
    return slope, float(w[1] - slope * center)


def largest(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Largest logit over all windows of each text (-inf without words), and where it is."""
    offsets, flat = words_of(texts)
    best, where = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
    if not len(flat):
        return best, where
    codes, distinct = coded(flat)
    words = Words(distinct)
    z = net.projected(net.inputs(words))
    doc, first = windows_of(offsets)
    ends = offsets[1:][doc]
    for lo in range(0, len(doc), 4096):
        part = slice(lo, lo + 4096)
        logits = net.forward(window_codes(codes, ends[part], first[part], words.n), z)
        d = doc[part]
        order = np.lexsort((-logits, d))
        head = order[np.concatenate([[True], d[order][1:] != d[order][:-1]])]
        better = logits[head] > best[d[head]]
        best[d[head][better]] = logits[head][better]
        where[d[head][better]] = (first[part] - offsets[:-1][d])[head][better]
    return best, where


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = SAMPLE):
    """Train on a bounded sample of the labelled rows for which ``learn`` holds."""
    marked = (
        labels.filter(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    share = marked.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    chosen = hash_sample(marked, "toxic", per_class).select("sample_key", "doc_id", "toxic")
    # At most 2.5 times ``per_class`` ids.
    rows = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    picked = sorted(map(tuple, rows.select("sample_key", "doc_id", "toxic", "text").collect()))
    return train([r[3] for r in picked], [r[2] for r in picked], float(share or 0.5))


def toxicity(docs: DataFrame, model) -> DataFrame:
    """``docs`` with toxic_score (0 to 1), toxic_window (first word of the worst window), predicted."""

    def run(texts: pa.Array) -> list[pa.Array]:
        if model is None:
            score, where = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        else:
            net, slope, offset = model
            best, where = largest(net, texts)
            score = np.where(np.isfinite(best), _sigmoid(slope * np.where(np.isfinite(best), best, 0) + offset), 0.0)
        return [pa.array(score), pa.array(where), pa.array((score >= THRESHOLD).astype(np.int32))]

    fields = [("toxic_score", "double"), ("toxic_window", "long"), ("predicted", "int")]
    return appended(docs, fields, run)
