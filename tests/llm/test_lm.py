import collections
import math

import numpy as np
import pandas as pd
from helpers import corpus, crc, frame, words

from flowlens.llm.common import crc_mod
from flowlens.llm.lm import BUCKETS, STEPS, bucket_of, learn_weights, scored


def test_counts_base_and_score(spark):
    got = scored(frame(spark), crc_mod("doc_id", 7) != 2).collect()
    rows = corpus()
    tokens = [[*words(t, lower=True), "\n"] for _, t, *_ in rows]
    held = [crc(i, 7) == 2 for i, *_ in rows]
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    one = collections.Counter(w for t in train for w in t)
    two = collections.Counter(p for t in train for p in zip(["\n", *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    # The weights are learned anew here, from leave-one-out events, without cells.
    events = [
        (int(bucket_of(np.array(one[a] - 1))), (one[b] - 1) / (n - 1), (two[a, b] - 1) / (one[a] - 1) if one[a] > 1 else 0.0)
        for t in train for a, b in zip(["\n", *t], t, strict=False)
    ]
    bucket = np.array([e[0] for e in events])
    ratio = np.array([(1.0, e[1] * (v + 1), e[2] * (v + 1)) for e in events])
    weight = np.full((BUCKETS, 3), 1 / 3)
    weight[0] = (0.5, 0.5, 0.0)
    for _ in range(60):
        share = weight[bucket] * ratio
        share /= share.sum(axis=1, keepdims=True)
        new = np.stack([np.bincount(bucket, share[:, k], minlength=BUCKETS) for k in range(3)], axis=1)
        total = new.sum(axis=1, keepdims=True)
        weight = np.where(total > 0, (new + [1e-3, 0, 0]) / (total + 1e-3), weight)

    def score(t):
        out = 0.0
        for a, b in zip(["\n", *t], t, strict=False):
            w = weight[int(bucket_of(np.array(one[a])))]
            out += math.log10(w[0] / (v + 1) + w[1] * one[b] / n + (w[2] * two[a, b] / one[a] if one[a] else 0))
        return out

    want = collections.defaultdict(list)
    for (i, *_), t, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        want[i].append((h, len(t), sum(one[w] > 0 for w in t), n, base, score(t)))
    assert len(got) == len(rows)
    for r in got:
        exact = [w for w in want[r.doc_id] if w[:4] == (r.held_out, r.n_tokens, r.n_known, r.train_tokens)]
        assert any(math.isclose(w[4], r.base_score, rel_tol=1e-9) for w in exact)
        assert any(math.isclose(w[5], r.score, rel_tol=0.01, abs_tol=0.01) for w in exact)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_weights_sum_to_one():
    cells = pd.DataFrame({"cell": [STEPS * STEPS * 3 + 7], "n": [5], "one": [10.0], "two": [100.0]})
    assert np.allclose(learn_weights(cells).sum(axis=1), 1)
    assert np.allclose(learn_weights(cells.iloc[:0]).sum(axis=1), 1)


def test_nothing_to_learn_and_empty(spark):
    rows = scored(frame(spark), crc_mod("doc_id", 7) == 99).collect()
    assert len(rows) == len(corpus()) and all(r.train_tokens == 0 and r.n_known == 0 for r in rows)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert scored(frame(spark, []), crc_mod("doc_id", 7) != 2).count() == 0
