import random

import numpy as np
import pytest
from helpers import corpus, frame, prose, words

from flowlens.llm import neardup
from flowlens.llm.neardup import K, near_duplicates, overlap_floor, overlaps, union_sketch


def shingles(text, width):
    w = words(text, lower=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def plain(rows, width, num, den):
    """Components by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def family(size, edits, seed, start):
    """Near copies of one text: up to ``edits`` words changed in each."""
    rng = random.Random(seed)
    base = prose(rng, 140, "qrstuvwxyz").split(" ")
    out = []
    for k in range(size):
        copy = list(base)
        for at in rng.sample(range(len(copy)), k % (edits + 1)):
            copy[at] = prose(rng, 1, "abc") + str(k)
        out.append((start + k, " ".join(copy), "x", "s", 0, 0.0, 1, "v"))
    return out


@pytest.mark.parametrize(("width", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_same_as_all_pairs(spark, monkeypatch, width, num, den):
    monkeypatch.setattr(neardup, "BLOCK", 8)  # several blocks within one family
    rows = corpus() + family(60, 12, 4, 1000) + family(25, 4, 5, 2000)
    got = near_duplicates(frame(spark, rows), width, num, den).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain(rows, width, num, den)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_empty_and_alone(spark):
    assert near_duplicates(frame(spark, []), 3, 85, 100).count() == 0
    rows = [(7, None, "x", "s", 0, 0.0, 1, "v"), (8, "", "x", "s", 0, 0.0, 1, "v")]
    got = near_duplicates(frame(spark, rows), 3, 85, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(7, 0, 7, True), (8, 0, 8, True)]


def test_overlaps_and_union_sketch():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64) * np.uint64(2**55)) for n in (1, 20, 200, 250, 250)]
    got = overlaps(sets, sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets))
    for a in sets:
        for b in sets:
            both = np.union1d(a, b)[:K]
            want = len(set(both.tolist()) & set(a.tolist()) & set(b.tolist()))
            assert union_sketch([a], [b])[0] == want


def test_floor_is_safe():
    assert 30 <= overlap_floor(64, 85, 100) <= 40
    assert overlap_floor(64, 1, 1) == 64
