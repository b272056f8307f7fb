import collections
import hashlib

import pytest
from helpers import corpus, frame, words

from flowlens.llm.substrings import deduplicated, level_lengths


def plain(rows, length):
    texts = [(i, words(t)) for i, t, *_ in rows]
    seen = collections.Counter(tuple(w[k : k + length]) for _, w in texts for k in range(len(w) - length + 1))
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        yield i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)


@pytest.mark.parametrize("length", [35, 5])
def test_same_as_counting(spark, length):
    rows = corpus()
    got = deduplicated(frame(spark), length).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows, length)))


def test_digest_and_empty(spark):
    rows = [(1, "x y", "l", "s", 0, 0.0, 1, "v"), (2, None, "l", "s", 0, 0.0, 1, "v")]
    got = {r.doc_id: r.kept for r in deduplicated(frame(spark, rows), digest=True).collect()}
    assert got == {1: hashlib.sha256(b"x y").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
    assert deduplicated(frame(spark, [])).count() == 0


def test_levels():
    assert level_lengths(35) == [9, 18, 35]
    assert all(b <= 2 * a for a, b in zip([9, 18], [18, 35], strict=True))
