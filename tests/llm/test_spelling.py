"""Spelling groups against plain counting and the comparison of all words."""

import collections
import itertools
import random
import re
import zlib

import pytest
from helpers import corpus, frame

from flowlens.llm import spelling


def one_apart(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) - len(x) == 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def plain(counts, ratio=5):
    near = collections.defaultdict(set)
    for x, y in itertools.combinations(counts, 2):
        if abs(len(x) - len(y)) < 2 and one_apart(x, y):
            near[x].add(y)
            near[y].add(x)
    form = {}
    for w in near:
        best = min(near[w], key=lambda v: (-counts[v], v))
        if counts[best] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def counted(rows):
    counts = collections.Counter()
    for row in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), row[1] or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if row[0] is None else row[0]}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_whole_query(spark):
    rng = random.Random(3)
    vocabulary = ["Straße", "größer", "grösser", "kitchen", "kitchens", "chicken", "window", "ÀÉÎÕÜß", "x" * 300, "letters", "better"]
    texts = [" ".join(rng.choices(vocabulary, [40, 9, 2, 60, 5, 3, 30, 9, 4, 20, 1], k=60)) for _ in range(400)]
    rows = [(k, t, "x", "s", 0, 0.0, 1, "v") for k, t in enumerate(texts)] + corpus()
    docs = frame(spark, rows).withColumnRenamed("value", "n").withColumnRenamed("lang", "word").withColumnRenamed("source", "root")
    got = sorted(map(tuple, spelling.spelling_groups(docs).collect()))
    assert got == plain(counted(rows)) and any(r[1] for r in got)


@pytest.mark.parametrize("hot", [3, 20_000])
def test_all_pairs(spark, hot):
    rng = random.Random(hot)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(500)} | {"aaaaaa" + "a" * k for k in range(9)}
    counts = {w: int(5 ** (1 + 5 * rng.random())) for w in sorted(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert sorted(map(tuple, spelling.variants(frame, hot=hot).collect())) == plain(counts)


def test_long_chain(spark):
    counts = {"abcdef" + "ghijklmnop"[:k]: 5 ** (k + 1) for k in range(10)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(map(tuple, spelling.variants(frame).collect()))
    assert got == plain(counts) and got[0][2] == "abcdefghijklmno"


def test_empty(spark):
    assert spelling.spelling_groups(frame(spark, [])).count() == 0
    assert spelling.spelling_groups(frame(spark, [(1, None, "x", "s", 0, 0.0, 1, "v")])).count() == 0
