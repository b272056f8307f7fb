"""Alignment against whole texts by both tokenizers and a plain comparison of all byte ranges."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import corpus, frame, prose
from tokenizers import Tokenizer

from flowlens.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(pieces):
    at, out = 0, []
    for i, piece in pieces:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def plain(rows):
    """{row number: result} from whole texts, links from all pairs of ranges near each other."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    table = {c: i for i, c in enumerate(map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))}
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
    made = {}
    for k, row in enumerate(rows):
        text = row[1]
        if not text:
            made[k] = None
            continue
        found = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(table[c] for c in t)) for i, t in zip(found.ids, found.tokens, strict=True)]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if b"".join(p for _, p in left) != whole or b"".join(p for _, p in right) != whole:
            made[k] = None
            continue
        left, right = spans(left), spans(right)
        links, lo = [], 0
        for i, s, e in left:
            while right[lo][2] <= s:
                lo += 1
            links += [(i, j) for j, s2, e2 in right[lo : lo + e - s + 1] if s2 < e and s < e2]
        cuts = sorted({e for _, _, e in left} & {e for _, _, e in right})
        groups = [([i for i, s, e in left if x <= s < y], [j for j, s, e in right if x <= s < y]) for x, y in zip([0, *cuts], cuts, strict=False)]
        made[k] = (len(left), len(right), groups, links)
    counts = collections.Counter(p for m in made.values() if m for p in set(m[3]))
    best = collections.defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for k, row in enumerate(rows):
        m = made[k]
        if m is None:
            out.append((row[0], 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in m[2])
        out.append((row[0], m[0], m[1], len(m[2]), len(m[3]), sum(counts[p] == best[p[0]] for p in m[3]),
                    sum(counts[p] for p in m[3]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


HARD = [
    "<|endoftext|> and <s> </s> <0x41> ", " lead", "  two  spaces  ", "tail ", " ", "\n", "a\tb \n c\r\n d", "x▁y and more", "▁", "a ▁ b",
    "don't 123 4567 ... 'tis", "日本語 テキスト と English", "😀😀 é é ﬁ  　 x", "\0 nul \x85 next", "word" * 3000, "a" * 5000, "it's  so",
]


def result(docs):
    return sorted((tuple(r) for r in align.aligned(docs, A, B).collect()), key=str)


def test_same_as_whole_texts(spark):
    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 20_000]
    rows += [(1000 + k, t, "x", "s", 0, 0.0, 1, "v") for k, t in enumerate(HARD)]
    rng = random.Random(5)
    odd = [" ", "  ", "\n", "\t", "a", "B", "é", "▁", "1", "23", "!", "'s", "😀", "<s>", "the ", " of"]
    rows += [(2000 + k, "".join(rng.choice(odd) for _ in range(rng.randint(1, 40))), "x", "s", 0, 0.0, 1, "v") for k in range(300)]
    assert result(frame(spark, rows).withColumnRenamed("value", "n_a").withColumnRenamed("count", "pairs")) == plain(rows)


def test_small_caches_and_chunks(spark, monkeypatch):
    rows = [(k, prose(random.Random(k % 17), 200), "x", "s", 0, 0.0, 1, "v") for k in range(60)]
    want = plain(rows)
    coder = align.Aligner(A, B)
    monkeypatch.setattr(align, "CACHE_PARTS", 50)
    import pyarrow as pa

    stats = [align._aligned(coder, pa.array([r[1] for r in rows[lo : lo + 7]])) for lo in range(0, 60, 7)]
    assert np.concatenate([s[0] for s in stats]).tolist() == [list(r[1:5]) for r in sorted(want)]
    assert [d for s in stats for d in s[1]] == [r[7] for r in sorted(want)]
    assert len(coder.known) <= 50 + 7 * 200


def test_lockstep_steps():
    links = align.lockstep(np.array([2, 5, 3]), np.array([0, 2, 2, 3]), np.array([1, 4, 5, 3]), np.array([0, 3, 3, 4]))
    assert list(zip(links.lane, links.a, links.b, links.cut, strict=True)) == [
        (0, 0, 0, False), (0, 0, 1, False), (0, 1, 1, False), (0, 1, 2, True), (2, 2, 3, True)
    ]


@pytest.mark.parametrize("rows", [[], [(1, None, "x", "s", 0, 0.0, 1, "v"), (2, "", "x", "s", 0, 0.0, 1, "v")]])
def test_nothing_to_align(spark, rows):
    assert result(frame(spark, rows)) == [(r[0], 0, 0, 0, 0, 0, 0, "") for r in rows]
