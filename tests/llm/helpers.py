"""Small corpora and plain counterparts of the operators."""

from __future__ import annotations

import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, count long, value string"


def words(text: str | None, lower: bool = False) -> list[str]:
    if lower and text:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(doc_id, divisor: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % divisor


def prose(rng: random.Random, n: int, stems: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, blanks, a very long text, ties and repeated rows."""
    rng = random.Random(seed)
    passage, base = prose(rng, 60, "klmnop"), prose(rng, 150, "qrstuv").split(" ")
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + "\n\t" + passage, passage + " " + texts[6]]
    for k in range(12):  # near copies of one text, some far apart from each other
        copy = list(base)
        for _ in range(k % 7):
            copy[rng.randrange(len(copy))] = prose(rng, 1)
        texts.append(" ".join(copy))
    texts += [None, "", " \t\n", "a", "a", "a b", "A B", "Straße été  \x1c x\x85y", prose(rng, 30_000), "12 .. !"]
    rows = [(i, t, "xy"[i % 2], None if i % 9 == 0 else f"s{i % 4}", 0, 0.5, 1, "v") for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, texts[7], None, "s1", None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
