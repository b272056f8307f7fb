"""Removal of long passages that repeat anywhere in the corpus, by level-wise doubling.

A window of ``length`` words is repeated if the same word sequence also starts elsewhere. Levels go
from ``ceil(length / 4)`` words (about) over twice that to ``length``: a window enters a level only
if both its halves were repeated at the level before, and the work ends when no candidate survives.
Every level asks the whole corpus once: chunks send their distinct window hashes by key range, the
ranges merge them and answer one bit per hash (``common``). The first level, where all windows take
part, is only a filter and uses 48-bit hashes, as does the second; the last level decides with 64-bit
hashes. Passages found only by chance at one level fall at the next, so a window is removed in error
only if its halves and its own 64-bit hash all meet others by chance: less than once in 10^6 windows
when 10^13 survive.

**Edge cases.** Null and blank texts have no words and keep the empty text; documents shorter than
the window are kept whole; repeated rows are copies of each other and lose every word; windows never
cross documents; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import (
    answered, by_bucket, chunk_parts, chunk_table, coded, key_buckets, mix, pack_keys, pair_hash,
    starts_of, task, text_bytes, unpack_keys, with_replies, word_hashes, words_of,
)

WINDOW = 35
FILTER_BITS = 48
_REQUEST = "bucket int, chunk long, keys binary, twice binary"
_REPLY = "bucket int, chunk long, seen binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept string"


def level_lengths(length: int) -> list[int]:
    """Window lengths of the levels: each at most twice the one before, the last is ``length``."""
    levels = [length]
    while levels[0] > 9:
        levels.insert(0, -(-levels[0] // 2))
    return levels


class Windows:
    """Word hashes of one chunk and the hashes of its windows at each level."""

    def __init__(self, texts: pa.Array, levels: list[int]) -> None:
        self.offsets, self.words = words_of(texts)
        codes, distinct = coded(self.words)
        self.w = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
        self.levels = levels

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of all windows of the first level."""
        n, size = len(self.w), self.levels[0]
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.w[: n - size + 1].copy()
        for j in range(1, size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.w[j : n - size + 1 + j]
        at = np.flatnonzero(starts_of(self.offsets, size))
        return at, mix(h[at])

    def longer(self, level: int, at: np.ndarray, hashes: np.ndarray, seen: np.ndarray):
        """Windows of ``level`` whose two halves, given with their answers, are both repeated."""
        n, size, half = len(self.w), self.levels[level], self.levels[level - 1]
        full = np.zeros(n + size, bool)
        full[at[seen]] = True
        value = np.zeros(n + size, np.uint64)
        value[at[seen]] = hashes[seen]
        where = np.flatnonzero(full[:n] & full[size - half : n + size - half] & starts_of(self.offsets, size))
        return where, pair_hash(value[where], value[where + size - half])


def _asked(chunk: int, hashes: np.ndarray, buckets: int, bits: int) -> Iterator[dict]:
    """Request rows: sorted distinct hashes, and which of them occur twice in this chunk."""
    keys, counts = np.unique(hashes >> np.uint64(64 - bits), return_counts=True)
    for b, part in by_bucket(keys, buckets, bits):
        yield {"bucket": b, "chunk": chunk, "keys": pack_keys(keys[part]), "twice": np.packbits(counts[part] > 1).tobytes()}


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Which hashes of each chunk occur twice in it, or in another chunk too."""
    keys = [unpack_keys(k) for k in group["keys"]]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(k)).astype(bool) for t, k in zip(group["twice"], keys, strict=True)]
    whole = np.concatenate(keys)
    order = np.argsort(whole, kind="stable")
    ranked = whole[order]
    same = ranked[1:] == ranked[:-1]
    seen = np.zeros(len(whole), bool)
    seen[order[1:]] |= same
    seen[order[:-1]] |= same
    parts = np.split(seen, np.cumsum([len(k) for k in keys])[:-1])
    return pd.DataFrame(
        {
            "bucket": group["bucket"], "chunk": group["chunk"],
            "seen": [np.packbits(p | t).tobytes() for p, t in zip(parts, twice, strict=True)],
        }
    )


def _seen(hashes: np.ndarray, replies, buckets: int, bits: int) -> np.ndarray:
    """Per hash: is it repeated, by the replies to ``_asked``."""
    keys, back = np.unique(hashes >> np.uint64(64 - bits), return_inverse=True)
    flags = np.zeros(len(keys), bool)
    got = {r["bucket"]: r["seen"] for r in replies or []}
    for b, part in by_bucket(keys, buckets, bits):
        flags[part] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=part.stop - part.start).astype(bool)
    return flags[back]


def _kept(win: Windows, removed: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """(words, removed words, kept text) of every document of the chunk."""
    words = win.words.to_pylist()
    gone = np.concatenate([[0], np.cumsum(removed)])
    for lo, hi in zip(win.offsets[:-1].tolist(), win.offsets[1:].tolist(), strict=True):
        if n := int(gone[hi] - gone[lo]):
            stay = (w for w, g in zip(words[lo:hi], removed[lo:hi].tolist(), strict=True) if not g)
            yield hi - lo, n, " ".join(stay)
        else:
            yield hi - lo, 0, " ".join(words[lo:hi])


def deduplicated(docs: DataFrame, length: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the words that stay, joined by one space).

    ``docs`` has doc_id and text. With ``digest`` the column ``kept`` is the text's SHA-256.
    """
    spark = docs.sparkSession
    chars = text_bytes(docs)
    buckets, levels = key_buckets(chars), level_lengths(length)
    bits = [FILTER_BITS if level < length else 64 for level in levels]
    chunks = chunk_table(docs, F.lit(True), chunk_parts(spark, chars))
    request = pa.schema(
        [("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("twice", pa.binary())]
    )
    result = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]
    )

    def survivors(row: dict, texts: pa.Array, level: int) -> tuple[Windows, np.ndarray, np.ndarray]:
        """Windows of ``level`` whose halves are repeated at every level before."""
        win = Windows(texts, levels)
        at, hashes = win.first()
        for k in range(level):
            seen = _seen(hashes, row[f"replies{k}"], buckets, bits[k])
            at, hashes = win.longer(k + 1, at, hashes, seen)
        return win, at, hashes

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, pa.Array, pa.Array]]:
        small = [n for n in batch.schema.names if n not in ("texts", "ids", "marks")]
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in small}
            yield row, batch.column("texts")[i].values, batch.column("ids")[i].values

    def ask(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, texts, _ in rows_of(batch):
                    _, _, hashes = survivors(row, texts, level)
                    for one in _asked(row["chunk"], hashes, buckets, bits[level]):
                        yield pa.RecordBatch.from_pylist([one], schema=request)

        return run

    def finish(level: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, texts, ids in rows_of(batch):
                    win, at, hashes = survivors(row, texts, level or 0)
                    edge = np.zeros(len(win.w) + length + 1, np.int64)
                    if level is not None:
                        at = at[_seen(hashes, row[f"replies{level}"], buckets, bits[level])]
                        edge[at] += 1
                        edge[at + length] -= 1
                    removed = np.cumsum(edge)[: len(win.w)] > 0
                    found = list(_kept(win, removed))
                    texts_out = [k for _, _, k in found]
                    if digest:
                        texts_out = [hashlib.sha256(k.encode()).hexdigest() for k in texts_out]
                    columns = [
                        ids,
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array([g for _, g, _ in found], pa.int64()),
                        pa.array(texts_out, pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=result)

        return run

    state = chunks
    for level in range(len(levels)):
        replies = answered(state.mapInArrow(task(ask(level)), _REQUEST), _answer, _REPLY)
        if replies.isEmpty():
            return state.mapInArrow(task(finish(None)), _RESULT)
        state = with_replies(state, replies, ["seen"]).withColumnRenamed("replies", f"replies{level}")
    return state.mapInArrow(task(finish(len(levels) - 1)), _RESULT)
