"""Shared pieces of the training-data operators: reading, word arrays, chunks and key exchange.

A *chunk* is a run of whole documents of bounded text size, one row of a stored table. Operators
that compare documents with the whole corpus send, per chunk and key bucket, one blob of sorted
64-bit keys; the bucket's task merges the blobs of all chunks and answers in the same order. So a
key that occurs a million times in a chunk travels once, a hot key is one entry per chunk, and no
task holds more than one bucket of keys or one chunk of text.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowlens.session import drop_path, shared_dir

# Characters of text that one chunk, or one slice of a batch, holds at most (a longer document
# makes a chunk of its own).
CHUNK_CHARS = 8 << 20
SLICE_CHARS = 2 << 20

WORD_SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_TABLES: list[str] = []


def stored_at(df: DataFrame, codec: str = "zstd", **options: str | int) -> tuple[DataFrame, str]:
    """Write once to the shared folder and read back: lineage ends, lost executors cost no rows."""
    path = shared_dir(df.sparkSession)
    df.write.options(compression=codec, **options).parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, codec: str = "zstd", **options: str | int) -> DataFrame:
    return stored_at(df, codec, **options)[0]


def tables_so_far() -> int:
    return len(_TABLES)


def drop_tables(spark: SparkSession, since: int, keep: Sequence[str] = ()) -> None:
    """Remove the tables stored after ``since``, which nothing reads any more, but for ``keep``."""
    for path in [p for p in _TABLES[since:] if p not in keep]:
        drop_path(spark, path)
        _TABLES.remove(path)


def crc_mod(key: str | Column, divisor: int) -> Column:
    """``crc32(key as text) mod divisor``; null keys count as the empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def ranges(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows of the given lengths into runs of at most ``limit`` (one row at least)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of bounded text size."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for lo, hi in ranges(lengths, limit):
        yield lo, texts.slice(lo, hi - lo)


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: (offset of each text's first word, words).

    Null and blank texts have no words. ``lower`` maps A-Z only.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.sum(full).as_py() != len(flat) and len(flat):
        mask = full.to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(mask)])
        offsets, flat = before[offsets], flat.filter(full)
    return offsets, flat


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of every word, distinct words)."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes that depend on the words alone."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pair."""
    return mix(mix(a + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3) + b)


def starts_of(offsets: np.ndarray, length: int) -> np.ndarray:
    """Mask over all words: does a window of ``length`` words of one document start here?"""
    n = int(offsets[-1])
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(n) + length <= ends


def gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions first[i], first[i] + 1, ... of all runs, one run after the other."""
    after = np.cumsum(size)
    return np.repeat(first - (after - size), size) + np.arange(int(after[-1]) if len(after) else 0)


class Ragged:
    """Growing list of integer arrays."""

    def __init__(self, dtype: type = np.int64) -> None:
        self.flat, self.first = np.zeros(0, dtype), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the arrays ``rows``, one after the other; their sizes)."""
        size = self.first[rows + 1] - self.first[rows]
        return self.flat[gather(self.first[rows], size)], size

    def keep(self, rows: np.ndarray) -> None:
        self.flat, size = self.take(rows)
        self.first = np.concatenate([[0], np.cumsum(size)])


# --- worker memory -----------------------------------------------------------------------------

_KEPT: dict[tuple[str, str], object] = {}


def kept(owner: str, key: str, make: Callable[[], object]) -> object:
    """Something costly that a Python worker keeps between tasks of one operator."""
    if (owner, key) not in _KEPT:
        _KEPT[owner, key] = make()
    return _KEPT[owner, key]


def hand_back() -> None:
    """Give freed memory back to the system, for workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def task(fn: Callable, owner: str = "") -> Callable:
    """``fn`` over batches, without what other operators kept, and leaving no free memory behind.

    What an operator keeps may have ``rest()``: it is called after each task, so that workers that wait idle beside
    the next stage hold no cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key in [k for k in _KEPT if k[0] != owner]:
            del _KEPT[key]
        try:
            yield from fn(batches)
        finally:
            for kept_object in _KEPT.values():
                if hasattr(kept_object, "rest"):
                    kept_object.rest()
            hand_back()

    return run


# --- blobs -------------------------------------------------------------------------------------


def planes(values: np.ndarray) -> bytes:
    """Bytes of the values, most alike bytes side by side, so that codecs shrink small values."""
    width = values.dtype.itemsize
    return values.view(np.uint8).reshape(-1, width).T.tobytes()


def unplanes(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts, deflated: most are small."""
    return zlib.compress(planes(counts.astype(np.uint64)), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    return unplanes(zlib.decompress(data), np.uint64).astype(np.int64)


def by_bucket(keys: np.ndarray, buckets: int, bits: int = 64) -> Iterator[tuple[int, slice]]:
    """Runs of the sorted keys that fall in each bucket (equal parts of the key range)."""
    edges = np.array([(i << bits) // buckets for i in range(1, buckets)], dtype=np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    for i in range(buckets):
        if cuts[i + 1] > cuts[i]:
            yield i, slice(int(cuts[i]), int(cuts[i + 1]))


def totals(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge (sorted keys, counts) of several chunks: distinct keys and their summed counts."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    counts = np.concatenate([c for _, c in parts])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


# --- chunks ------------------------------------------------------------------------------------

CHUNK_SCHEMA = "chunk long, ids array<bigint>, marks array<boolean>, texts array<string>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = made = 0

    def row() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        lists = [
            pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column(c).combine_chunks())
            for c in ("id", "mark", "text")
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([part + made], pa.int64()), *lists], names=["chunk", "ids", "marks", "texts"]
        )

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        for lo, hi in ranges(lengths, CHUNK_CHARS):
            n = int(lengths[lo:hi].sum())
            if held and size + n > CHUNK_CHARS:
                yield row()
                held, size, made = [], 0, made + 1
            held.append(batch.slice(lo, hi - lo))
            size += n
    if held:
        yield row()


def chunk_table(docs: DataFrame, mark: Column, parts: int) -> DataFrame:
    """Store documents in chunks, bucketed by chunk id, so that joins on it move no text.

    ``docs`` has ``doc_id`` and ``text``; ``mark`` is a flag kept beside each document. Repeated
    document ids stay rows of their own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), mark.alias("mark"), F.col("text"))
    path = shared_dir(spark)
    name = "chunks_" + path.rsplit("-", 1)[-1]
    (
        rows.mapInArrow(task(_chunks), CHUNK_SCHEMA)
        .write.option("compression", "zstd")
        .option("path", path)
        .bucketBy(parts, "chunk")
        .saveAsTable(name)
    )
    return spark.table(name)


def text_bytes(docs: DataFrame) -> int:
    """Characters of all texts (one aggregate over the text column)."""
    return int(docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0])


def key_buckets(chars: int, per_bucket: int = 6 << 20) -> int:
    """Buckets so that each holds about a million keys, whatever the size of the corpus."""
    return max(4, -(-chars // per_bucket))


def chunk_parts(spark: SparkSession, chars: int) -> int:
    """Tasks over the chunk table: a few chunks each.

    Not below the number of shuffle partitions: with fewer buckets Spark would rather shuffle both
    sides of a join than keep the table where it is.
    """
    least = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return int(max(least, min(chars // (3 * CHUNK_CHARS), 20_000)))


def answered(
    requests: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Answer the requests of all chunks, one bucket per group; stored in the shared folder.

    ``requests`` has ``bucket`` and ``chunk``. A bucket is a bounded range of hashed keys, so the
    group is bounded however often a key occurs.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = answer(group)
        hand_back()
        return out

    return stored(requests.groupBy("bucket").applyInPandas(run, schema))


def with_replies(chunks: DataFrame, replies: DataFrame, fields: list[str]) -> DataFrame:
    """Chunks joined with their replies (a list ordered by bucket); the chunk side is not moved."""
    lists = replies.groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("bucket", *fields))).alias("replies")
    )
    return chunks.join(lists, "chunk", "left")


# --- scalar models -----------------------------------------------------------------------------


def appended(
    docs: DataFrame, fields: list[tuple[str, str]], fn: Callable[[pa.Array], list[pa.Array]], limit: int = SLICE_CHARS
) -> DataFrame:
    """``docs`` with new columns made from whole texts; columns of the same names are replaced.

    ``fn`` gets slices of bounded text size. All other columns pass through untouched.
    """
    names = [n for n, _ in fields]
    base = docs.drop(*names)
    new = ", ".join(f"{n} {t}" for n, t in fields)
    schema = StructType([*base.schema.fields, *StructType.fromDDL(new).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            for lo, texts in slices(batch.column(at)):
                old = [c.slice(lo, len(texts)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*old, *fn(texts)], names=[*batch.schema.names, *names])

    return base.mapInArrow(task(run), schema)


def hash_sample(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each label, at most a quarter more, chosen by a hash of doc_id.

    The classes are counted first, so the bound holds at every size of ``rows``.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] is not None}
    if not counts:
        return rows.withColumn("sample_key", F.lit(0)).limit(0)
    key = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, per_class / n) * (1 << 30)))])
    kept = rows.withColumn("sample_key", key).filter(F.col("sample_key") < share[F.col(label)])
    return kept.limit(per_class * len(counts) * 5 // 4)


def letters_grams(words: list[str], sizes: tuple[int, ...], slots: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n-gram size: (word number, hashed n-gram) of all n-grams of letters with word bounds.

    Words are lower-cased; characters other than letters count as bounds.
    """
    codes = np.frombuffer((" " + " ".join(words).lower() + " ").encode("utf-32-le"), np.uint32)
    distinct, back = np.unique(codes, return_inverse=True)
    alpha = np.array([chr(c).isalpha() for c in distinct.tolist()])
    text = np.where(alpha, distinct, 32)[back].astype(np.uint64)
    letter = alpha[back]
    # Lower-casing may change a word's length, so words are told apart by the blanks between them.
    word = np.cumsum(codes == 32) - 1
    for size in sizes:
        n = len(text) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, np.uint64)
        some = np.zeros(n, bool)
        for j in range(size):
            h = h * np.uint64(0x100000001B3) + text[j : n + j]
            some |= letter[j : n + j]
        # An n-gram stays within one word and its bounds.
        inside = letter[1 : n + 1] if size > 2 else np.ones(n, bool)
        for j in range(1, size - 1):
            inside &= letter[j : n + j]
        keep = np.flatnonzero(some & inside)
        at = word[keep + (1 if size > 1 else 0)] if size > 2 else word[np.where(letter[keep], keep, keep + size - 1)]
        yield at, (mix(h[keep]) % np.uint64(slots)).astype(np.int64)


def aside(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``needed`` renamed, so that none clashes with those that operators
    add, and the columns that bring the old names back."""
    names = [c if c in needed else f"column_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(new).alias(old) for new, old in zip(names, docs.columns, strict=True)]
