"""Token ids of whole texts in fixed-width packed blocks.

**Format.** A stored table with one row per block. Every id takes ``bits`` bits, the least that
hold the vocabulary, least significant bit first. A block holds whole documents: about
``BLOCK_IDS`` ids, or one longer document. ``docs`` lists them in order with the offset of
their first id in the block, so document ``d`` starts at bit ``offset * bits`` and any id can be
read without its neighbours (``unpack(payload, bits, first, count)``). ``shard`` and ``block`` order
the blocks by document id.

**Edge cases.** A null text is the empty text and has the end id only; an empty table gives no
blocks; repeated rows are packed each; rows of one id are ordered by a hash of their text.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Ragged, kept, ranges, slices, stored, task

BLOCK_IDS = 1 << 16
END_ID = 2
# Distinct pieces whose ids a Python worker remembers; beyond it only those met again stay.
CACHE_PIECES = 150_000
# Bytes of unseen pieces that go to the tokenizer as one string.
STRING_BYTES = 4096
# Bytes of text that are encoded at once: a dozen arrays of that length are held beside them.
ENCODE_BYTES = 512 << 10

BLOCK_SCHEMA = (
    "shard int, block int, bits int, n_ids long,"
    " docs array<struct<doc_id:bigint,offset:bigint,n:bigint>>, payload binary"
)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive fields of ``bits`` bits."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flags, bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from id number ``first`` on, reading only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    low = first * bits // 8
    raw = np.frombuffer(payload, np.uint8)[low : ((first + count) * bits + 7) // 8]
    flags = np.unpackbits(raw, bitorder="little")[first * bits - 8 * low :][: count * bits]
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flags.reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


# --- encoding ----------------------------------------------------------------------------------
#
# The byte-level pattern never joins text across "printable character, then space or newline" nor
# between an ASCII letter and the ASCII mark after it (apostrophes aside). Texts are cut there, and
# each distinct piece of a slice is given to the tokenizer once.

_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = _PRINTABLE & ~_LETTER
_MARK[[*range(0x30, 0x3A), 0x27]] = False
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True


def cuts_of(raw: np.ndarray) -> np.ndarray:
    """Positions at which the text may be cut without changing its ids."""
    if len(raw) < 2:
        return np.zeros(0, np.int64)
    before, here = raw[:-1], raw[1:]
    safe = _PRINTABLE[before]
    # After a character of several bytes only where it can't be one of the Unicode spaces, all of
    # which are led by C2, E1, E2 or E3.
    tail = before >= 0x80
    one, two = np.zeros(len(before), np.uint8), np.zeros(len(before), np.uint8)
    one[1:], two[2:] = raw[: len(before) - 1], raw[: max(0, len(before) - 2)]
    safe |= tail & (one != 0xC2) & ~((two >= 0xE1) & (two <= 0xE3))
    return np.flatnonzero(safe & _GAP[here] | _LETTER[before] & _MARK[here]) + 1


class Encoder:
    """Ids of whole texts by the given tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # In the byte-level alphabet a character stands for a byte.
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # piece -> its number
        self.ids = Ragged(np.uint32)  # ids of each piece
        self.seen = np.zeros(0, bool)  # asked for in more than one slice

    def rest(self) -> None:
        """Between tasks only the tokenizer stays: unseen pieces are cheap, idle workers with caches are not."""
        self._forget()

    def _shrink(self) -> None:
        """Keep the pieces that several slices had; forget the others."""
        rows = np.flatnonzero(self.seen)
        if len(rows) > CACHE_PIECES // 2:
            self._forget()
            return
        place = np.full(len(self.seen), -1)
        place[rows] = np.arange(len(rows))
        self.known = {p: k for p, n in self.known.items() if (k := int(place[n])) >= 0}
        self.ids.keep(rows)
        self.seen = np.zeros(len(rows), bool)

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number per piece): unseen pieces, joined to longer strings where they may follow each other."""
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        free = np.zeros(len(raw) + 1, bool)
        free[cuts_of(raw)] = True
        stop = ~free[ends] | (np.diff(ends // STRING_BYTES, append=-1) != 0)
        stop[-1] = True
        last = np.flatnonzero(stop)
        strings = np.split(raw, ends[last[:-1]])
        found = self.tokenizer.encode_batch_fast([bytes(x).decode() for x in strings], add_special_tokens=False)
        ids = [e.ids for e in found]
        flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
        upto = np.cumsum(self.width[flat])
        place = np.searchsorted(upto, ends)
        if len(upto) and upto[-1] == len(raw) and np.array_equal(upto[place], ends):
            return flat, np.diff(place + 1, prepend=0)
        # A tokenizer that changes bytes: each piece by itself.
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids))), np.fromiter(map(len, ids), np.int64, len(ids))

    def _pieces(self, pieces: list[bytes]) -> np.ndarray:
        """Number of each (distinct) piece; pieces not known yet are encoded."""
        if len(self.known) > CACHE_PIECES:
            self._shrink()
        known = self.known
        numbers = np.fromiter((known.get(p, -1) for p in pieces), np.int64, len(pieces))
        unseen = np.flatnonzero(numbers < 0)
        self.seen[numbers[numbers >= 0]] = True
        if len(unseen):
            # Pieces that start with a space follow each other; they come first.
            new = sorted((pieces[i] for i in unseen.tolist()), key=lambda p: p[0])
            base = len(known)
            self.ids.add(*self._encoded(new))
            known.update(zip(new, range(base, base + len(new))))
            self.seen = np.concatenate([self.seen, np.zeros(len(new), bool)])
            numbers[unseen] = [known[pieces[i]] for i in unseen.tolist()]
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text), without the end id."""
        n = len(texts)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        special = np.zeros(n, bool)
        for content in self.specials:
            special |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if special.any():  # whole, for special tokens may be found across the cuts
            counts = [self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids for t in texts]
            flat = [np.array(c, np.uint32) for c in counts]
            return np.concatenate([*flat, np.zeros(0, np.uint32)]), np.array([len(c) for c in flat], np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets - offsets[0]
        bounds = np.zeros(len(raw) + 1, bool)
        bounds[cuts_of(raw)] = True
        bounds[ends] = True
        marks = np.flatnonzero(bounds)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(marks) - 1, [None, pa.py_buffer(marks), pa.py_buffer(raw)]
        ).dictionary_encode()
        codes = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        number = self._pieces(pieces.dictionary.to_pylist())[codes]
        flat, each = self.ids.take(number)
        after = np.cumsum(each)
        seen = np.concatenate([[0], after])[np.searchsorted(marks, ends)]
        return flat, np.diff(seen)


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return kept("tokens", path, lambda: Encoder(path))


def _writer(path: str, end_id: int, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(path), TaskContext.get().partitionId()
        bits = bits_for(max(coder.tokenizer.get_vocab_size(), end_id + 1))
        made = 0
        schema = pa.schema(
            [
                ("shard", pa.int32()), ("block", pa.int32()), ("bits", pa.int32()), ("n_ids", pa.int64()),
                ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("n", pa.int64())]))),
                ("payload", pa.binary()),
            ]
        )

        doc = [schema.field("docs").type.value_type.field(i) for i in range(3)]

        def block(ids: pa.Array, sizes: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
            columns = [ids, pa.array(np.cumsum(sizes) - sizes, pa.int64()), pa.array(sizes, pa.int64())]
            docs = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.StructArray.from_arrays(columns, fields=doc))
            rest = [pa.array([x], t) for x, t in zip((shard, made, bits, len(flat)), schema.types, strict=False)]
            return pa.RecordBatch.from_arrays([*rest, docs, pa.array([pack(flat, bits)], pa.binary())], schema=schema)

        # Documents of the block that is being filled: ids, sizes, token ids.
        held = pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, texts in slices(batch.column("text"), ENCODE_BYTES):
                flat, counts = coder.encode(texts)
                ended = np.full(len(flat) + len(counts), end_id, np.uint32)
                ended[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
                docs = pa.concat_arrays([held[0], ids.slice(lo, len(texts))])
                sizes, tokens = np.concatenate([held[1], counts + 1]), np.concatenate([held[2], ended])
                upto = np.concatenate([[0], np.cumsum(sizes)])
                *full, (a, b) = ranges(sizes, block_ids)
                for first, last in full:
                    yield block(docs.slice(first, last - first), sizes[first:last], tokens[upto[first] : upto[last]])
                    made += 1
                held = docs.slice(a, b - a), sizes[a:b], tokens[upto[a] :]
        if len(held[0]):
            yield block(*held)

    return write


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, shards: int | None = None
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending document id; the stored blocks."""
    spark = docs.sparkSession
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Two columns, so that a range can end within the rows of one id.
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("text").alias("tie"),
    )
    ordered = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    blocks = ordered.select("doc_id", "text").mapInArrow(task(_writer(tokenizer, end_id, block_ids), "tokens"), BLOCK_SCHEMA)
    return stored(blocks, codec="none")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"], row["bits"], 0, row["n_ids"])
            data = memoryview(ids.astype("<u4").tobytes())
            out = [
                (d["doc_id"], d["offset"], d["n"], zlib.crc32(data[4 * d["offset"] : 4 * (d["offset"] + d["n"])]))
                for d in row["docs"]
            ]
            names = ("doc_id", "offset", "n_tokens", "ids_crc32")
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            place = [pa.array([row[c]] * len(out), pa.int32()) for c in ("shard", "block")]
            yield pa.RecordBatch.from_arrays([*place, *columns], names=["shard", "block", *names])


def token_index(blocks: DataFrame) -> DataFrame:
    """Read the blocks back: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The running total over shards is one row per shard and block, never per document: totals of
    shards are summed in order, then the blocks within each shard.
    """
    from pyspark.sql import Window

    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    shards = shards.select("shard", before.alias("shard_start"))
    inner = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.join(shards, "shard").select(
        "shard", "block", (F.col("shard_start") + F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).alias("base")
    )
    read = blocks.mapInArrow(
        task(_read, "tokens"), "shard int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long"
    )
    return read.join(places, ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
