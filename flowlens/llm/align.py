"""Alignment of two tokenizers' tokens over the bytes of the same texts.

Texts are encoded with A (space + text, byte-level BPE) and B (text; it adds the space itself). Two
tokens are linked if their byte ranges overlap; a cut is an offset where tokens of both end, and the cuts divide
a text into groups.

**Lockstep merging.** Neither tokenizer joins text across a space that follows a printable character, so
texts are parts that start there, and each distinct part is aligned once per task. All parts that a slice brings
anew advance together: one NumPy state vector holds their A and B pointers; every step emits a link of each,
moves the pointer of the token that ends first (both, at a cut), and finished parts leave the vector. Documents are
sums over their parts.

**Corpus counts.** The number of documents that hold an id pair linked is summed by pair from one row per
(chunk, pair), and goes back to the chunks the same way: a pair in every document is one row per chunk, and
no task holds more than one chunk. The best count per A id is one row per id of A's vocabulary, which bounds its broadcast.

**Edge cases.** Null and empty texts, and texts whose tokens do not give back their bytes (U+2581, which B takes for a
space), have no tokens: zeros and an empty digest. Strings of special tokens are plain text. Very long texts stay whole, and a part
without any such space is one lane of the vector. Repeated rows count as documents each; null ids are kept; an empty table gives no
rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Ragged, kept, ranges, slices, stored, task
from flowlens.llm.tokens import cuts_of

CHUNK = 4 << 20
SLICE = 1 << 20
# Parts that a Python worker remembers; beyond it only those met again stay.
CACHE_PARTS = 150_000
# Bytes of unseen parts that go to a tokenizer as one string.
STRING_BYTES = 4096
SPACE = "▁"


# --- lockstep ----------------------------------------------------------------------------------


@dataclass
class Links:
    """Links in order of lane and position; ``cut`` marks those after which both tokens end."""

    lane: np.ndarray
    a: np.ndarray
    b: np.ndarray
    cut: np.ndarray


def lockstep(a_end: np.ndarray, a_first: np.ndarray, b_end: np.ndarray, b_first: np.ndarray) -> Links:
    """Merge the tokens of all lanes: lane i has the A tokens a_first[i] to a_first[i + 1], whose ends within
    the lane are ``a_end``, and likewise B. The last tokens of both end together."""
    lane = np.flatnonzero(a_first[1:] > a_first[:-1])
    i, j, last = a_first[lane].copy(), b_first[lane].copy(), a_first[lane + 1]
    out: list[tuple[np.ndarray, ...]] = []
    while len(lane):
        ea, eb = a_end[i], b_end[j]
        cut = ea == eb
        out.append((lane, i, j, cut))
        i, j = i + (ea <= eb), j + (eb <= ea)
        going = i < last
        if not going.all():
            lane, i, j, last = lane[going], i[going], j[going], last[going]
    if not out:
        none = np.zeros(0, np.int64)
        return Links(none, none, none, none.astype(bool))
    lanes, a, b, cut = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(lanes, kind="stable")
    return Links(lanes[order], a[order], b[order], cut[order])


# --- tokenizers --------------------------------------------------------------------------------


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and what is known of every part: ids, links and groups."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallel part
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        plain = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = token.encode() if token in plain else bytes(alphabet[c] for c in token)
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.b_space = self.b.piece_to_id(SPACE)
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self._start()

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode()

    def _start(self) -> None:
        self.known: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        self.seen = np.zeros(0, bool)  # asked for in more than one slice
        self.sums = np.zeros((0, 5), np.int64)  # good, A tokens, B tokens, groups, links
        self.pairs, self.times = Ragged(), Ragged()

    def _shrink(self) -> None:
        """Keep the parts that several slices had; forget the others."""
        rows = np.flatnonzero(self.seen)
        if len(rows) > CACHE_PARTS // 2:
            self._start()
            return
        place = {int(r): k for k, r in enumerate(rows)}
        self.known = {p: place[n] for p, n in self.known.items() if n in place}
        self.groups = [self.groups[r] for r in rows]
        self.sums, self.seen = self.sums[rows], np.zeros(len(rows), bool)
        self.pairs.keep(rows)
        self.times.keep(rows)

    def _encode_b(self, part: bytes) -> list[int]:
        """B's ids of a part; the space before it is B's own."""
        return [self.b_space] if part == b" " else self.b.encode(part[1:].decode())

    def _tokens(self, parts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(A ids, number per part, B ids, number per part, good): unseen parts, joined to longer strings."""
        sizes = np.array([len(p) for p in parts], np.int64)
        raw = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum(sizes)
        # Strings end where they are long enough, and after parts that may not be followed by another.
        free = np.zeros(len(raw) + 1, bool)
        free[cuts_of(raw)] = True
        stop = ~free[ends] | (np.diff(ends // STRING_BYTES, append=-1) != 0)
        stop[-1] = True
        cut = np.concatenate([[0], np.flatnonzero(stop) + 1])
        strings = [b"".join(parts[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
        a_ids = [e.ids for e in self.a.encode_batch_fast([s.decode() for s in strings], add_special_tokens=False)]
        b_ids = [self._encode_b(s) for s in strings]
        good = np.ones(len(parts), bool)
        for k, s in enumerate(strings):
            if b"".join(map(self.a_bytes.__getitem__, a_ids[k])) != s or b"".join(map(self.b_bytes.__getitem__, b_ids[k])) != s:
                a_ids[k], b_ids[k] = [], []
                for p in range(cut[k], cut[k + 1]):  # one by one: most parts of the string are good
                    one = self.a.encode(parts[p].decode(), add_special_tokens=False).ids, self._encode_b(parts[p])
                    good[p] = all(
                        b"".join(map(t.__getitem__, x)) == parts[p] for t, x in zip((self.a_bytes, self.b_bytes), one, strict=True)
                    )
                    if good[p]:
                        a_ids[k] += one[0]
                        b_ids[k] += one[1]
        at = np.cumsum(np.where(good, sizes, 0))
        out: list[np.ndarray] = []
        for ids, size in ((a_ids, self.a_size), (b_ids, self.b_size)):
            flat = np.fromiter((i for x in ids for i in x), np.int64, sum(map(len, ids)))
            out += [flat, np.diff(np.searchsorted(np.cumsum(size[flat]), at, side="right"), prepend=0)]
        return *out, good

    def _learn(self, parts: list[bytes]) -> None:
        a, n_a, b, n_b, good = self._tokens(parts)
        a_first, b_first = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))

        def ends(ids: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(size[ids])])
            return total[1:] - np.repeat(total[first[:-1]], np.diff(first))

        links = lockstep(ends(a, self.a_size, a_first), a_first, ends(b, self.b_size, b_first), b_first)
        n = len(parts)
        n_links, n_groups = np.bincount(links.lane, minlength=n), np.bincount(links.lane[links.cut], minlength=n)
        # Distinct id pairs of each part and how often it holds them.
        pair = (a[links.a] << 32) | b[links.b]
        order = np.lexsort((pair, links.lane))
        lane, pair = links.lane[order], pair[order]
        new = np.ones(len(pair), bool)
        new[1:] = (lane[1:] != lane[:-1]) | (pair[1:] != pair[:-1])
        at = np.flatnonzero(new)
        each = np.bincount(lane[at], minlength=n)
        self.pairs.add(pair[at], each)
        self.times.add(np.diff(at, append=len(pair)), each)
        # Groups as text: the tokens of both sides up to each cut.
        names = self.names
        a_to, b_to = (links.a[links.cut] + 1).tolist(), (links.b[links.cut] + 1).tolist()
        a_names, b_names = [names[i] for i in a.tolist()], [names[i] for i in b.tolist()]
        texts, i, j = [], 0, 0
        for x, y in zip(a_to, b_to, strict=True):
            texts.append(",".join(a_names[i:x]) + "|" + ",".join(b_names[j:y]))
            i, j = x, y
        upto = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        base = len(self.groups)
        self.groups += [";".join(texts[upto[k] : upto[k + 1]]).encode() for k in range(n)]
        self.known.update((p, base + k) for k, p in enumerate(parts))
        self.sums = np.concatenate([self.sums, np.stack([good, n_a, n_b, n_groups, n_links], axis=1).astype(np.int64)])
        self.seen = np.concatenate([self.seen, np.zeros(n, bool)])

    def numbers(self, parts: list[bytes]) -> np.ndarray:
        """Number of each (distinct) part; unseen ones are aligned."""
        if len(self.known) > CACHE_PARTS:
            self._shrink()
        known = self.known
        old = [known[p] for p in parts if p in known]
        new = [p for p in parts if p not in known]
        self.seen[old] = True
        for lo, hi in ranges(np.array([len(p) for p in new], np.int64), SLICE):
            self._learn(new[lo:hi])
        return np.fromiter((known[p] for p in parts), np.int64, len(parts))


def parts_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first part of each text, code of every part, distinct parts) of space + text; no parts without a text."""
    full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    led = pc.if_else(full, pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), ""), "").cast(pa.large_string())
    led = led.combine_chunks() if isinstance(led, pa.ChunkedArray) else led
    n = len(led)
    if not n or not pc.any(full).as_py():
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_binary())
    offsets = np.frombuffer(led.buffers()[1], np.int64)[led.offset : led.offset + n + 1]
    raw = np.frombuffer(led.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets - offsets[0]
    cuts = cuts_of(raw)
    bounds = np.zeros(len(raw) + 1, bool)
    bounds[cuts[raw[cuts] == 0x20]] = True
    bounds[ends] = True
    marks = np.flatnonzero(bounds)
    parts = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(marks) - 1, [None, pa.py_buffer(marks), pa.py_buffer(raw)]
    ).dictionary_encode()
    codes = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.searchsorted(marks, ends), codes, parts.dictionary


# --- chunks ------------------------------------------------------------------------------------

# ``first`` is where a document's links start in ``link`` (places in ``pairs``) and ``times`` (how often).
STAT_SCHEMA = (
    "chunk long, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>,"
    " groups_sha256 array<string>, first array<bigint>, link binary, times binary, pairs array<bigint>, docs array<bigint>"
)


def _aligned(aligner: Aligner, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(sums per text, digests, number of distinct pairs per text, pairs, times)."""
    first, codes, distinct = parts_of(texts)
    n = len(texts)
    number = aligner.numbers(distinct.to_pylist())
    doc = np.repeat(np.arange(n), np.diff(first))
    bad = np.bincount(doc, aligner.sums[number, 0][codes] == 0, minlength=n) > 0
    bad |= np.diff(first) == 0
    use = ~bad[doc]
    doc, codes = doc[use], codes[use]
    sums = np.stack([np.bincount(doc, aligner.sums[number, c][codes], minlength=n) for c in range(1, 5)], axis=1).astype(np.int64)
    groups = [aligner.groups[k] for k in number.tolist()]
    every, upto = codes.tolist(), np.searchsorted(doc, np.arange(n + 1)).tolist()
    digests = [
        "" if upto[k] == upto[k + 1] else hashlib.sha256(b";".join([groups[c] for c in every[upto[k] : upto[k + 1]]])).hexdigest()
        for k in range(n)
    ]
    # Parts of a document with their number, then the pairs of those parts.
    both, count = np.unique(doc * max(1, len(number)) + codes, return_counts=True)
    doc, part = np.divmod(both, max(1, len(number)))
    pair, size = aligner.pairs.take(number[part])
    times = aligner.times.take(number[part])[0] * np.repeat(count, size)
    doc = np.repeat(doc, size)
    order = np.lexsort((pair, doc))
    doc, pair, times = doc[order], pair[order], times[order]
    new = np.ones(len(pair), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    summed = np.add.reduceat(times, at) if len(at) else times
    return sums, digests, np.bincount(doc[at], minlength=n), pair[at], summed


def _stats(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept("align", f"{a_path}\n{b_path}", lambda: Aligner(a_path, b_path))
        part, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            sums = np.concatenate([h[1] for h in held])
            n = np.concatenate([h[3] for h in held])
            pairs, link = np.unique(np.concatenate([h[4] for h in held]), return_inverse=True)
            docs = np.bincount(link, minlength=len(pairs))
            times = np.concatenate([h[5] for h in held])
            lists = [ids, *(pa.array(c) for c in sums.T), pa.array([d for h in held for d in h[2]], pa.string())]
            lists += [pa.array(np.concatenate([[0], np.cumsum(n)]))]
            blobs = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (link, times)]

            def whole(x: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

            columns = [pa.array([part + made], pa.int64()), *map(whole, lists), *blobs, whole(pa.array(pairs)), whole(pa.array(docs))]
            return pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in STAT_SCHEMA.split(", ")])

        for batch in batches:
            ids = batch.column("doc_id")
            for lo, texts in slices(batch.column("text"), SLICE):
                held.append((ids.slice(lo, len(texts)), *_aligned(aligner, texts)))
                size += pc.sum(pc.binary_length(texts)).as_py() or 0
                if size >= CHUNK:
                    yield row()
                    held, size, made = [], 0, made + 1
        if held:
            yield row()

    return run


def link_counts(stats: DataFrame, a_ids: int) -> DataFrame:
    """Documents per id pair, and whether its A id has no pair with more: pair, n, best."""
    each = stats.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.pairs", "p.docs")
    counts = stored(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n")))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    if a_ids <= 1 << 20:  # one row per id of the vocabulary
        most = F.broadcast(most)
    return counts.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name).slice(k, 1) for name in batch.schema.names}

            def values(name: str, row: dict = row) -> np.ndarray:
                return row[name].flatten().to_numpy(zero_copy_only=False)

            first = values("first")
            link, times = (np.frombuffer(row[c][0].as_buffer(), np.int32) for c in ("link", "times"))
            n, best = values("n").astype(np.int64), values("best").astype(bool)
            # Running totals: sums of the runs between two documents' firsts, in whole numbers.
            total = np.concatenate([[0], np.cumsum(n[link] * times)])
            top = np.concatenate([[0], np.cumsum(np.where(best[link], times, 0), dtype=np.int64)])
            columns = [row[c].flatten() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            sums = [pa.array(np.diff(x[first])) for x in (top, total)]
            yield pa.RecordBatch.from_arrays(
                [*columns[:5], *sums, columns[5]],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): numbers of tokens, groups and links, links that are best for their A
    id, corpus counts summed over links, and the digest of the groups."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = stored(rows.mapInArrow(task(_stats(a_path, b_path), "align"), STAT_SCHEMA))
    from tokenizers import Tokenizer

    counts = link_counts(stats, Tokenizer.from_file(a_path).get_vocab_size())
    asked = stats.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    reply = asked.join(counts, "pair").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("r"))
    replies = reply.select("chunk", F.col("r.n").alias("n"), F.col("r.best").alias("best"))
    none = F.array()
    joined = stats.drop("pairs", "docs").join(replies, "chunk", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "first", "link", "times",
        F.coalesce("n", none.cast("array<bigint>")).alias("n"), F.coalesce("best", none.cast("array<boolean>")).alias("best"),
    )
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return joined.mapInArrow(task(_summed), schema)
