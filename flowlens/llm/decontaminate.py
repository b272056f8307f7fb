"""Benchmark decontamination by template canonicalisation.

Texts become templates: every word is trimmed of punctuation and lower-cased, numbers become ``<num>``,
units after a number ``<unit>``, and capitalised words within a sentence ``<name>``. A document and a
benchmark item that share a window of ``WINDOW`` template words, of which ``LITERAL`` or more are not
placeholders, are aligned there. The names and units of all windows on one alignment must be consistent: one
value of the item always meets one value of the document and the other way round (the question with other
numbers and names). Numbers map freely, for two of them may be equal by chance. Of alignments that contradict
themselves only the windows that agree verbatim count, if they hold ``VERBATIM`` words or more.

Windows are also joined by the hash of their words as they stand, slots included, however few of them are
literal. An item that has no window with ``LITERAL`` literal words is searched as one template, from its first
word to its last.

An alignment counts if it has two windows or more, or covers half of the item's words. A lone window of a longer
item counts only if it agrees verbatim and is not stock wording, which stands in more than ``STOCK`` texts of the block.

The windows are joined by hash within the tasks over documents, against one block of benchmark items at a
time; a block holds about ``BLOCK_WORDS`` words at most, so what travels to the tasks is bounded however
many items there are, and the documents are neither shuffled nor cut.

**Edge cases.** Null and blank texts match nothing. Items of two to ``SHORTEST`` - 1 template words would meet clean
documents, so they are only found verbatim as a document's whole text (``short_items=False`` leaves them out), items of
one word never; longer items shorter than a window are searched as a whole. Items
without ``LEAST`` literal words are searched verbatim only, for their templates are bare lists of numbers. Null item
ids are left out; repeated items count once; repeated documents are judged each; an empty benchmark
leaves every document clean, an empty corpus gives no rows. Very long texts are searched whole. Columns of any names pass
through; one named ``leaks`` is replaced.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import appended, aside, coded, mix, starts_of, word_hashes, words_of

WINDOW = 8
LITERAL = 5
SHORTEST = 5
LEAST = 2
STOCK = 2
BLOCK_WORDS = 1_000_000
_SIEVE_BITS = 22

# Words that count as units behind a number, and number words.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec seconds min minutes h hours days weeks months years"
    " percent euros dollars pounds cents degrees miles meters metres kilometers kilometres grams kilograms"
    " liters litres inches feet"
).split()
NUMBERS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    " seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
).split()
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡"
_NUM, _UNIT, _NAME = np.uint64(11), np.uint64(12), np.uint64(13)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Templates:
    """Template words of texts: ``form`` hashes the placeholder or word, ``value`` always the word."""

    def __init__(self, texts: pa.Array) -> None:
        offsets, words = words_of(texts)
        codes, distinct = coded(words)
        bare = pc.utf8_trim(distinct, characters=_MARKS)
        lower = pc.utf8_lower(bare)

        def flag(values: pa.Array) -> np.ndarray:
            return values.to_numpy(zero_copy_only=False).astype(bool)[codes] if len(codes) else np.zeros(0, bool)

        full = flag(pc.greater(pc.binary_length(bare), 0))
        ends = flag(pc.match_substring_regex(distinct, r"[.!?:][\"')\]”’»]*$"))
        number = flag(
            pc.or_(pc.match_substring_regex(bare, r"^[0-9][0-9.,:/]*$"), pc.is_in(lower, pa.array(NUMBERS)))
        )
        title = flag(pc.match_substring_regex(bare, r"^\p{Lu}\p{Ll}+$"))
        unit = flag(pc.is_in(lower, pa.array(UNITS)))
        value = word_hashes(lower)[codes] if len(codes) else np.zeros(0, np.uint64)
        opens = np.zeros(len(codes) + 1, bool)
        opens[offsets] = True
        opens[1:] |= ends
        before = np.concatenate([[0], np.cumsum(full)])
        self.offsets = before[offsets]
        keep = np.flatnonzero(full)
        number, unit, title, opens = number[keep], unit[keep], title[keep], opens[:-1][keep]
        behind = np.zeros(len(keep), bool)
        behind[1:] = number[:-1]
        behind[self.offsets[:-1][np.diff(self.offsets) > 0]] = False
        self.value = value[keep]
        name = title & ~opens & ~number
        unit &= behind & ~number & ~name
        self.form = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, self.value | np.uint64(16))))
        self.slot = number | unit | name

    def windows(self, size: int, verbatim: bool, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the windows of ``size`` words with ``least`` literal ones, by template or by words."""
        n = len(self.form) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        fits = starts_of(self.offsets, size)[:n]
        if least:
            total = np.concatenate([[0], np.cumsum(~self.slot)])
            fits = fits & (total[size:] - total[:-size] >= least)
        at = np.flatnonzero(fits)
        source = self.value if verbatim else self.form
        if size <= WINDOW:
            h = np.full(n, size, np.uint64)
            for j in range(size):
                h = h * _STEP + source[j : n + j]
            return at, mix(h[at])
        # Long windows from running sums: as many steps for any size.
        powers = np.cumprod(np.full(len(source), _STEP))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(source * np.cumprod(np.full(len(source), _BACK)))])
        return at, mix((sums[at + size] - sums[at]) * powers[at + size - 1] + powers[size - 1 : size] * np.uint64(size))


class Items:
    """Benchmark items of one block, ready to be looked up."""

    def __init__(self, ids: list[int], texts: list[str], short_items: bool = True) -> None:
        self.templates = Templates(pa.array(texts, pa.string()))
        lengths = np.diff(self.templates.offsets)
        self.ids, self.lengths = ids, lengths
        item_of = np.repeat(np.arange(len(ids)), lengths)
        self.tables: dict[tuple[int, bool, int], tuple] = {}
        covered = np.zeros(len(ids), bool)
        text_of = np.unique(np.array(texts, object), return_inverse=True)[1] if texts else np.zeros(0, np.int64)
        self.stock = np.zeros(len(item_of), bool)  # by the window's first word

        def add(size: int, verbatim: bool, least: int, wanted: np.ndarray) -> None:
            at, hashes = self.templates.windows(size, verbatim, least)
            take = wanted[item_of[at]]
            at, hashes = at[take], hashes[take]
            if not len(at):
                return
            if not verbatim:
                covered[item_of[at]] = True
            order = np.argsort(hashes, kind="stable")
            sieve = np.zeros(1 << min(_SIEVE_BITS, len(at).bit_length() + 6), bool)
            sieve[(hashes & np.uint64(len(sieve) - 1)).astype(np.int64)] = True
            self.tables[size, verbatim, least] = (hashes[order], at[order], item_of[at[order]], sieve)

        for size in sorted({min(WINDOW, int(n)) for n in lengths if n >= SHORTEST}):
            wanted = lengths >= WINDOW if size == WINDOW else lengths == size
            add(size, False, min(LITERAL, size), wanted)
            add(size, True, 0, wanted)
        if (WINDOW, True, 0) in self.tables:
            hashes, at, items, _ = self.tables[WINDOW, True, 0]
            firsts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(hashes))))
            pairs = np.unique(np.stack([group, text_of[items]]), axis=1)
            self.stock[at] = (np.bincount(pairs[0], minlength=len(firsts)) > STOCK)[group]
        for size in range(2, SHORTEST) if short_items else ():
            add(size, True, 0, lengths == size)
        whole = ~covered & (lengths >= SHORTEST)
        for size in sorted({int(n) for n in lengths[whole]}):
            add(size, False, LEAST, whole & (lengths == size))

    def matches(self, texts: pa.Array) -> list[dict[int, int]]:
        """Per text: matched words by item id."""
        found = Templates(texts)
        hits: dict[tuple[int, int, int], list[tuple[int, int, int]]] = defaultdict(list)
        doc_of = np.repeat(np.arange(len(texts)), np.diff(found.offsets))
        for (size, verbatim, least), (keys, places, items, sieve) in self.tables.items():
            at, hashes = found.windows(size, verbatim, least)
            if size < SHORTEST:  # short items only as whole texts
                alone = np.diff(found.offsets)[doc_of[at]] == size
                at, hashes = at[alone], hashes[alone]
            maybe = sieve[(hashes & np.uint64(len(sieve) - 1)).astype(np.int64)]
            at, hashes = at[maybe], hashes[maybe]
            low, high = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, side="right")
            for k in np.flatnonzero(high > low).tolist():
                for j in range(low[k], high[k]):
                    key = (int(doc_of[at[k]]), int(items[j]), int(at[k] - places[j]))
                    hits[key].append((int(at[k]), int(places[j]), size))
        out: list[dict[int, int]] = [{} for _ in range(len(texts))]
        for (doc, item, _), windows in hits.items():
            words = {(a + i, b + i) for a, b, size in windows for i in range(size)}
            if not self._consistent(found, words):
                words = self._verbatim(found, windows)
                if not words:
                    continue
            if not self._enough(found, windows, len(words), item):
                continue
            score = out[doc]
            score[self.ids[item]] = max(score.get(self.ids[item], 0), len(words))
        return out

    def _consistent(self, found: Templates, words: set[tuple[int, int]]) -> bool:
        """Does each name or unit of one side always meet the same one of the other?"""
        there: dict[tuple[int, int], int] = {}
        back: dict[tuple[int, int], int] = {}
        for a, b in words:
            if found.slot[a] and found.form[a] != _NUM:
                kind, x, y = int(found.form[a]), int(found.value[a]), int(self.templates.value[b])
                if there.setdefault((kind, y), x) != x or back.setdefault((kind, x), y) != y:
                    return False
        return True

    def _enough(self, found: Templates, windows: list[tuple[int, int, int]], words: int, item: int) -> bool:
        """Is an alignment more than a lone window of a longer item that may have met by chance?"""
        if len({a for a, _, _ in windows}) > 1 or 2 * words >= self.lengths[item]:
            return True
        return bool(self._verbatim(found, windows)) and not self.stock[windows[0][1]]

    def _verbatim(self, found: Templates, windows: list[tuple[int, int, int]]) -> set[tuple[int, int]]:
        """Words of the windows that agree in every word, slots included."""
        own = self.templates.value
        same = [w for w in windows if (found.value[w[0] : w[0] + w[2]] == own[w[1] : w[1] + w[2]]).all()]
        return {(a + i, b + i) for a, b, size in same for i in range(size)}


def _blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """Items in blocks of bounded size, one collected at a time."""
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
    words = items.agg(F.coalesce(F.sum(F.size(F.split("text", "\\s+"))), F.lit(0))).first()[0]
    parts = -(-int(words) // BLOCK_WORDS)
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        yield sorted((r[0], r[1]) for r in rows)


def with_leaks(docs: DataFrame, benchmark: DataFrame, short_items: bool = True) -> DataFrame:
    """``docs`` with ``leaks``: array of (item_id, words), the items that a text holds passages of."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("words", pa.int64())]))
    names = []
    plain, back = aside(docs.drop("leaks"), ("text",))
    for k, rows in enumerate(_blocks(benchmark)):
        items = Items([r[0] for r in rows], [r[1] for r in rows], short_items)

        def look(texts: pa.Array, items: Items = items) -> list[pa.Array]:
            found = [[{"item_id": i, "words": n} for i, n in sorted(m.items())] for m in items.matches(texts)]
            return [pa.array(found, kind)]

        names.append(f"leaks_{k}")
        plain = appended(plain, [(names[-1], "array<struct<item_id:bigint,words:bigint>>")], look)
    if not names:
        return plain.select(*back, F.array().cast("array<struct<item_id:bigint,words:bigint>>").alias("leaks"))
    return plain.select(*back, F.concat(*names).alias("leaks"))
