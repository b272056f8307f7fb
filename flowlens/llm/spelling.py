"""Spelling variants: words one edit apart, and the most frequent form of each.

**Near words by asymmetric q-chunks.** Of two words one edit apart, the shorter (of equal lengths: the first by
code point) contributes two disjoint chunks, its halves; the other contributes its positional grams of the
lengths that such halves have. One edit touches one half at most, so the other half stands in the longer
word, moved by one place at most: chunks and grams are joined on length, half and text within
a shift of one, and the Levenshtein distance verifies every candidate. No pair within a distance of one is
missed and no list of pairs is built but of true ones. Hot chunks are spread: their words are dealt to as
many salts as the chunk's grams need, and the grams go to each.

**Forms.** A word's form is its near word of largest count (ties: smallest by code point) if that
count is ``RATIO`` times its own or more. Counts grow along forms, so chains end, after at most a
logarithm of the largest count; roots are found by pointer doubling in as many rounds as that needs.

**Counts** are made per task (map-side) over whole texts and summed by word, so a hot word is one row per task and flush.

**Edge cases.** Null texts have no words; a null doc_id counts as the empty text in the hash of a
run; repeated rows count each; runs of any length are words. An empty table, or one without frequent words, gives no rows.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import slices, stored, task

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SLIP = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
# Distinct words that a task holds before it hands them on.
HELD_WORDS = 200_000
# Grams of one chunk that one salt meets.
HOT_GRAMS = 20_000


def slipped(run: str, start: int, slip: int) -> str:
    """The run, less one code point where the hash (continued from ``start``) is a multiple of ``slip``."""
    h = zlib.crc32(run.encode(), start)
    if h % slip:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(slip: int, least_length: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w in counts if len(w) >= least_length]
            out = [pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "n"])

        for batch in batches:
            ids = batch.column("doc_id")
            for lo, texts in slices(pc.ascii_lower(batch.column("text"))):
                for i, text in enumerate(texts.to_pylist()):
                    if not text:
                        continue
                    start = zlib.crc32(f"{'' if ids[lo + i].as_py() is None else ids[lo + i].as_py()}:".encode())
                    for word, n in Counter(RUN.findall(text)).items():
                        counts[slipped(word, start, slip)] += n
                    if len(counts) > held:
                        yield flush()
        if counts:
            yield flush()

    return run


def word_counts(
    docs: DataFrame, slip: int = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT
) -> DataFrame:
    """Words of ``docs`` (doc_id, text) with their counts: word, n."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = rows.mapInArrow(task(_counted(slip, least_length, HELD_WORDS)), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --- near words --------------------------------------------------------------------------------


def _piece(first: Column, length: Column) -> Column:
    """``length`` code points of the word from position ``first`` (from 0)."""
    return F.substring(F.col("word"), first + 1, length)


def _key(length: Column, half: int, text: Column) -> Column:
    """A chunk or gram: length of the word that gives the chunk, which half, and its text."""
    return F.struct(length.alias("length"), F.lit(half).alias("half"), text.alias("text"))


def chunks(words: DataFrame) -> DataFrame:
    """Two disjoint chunks per word with their positions: key, position, word, n."""
    length = F.char_length("word")
    half = F.floor(length / 2).cast("int")
    both = F.array(
        F.struct(_key(length, 0, _piece(F.lit(0), half)).alias("key"), F.lit(0).alias("position")),
        F.struct(_key(length, 1, _piece(half, length - half)).alias("key"), half.alias("position")),
    )
    return words.select("word", "n", F.explode(both).alias("c")).select("c.key", "c.position", "word", "n")


def grams(words: DataFrame) -> DataFrame:
    """Positional grams that a chunk of a word of the same length, or one shorter, can match within a shift of one."""
    own = F.char_length("word")
    made = []
    for shorter in (0, 1):
        length = own - shorter
        half = F.floor(length / 2).cast("int")
        for part, size, home in ((0, half, F.lit(0)), (1, length - half, half)):
            for shift in (-1, 0, 1):
                at = home + shift
                gram = F.struct(_key(length, part, _piece(at, size)).alias("key"), at.cast("int").alias("position"))
                made.append(F.when((at >= 0) & (at + size <= own), gram))
    every = F.array_compact(F.array(*made))
    return words.select("word", "n", F.explode(every).alias("g")).select("g.key", "g.position", "word", "n")


def near_pairs(words: DataFrame, hot: int = HOT_GRAMS) -> DataFrame:
    """Pairs of words exactly one edit apart, each once: word, n, other, other_n."""
    left = chunks(words).toDF("key", "position", "word", "n")
    right = grams(words).toDF("key", "at", "other", "other_n")
    sizes = right.groupBy("key").agg(F.count("*").alias("grams")).filter(F.col("grams") > hot)
    salted = stored(sizes.select("key", F.ceil(F.col("grams") / hot).cast("int").alias("salts")))
    if salted.isEmpty():
        joined = left.join(right, "key")
    else:
        one = F.coalesce("salts", F.lit(1))
        left = left.join(salted, "key", "left").withColumn("salt", F.pmod(F.xxhash64("word"), one).cast("int")).drop("salts")
        right = right.join(salted, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")
        joined = left.join(right, ["key", "salt"])
    first = (F.char_length("word") < F.char_length("other")) | (F.col("word") < F.col("other"))
    within = F.abs(F.col("position") - F.col("at")) <= 1
    verified = F.levenshtein("word", "other", 1) == 1
    return joined.filter(within & first & verified).select("word", "n", "other", "other_n").distinct()


# --- forms -------------------------------------------------------------------------------------


def _rounds(most: int, ratio: int) -> int:
    """Doublings that reach the end of every chain: counts grow by ``ratio`` at each step."""
    steps, n = 1, 1
    while n * ratio <= most:
        n, steps = n * ratio, steps + 1
    return max(1, steps.bit_length())


def variants(words: DataFrame, ratio: int = RATIO, hot: int = HOT_GRAMS) -> DataFrame:
    """Forms and roots of ``words`` (word, n): word, form, root, n, n_near, form_n."""
    words = stored(words.select("word", "n"))
    pairs = stored(near_pairs(words, hot))
    mirrored = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = pairs.unionByName(mirrored).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best")
    )
    most = -F.col("best.less")
    fits = most >= ratio * F.col("n")
    near = stored(
        best.select("word", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, most).alias("form_n"))
    )
    steps = near.filter("form is not null").select("word", F.col("form").alias("root"))
    top = words.agg(F.max("n")).first()[0] or 0
    for _ in range(_rounds(top, ratio)):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = stored(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    found = words.join(near, "word", "left").join(steps, "word", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )


def spelling_groups(docs: DataFrame) -> DataFrame:
    """``variants`` of all frequent words of ``docs``."""
    return variants(word_counts(docs))
