"""Groups of near-duplicate documents: bottom-k sketches, inverted lists, exact Jaccard.

1. **Sets.** A document is its set of distinct word shingles (64-bit hashes). Documents of one set
   are one *class*; the class is represented by its least document id from here on.
2. **Sketches.** The ``K`` least hashes of a set, from one hash function. Of two sets that reach the
   threshold, the ``K`` least values of the union hold at least ``overlap_floor`` values common to
   both sketches (chance of fewer: below ``MISS``; sets within ``K`` are whole, so exact).
3. **Inverted lists.** Sketch values are ranked from rare to common. Two sketches of ``k`` values that
   share ``o`` of them also share one of the ``k - o + 1`` rarest of each, so only those enter the
   inverted lists: values of passages that many documents share stay out unless a document consists of
   them. A value in one class only leads nowhere.
4. **Stars.** Each list is compared with its pivot, the class whose sketch is most common, by exact
   intersection of the full sets: linear in the list, however long.
5. **Rest.** Two members of one list that the stars have not brought together may still be linked. The
   members of a pivot are cut in blocks by their similarity to it. Jaccard distance is a metric, so
   blocks whose distances to the pivot differ by more than the threshold allows can't hold a link and
   are left out. All other blocks are compared two at a time: the estimate from the union's sketch
   filters the pairs, exact intersections verify those left, and only links are returned. (Stars skip
   the estimate, for their exact similarities place the members.)
6. Connected components of the links, then back to all documents of each class.

No pair of a list is written unless it is a star or a link, and no task holds more than two blocks.

**Edge cases.** A document of fewer words than a shingle is one shingle of all its words. Null and
blank texts have an empty set, are linked with nothing and are their own component. Rows without an id
are not linked: their component is null and they are kept. Rows that share an id are one document, with
all their sets. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import (
    coded,
    drop_tables,
    mix,
    slices,
    stored,
    stored_at,
    tables_so_far,
    task,
    word_hashes,
    words_of,
)
from flowlens.operators.graph import components

K = 64
MISS = 1e-9
BLOCK = 256
# Id lists of candidates up to this many rows (16 bytes each) are broadcast, longer ones shuffled.
BROADCAST_IDS = 1_000_000
LEVELS = 20  # similarity classes of blocks

_SETS = "doc_id long, n_shingles long, digest long, check long, sketch array<bigint>, shingles binary"


def overlap_floor(k: int, num: int, den: int) -> int:
    """Most values that sets at the threshold share among ``k`` of their union, but for ``MISS``."""
    t, below = num / den, 0.0
    for shared in range(k + 1):
        below += math.comb(k, shared) * t**shared * (1 - t) ** (k - shared)
        if below > MISS:
            return max(1, shared)
    return k


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    offsets, words = words_of(texts, lower=True)
    codes, distinct = coded(words)
    w = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = max(0, len(w) - width + 1)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : n + j]
    h = mix(h)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if hi - lo >= width:
            yield np.unique(h[lo : hi - width + 1])
        elif hi > lo:
            short = np.uint64(hi - lo)
            for word in w[lo:hi]:
                short = mix(np.array([short]) * np.uint64(0x9E3779B97F4A7C15) + word)[0]
            yield np.array([short], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _signatures(width: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in slices(batch.column("text")):
                sizes, digests, checks, sketches, sets = [], [], [], [], []
                with np.errstate(over="ignore"):
                    for found in shingle_sets(texts, width):
                        sizes.append(len(found))
                        digests.append(int(mix(found).sum().view(np.int64)) if len(found) else None)
                        checks.append(int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if len(found) else None)
                        sketches.append(found[:K].view(np.int64))
                        sets.append(found.tobytes() if full else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, len(texts)),
                        pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), pa.array(checks, pa.int64()),
                        pa.array(sketches, pa.list_(pa.int64())), pa.array(sets, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "check", "sketch", "shingles"],
                )

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets in ``a`` with all in ``b``."""
    ka, kb = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(ka, kb)
    out = np.zeros((len(a), len(b)), np.int64)

    def places(keys: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, keys), max(0, len(shared) - 1))
        hit = shared[at] == keys
        return row[hit], at[hit]

    if not len(shared):
        return out
    (ra, ca), (rb, cb) = places(ka, a), places(kb, b)
    for lo in range(0, len(shared), 4096):
        ma, mb = (np.zeros((len(s), 4096), np.float32) for s in (a, b))
        for m, r, c in ((ma, ra, ca), (mb, rb, cb)):
            part = (c >= lo) & (c < lo + 4096)
            m[r[part], c[part] - lo] = 1
        out += np.rint(ma @ mb.T).astype(np.int64)
    return out


def _sets_of(rows: list[dict]) -> list[np.ndarray]:
    return [np.frombuffer(r["shingles"], np.uint64) for r in rows]


_STAR = "pivot long, member long, common long, united long"


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row: the sets of one pivot, and a block of its members with theirs."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            a, b = _sets_of(row["own"]), _sets_of(row["others"])
            common = overlaps(a, b)
            size = np.array([len(s) for s in b])
            united = np.array([len(s) for s in a])[:, None] + size - common
            n = len(a) * len(b)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["pivot"]] * n, pa.int64()),
                    pa.array([r["id"] for r in row["others"]] * len(a), pa.int64()),
                    pa.array(common.ravel()), pa.array(united.ravel()),
                ],
                names=["pivot", "member", "common", "united"],
            )


def union_sketch(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Values of the union's sketch that both sets of each pair hold; ``K`` times the estimate."""

    def padded(sets: list[np.ndarray], fill: int) -> np.ndarray:
        # Short sketches end in values of their own side, above all hashes but for chance.
        out = np.tile(np.uint64(2**64 - 1) - np.arange(K, dtype=np.uint64) * np.uint64(2) - np.uint64(fill), (len(sets), 1))
        for i, s in enumerate(sets):
            out[i, : len(s[:K])] = s[:K]
        return out

    both = np.sort(np.concatenate([padded(a, 0), padded(b, 1)], axis=1), axis=1)
    twice = both[:, 1:] == both[:, :-1]
    rank = np.arange(2 * K - 1) - np.cumsum(twice, axis=1) + twice  # among distinct values
    return (twice & (rank < K)).sum(axis=1)


def _links(num: int, den: int):
    floor_at = overlap_floor(K, num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row: two blocks of one pivot; links between members of different labels."""
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                a, b = _sets_of(left), _sets_of(right)
                na, nb = (np.array([len(s) for s in sets]) for sets in (a, b))
                apart = np.array([r["label"] for r in left])[:, None] != np.array([r["label"] for r in right])
                fits = (den * na[:, None] >= num * nb) & (den * nb >= num * na[:, None])
                x, y = np.nonzero(apart & fits)
                # Estimate first; sets within K are whole, and their union may be smaller.
                need = np.minimum(floor_at, -(-num * np.minimum(na[x], nb[y]) // den))
                likely = np.zeros(len(x), bool)
                for lo in range(0, len(x), 8192):
                    part = slice(lo, lo + 8192)
                    got = union_sketch([a[k] for k in x[part].tolist()], [b[k] for k in y[part].tolist()])
                    likely[part] = got >= need[part]
                x, y = x[likely], y[likely]
                if len(x):  # exact, over the rows and columns that are left
                    rows, x_at = np.unique(x, return_inverse=True)
                    cols, y_at = np.unique(y, return_inverse=True)
                    common = overlaps([a[k] for k in rows.tolist()], [b[k] for k in cols.tolist()])[x_at, y_at]
                    hit = den * common >= num * (na[x] + nb[y] - common)
                    x, y = x[hit], y[hit]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([left[k]["id"] for k in x.tolist()], pa.int64()),
                        pa.array([right[k]["id"] for k in y.tolist()], pa.int64()),
                    ],
                    names=["a", "b"],
                )

    return run


def _lists(sets: DataFrame, floor_at: int, num: int, den: int) -> DataFrame:
    """Inverted lists (value, rep, score) of the rarest values of each sketch."""
    size = F.least(F.col("n_shingles"), F.lit(K))
    # Sets well within K meet only sets that are whole too.
    whole = F.ceil(F.col("n_shingles") * num / den)
    need = F.when(F.col("n_shingles") * den < K * num, whole).otherwise(F.least(whole, F.lit(floor_at)))
    values = sets.select("rep", size.alias("size"), need.alias("need"), F.explode("sketch").alias("value"))
    counts = values.groupBy("value").count().filter("count > 1")
    by_rarity = Window.partitionBy("rep").orderBy("count", "value")
    own = Window.partitionBy("rep")
    ranked = (
        values.join(counts, "value")
        .withColumn("rank", F.row_number().over(by_rarity))
        .withColumn("met", F.count("*").over(own))
        .withColumn("score", F.sum("count").over(own))
    )
    # The values met nowhere else are the rarest: ``size - met`` of them precede these.
    return ranked.filter(F.col("rank") <= F.col("met") - F.col("need") + 1).select("value", "rep", "score")


def _with_sets(rows: DataFrame, key: str, full: DataFrame, extra: list[str]) -> DataFrame:
    """``rows`` with the sets of the document ``key``, as structs (id, shingles, ...)."""
    sets = full.select(F.col("id").alias(key), "shingles")
    one = F.struct(F.col(key).alias("id"), "shingles", *extra)
    return rows.join(sets, key).withColumn("item", one)


def near_duplicates(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two documents are linked if their sets of ``width``-word shingles have a Jaccard similarity of
    ``num / den`` or more.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(texts.mapInArrow(task(_signatures(width, False)), _SETS).drop("shingles"))
    sets = stored(
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("digest", "check", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch"))
    )
    mark = tables_so_far()
    lists = stored(_lists(sets, overlap_floor(K, num, den), num, den))
    pivots = lists.groupBy("value").agg(
        F.max_by("rep", F.struct("score", -F.col("rep"))).alias("pivot"), F.count("*").alias("n")
    )
    stars = stored(
        lists.join(pivots.filter("n > 1").drop("n"), "value")
        .filter("rep <> pivot")
        .select("pivot", F.col("rep").alias("member"))
        .distinct()
    )

    # Full sets of the classes in stars, by rereading only their documents.
    wanted = stored(stars.select(F.explode(F.array("pivot", "member")).alias("doc_id")).distinct())
    few = wanted.count() <= BROADCAST_IDS
    chosen = texts.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    full = stored(
        chosen.mapInArrow(task(_signatures(width, True)), _SETS)
        .filter("n_shingles > 0")
        .groupBy(F.col("doc_id").alias("id"), "digest", "check")
        .agg(F.any_value("shingles").alias("shingles"))
    )

    # Stars, in blocks of members.
    parts = stars.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    placed = stars.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("member"), "parts"))
    others = (
        _with_sets(placed.select("pivot", "part", "member"), "member", full, [])
        .groupBy("pivot", "part")
        .agg(F.collect_list("item").alias("others"))
    )
    own = _with_sets(stars.select("pivot").distinct(), "pivot", full, []).groupBy("pivot").agg(
        F.collect_list("item").alias("own")
    )
    measured = stored(others.join(own, "pivot").select("pivot", "own", "others").mapInArrow(task(_stars), _STAR))
    hit = F.col("common") * den >= F.col("united") * num
    links = measured.filter(hit).select(F.col("pivot").alias("a"), F.col("member").alias("b"))
    nodes = wanted.select(F.col("doc_id").alias("node"))
    labels = stored(components(nodes, links, "a", "b").select(F.col("node").alias("member"), F.col("component").alias("label")))

    # The rest: members of one pivot with different labels, block against block.
    # (A document with several sets counts with the most similar one.)
    near = measured.groupBy("pivot", "member").agg(F.max(F.floor(LEVELS * F.col("common") / F.col("united"))).alias("level"))
    home = labels.select(F.col("member").alias("pivot"), F.col("label").alias("home"))
    members = near.join(labels, "member").join(home, "pivot").select(
        "pivot", "member", "label", "level", (F.col("label") == F.col("home")).alias("joined")
    )
    blocks = members.groupBy("pivot", "joined", "level").agg(
        F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    several = blocks.groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high")
    blocks = stored(
        blocks.join(several.select("pivot"), "pivot").select(
            "pivot", "joined", "level", F.ceil(F.col("n") / BLOCK).alias("parts")
        )
    )
    if blocks.isEmpty():
        all_links, kept_path = stored_at(links)
    else:
        members = stored(
            members.join(blocks, ["pivot", "joined", "level"]).withColumn("part", F.pmod(F.xxhash64("member"), "parts"))
            .drop("parts")
        )
        cells = blocks.select("pivot", "joined", "level", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
        cell = F.struct("level", "joined", "part")
        a = cells.select("pivot", cell.alias("left"))
        b = cells.select("pivot", cell.alias("right"))
        apart = (F.col("right.level") - F.col("left.level") - 1) * den >= LEVELS * (den - num)
        jobs = stored(
            a.join(b, "pivot").filter((F.col("left") <= F.col("right")) & ~apart & ~(F.col("left.joined") & F.col("right.joined")))
            .withColumn("job", F.xxhash64("pivot", "left", "right"))
        )
        filled = _with_sets(members, "member", full, ["label"]).select(
            "pivot", cell.alias("cell"), "item"
        )

        def side(name: str, out: str) -> DataFrame:
            return (
                jobs.select("job", "pivot", F.col(name).alias("cell"))
                .join(filled, ["pivot", "cell"])
                .groupBy("job")
                .agg(F.collect_list("item").alias(out))
            )

        more = side("left", "a").join(side("right", "b"), "job").select("a", "b").mapInArrow(task(_links(num, den)), "a long, b long")
        all_links, kept_path = stored_at(links.unionByName(more.distinct()))
    # The links say it all from here on.
    drop_tables(spark, mark, [kept_path])

    # Documents with one id are one node: join their classes too.
    same = signed.filter("n_shingles > 0 and doc_id is not null").join(
        sets.select("digest", "check", "n_shingles", "rep"), ["digest", "check", "n_shingles"]
    )
    several = same.groupBy("doc_id").agg(F.count_distinct("rep").alias("n")).filter("n > 1").select("doc_id")
    ties = same.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    classes = components(
        sets.select(F.col("rep").alias("node")), all_links.unionByName(ties), "a", "b"
    ).select(F.col("node").alias("rep"), "component")
    found = (
        signed.drop("sketch")
        .join(sets.select("digest", "check", "n_shingles", "rep"), ["digest", "check", "n_shingles"], "left")
        .join(classes, "rep", "left")
    )
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
