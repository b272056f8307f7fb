"""Exact top-k by integer inner product, with a pivot table for elimination.

Components become ``floor(256 * x)``. With ``M`` the largest squared norm, a vector ``x`` is lifted to
``(x, sqrt(M - |x|^2))`` and a query to ``(q, 0)``; then ``|q' - x'|^2 = |q|^2 + M - 2 <q, x>``, so the
largest inner product is the least distance. The index stores, for every vector, its lifted distances to
``PIVOTS`` pivots (a bounded sample). By the triangle inequality each pivot gives a lower bound on the
distance; the greatest of them bounds the score from above. A query evaluates candidates in the order of
their bounds and stops once no bound left can reach its k-th score, which is exact, ties included.

The index is cut in blocks, and so are the queries; every block of queries meets every block of the index
(a stated query set against all rows): one task per part of the stored index and part of the stored queries. It
reads both parts, so neither side is copied or broadcast for that, carries its queries' k best from block to block
of the index, and only those are merged. A task holds one part of the queries and one block of the index.

**Edge cases.** Vectors that are null or hold a null or non-finite component take no part; vectors of
different lengths are not compared; rows of the query's own id are not its candidates; repeated rows are
candidates each; with fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import stored, task

PIVOTS = 32
INDEX_ROWS, QUERY_ROWS = 4096, 512
BATCH = 128
SLACK = 0.5  # scores are whole, rounding of the bounds is far below

# Spark reads a whole row group of such long rows at once; Parquet would not close one below 100 rows.
ROW_GROUPS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}

_BLOCK = "block long, dim int, most long, ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score long"


def valid(vectors: DataFrame) -> DataFrame:
    """Rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)


def packed(vectors: np.ndarray) -> bytes:
    """Bytes of whole numbers, in the smallest of three widths that holds them all."""
    for kind in (np.int16, np.int32):
        if not vectors.size or (np.iinfo(kind).min <= vectors.min() and vectors.max() <= np.iinfo(kind).max):
            return vectors.astype(kind).tobytes()
    return vectors.tobytes()


def unpacked(data: bytes, count: int, dim: int) -> np.ndarray:
    if not count * dim:
        return np.zeros((count, dim))
    return np.frombuffer(data, f"i{len(data) // (count * dim)}").reshape(count, dim).astype(float)


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            rows = held.pop(dim)
            vectors = np.stack([v for _, v in rows]).reshape(len(rows), dim)
            made += 1
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "block": part + made, "dim": dim, "most": int((vectors**2).sum(axis=1).max()),
                        "ids": np.array([i for i, _ in rows], np.int64).tobytes(),
                        "vectors": packed(vectors),
                    }
                ],
                schema=pa.schema(
                    [("block", pa.int64()), ("dim", pa.int32()), ("most", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())]
                ),
            )

        for batch in batches:
            lists = batch.column("embedding")
            flat = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
            ends = np.cumsum([len(x) for x in lists])
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), np.split(flat, ends[:-1]), strict=True):
                rows = held.setdefault(len(v), [])
                rows.append((vec_id, v))
                if len(rows) >= size:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return run


def lifted(vectors: np.ndarray, pivots: np.ndarray, most: int, query: bool) -> np.ndarray:
    """Distances of the lifted vectors (or queries) to the lifted pivots."""
    norms, own = (vectors**2).sum(axis=1), (pivots**2).sum(axis=1)
    height = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(most - norms, 0.0))
    top = np.sqrt(np.maximum(most - own, 0.0))
    square = (norms + height**2)[:, None] + most - 2 * (vectors @ pivots.T) - 2 * height[:, None] * top
    return np.sqrt(np.maximum(square, 0.0))


def best_of(q: np.ndarray, bound: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: int, k: int, held=None):
    """(ids, scores) of the k best candidates of one query, in bound order until exact stopping.

    ``held`` are those of other blocks of the index; places not taken yet score minus infinity.
    """
    got_ids, got = held or (np.zeros(0, np.int64), np.zeros(0))
    order = np.argsort(-bound)
    lo, size = 0, BATCH
    while lo < len(order):
        if len(got) == k and bound[order[lo]] + SLACK < got[-1]:
            break
        part = order[lo : lo + size]
        lo, size = lo + size, 2 * size
        part = part[ids[part] != own]
        scores = vectors[part] @ q
        if len(got) == k:
            reach = scores >= got[-1]
            part, scores = part[reach], scores[reach]
        if len(part):
            all_ids, scores = np.append(got_ids, ids[part]), np.append(got, scores)
            top = np.lexsort((all_ids, -scores))[:k]
            got_ids, got = all_ids[top], scores[top]
    return got_ids, got


def _search(k: int, most: int, pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per block of queries: their ids, and the ids and scores of the k best so far.
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        at = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                dim = row["dim"].as_py()
                chosen = pivots.get(dim, np.zeros((0, dim)))
                if at != row["block"].as_py():
                    at, ids = row["block"].as_py(), np.frombuffer(row["ids"].as_py(), np.int64)
                    vectors = unpacked(row["vectors"].as_py(), len(ids), dim)
                    table = np.zeros((1, len(ids)))
                    if len(chosen):
                        table = np.frombuffer(row["distances"].as_py(), np.float64).reshape(len(chosen), -1)
                block = row["q_block"].as_py()
                if block not in held:
                    own = np.frombuffer(row["q_ids"].as_py(), np.int64)
                    held[block] = own, np.zeros((len(own), k), np.int64), np.full((len(own), k), -np.inf)
                own, best_ids, best = held[block]
                queries = unpacked(row["q_vectors"].as_py(), len(own), dim)
                mine = lifted(queries, chosen, most, query=True) if len(chosen) else np.zeros((len(own), 1))
                norms = (queries**2).sum(axis=1)
                for j, q in enumerate(queries):
                    least = np.abs(table - mine[j][:, None]).max(axis=0)
                    bound = (norms[j] + most - least**2) / 2
                    best_ids[j], best[j] = best_of(q, bound, ids, vectors, own[j], k, (best_ids[j], best[j]))
        for own, best_ids, best in held.values():
            real = best > -np.inf
            columns = [np.repeat(own, real.sum(axis=1)), best_ids[real], best[real].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of ``vectors`` (vec_id, embedding) per query."""
    spark = vectors.sparkSession
    rows = valid(vectors).select("vec_id", "embedding")
    blocks = stored(rows.mapInArrow(task(_blocks(INDEX_ROWS)), _BLOCK), **ROW_GROUPS)
    most = blocks.agg(F.max("most")).first()[0] or 0
    # The pivots are a sample of fixed size; those of another length than a block's are of no use to it.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("embedding").collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in {len(r[0]) for r in sample}:
        pivots[dim] = np.floor(256 * np.array([r[0] for r in sample if len(r[0]) == dim], float).reshape(-1, dim))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dim, data, count in zip(
                batch.column("dim").to_pylist(), batch.column("vectors").to_pylist(),
                pc.binary_length(batch.column("ids")).to_pylist(), strict=True,
            ):
                x = unpacked(data, count // 8, dim)
                out.append(lifted(x, pivots[dim], most, query=False).T.tobytes() if dim in pivots else b"")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "distances"]
            )

    # Blocks are dealt evenly, for the input's files may be few: what is stored together is searched by one task.
    parts = max(1, spark.sparkContext.defaultParallelism)
    index = stored(blocks.repartition(parts).mapInArrow(task(measured), _BLOCK + ", distances binary"), **ROW_GROUPS)
    asked = rows.filter(is_query).coalesce(parts).mapInArrow(task(_blocks(QUERY_ROWS)), _BLOCK)
    queries = stored(asked.repartition(parts), **ROW_GROUPS)
    # Without the hint the smaller side would be broadcast, or all blocks of one dimension be dealt to one task.
    sent = queries.select(
        "dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")
    )
    met = index.drop("most").join(sent.hint("shuffle_replicate_nl"), "dim")
    found = met.mapInArrow(task(_search(k, most, pivots)), _FOUND)
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e))
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
where rank <= 5
"""
