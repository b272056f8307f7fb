"""Lists as of many times: the best entries of a key at each of its cases, from what changed in between.

Facts reduced to panes are dealt to the key's next case. Between two cases only the entries that changed can enter
the list, and of those only the best ``n``, because totals never fall: whoever has ``n`` better entries
among those changed with it keeps them ahead for good. So a case costs its changed panes once and ``n`` rows,
however many panes came before, and the lists follow from one ordered pass that holds ``n`` rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowlens.operators.lookups import lookup_join, top_per_key


def next_case(panes: DataFrame, cases: DataFrame, key: str = "mint", end: str = "win_end") -> DataFrame:
    """``panes`` (key, pane_end, ...) with the first ``end`` of the key's cases at or after ``pane_end``.

    Panes after the last case go. The search runs over one row per (key, pane end) and case.
    """
    asked = cases.select(key, F.col(end).cast("bigint").alias("_at"), F.lit(1).alias("_case")).distinct()
    times = panes.select(key, F.col("pane_end").cast("bigint").alias("_at"), F.lit(0).alias("_case")).distinct()
    later = Window.partitionBy(key).orderBy(F.desc("_at"), F.desc("_case")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asked.unionByName(times).withColumn(end, F.last(F.when(F.col("_case") == 1, F.col("_at")), ignorenulls=True).over(later))
    dealt = both.filter(f"_case = 0 and {end} is not null").select(key, F.col("_at").alias("pane_end"), end)
    return lookup_join(panes, dealt, [key, "pane_end"], "inner")


def running_totals(
    dealt: DataFrame, entry: Sequence[str], sums: Sequence[str], key: str = "mint", end: str = "win_end"
) -> DataFrame:
    """Totals of every entry at the cases at which it changed, from panes dealt by ``next_case``."""
    changed = dealt.groupBy(key, *entry, end).agg(*[F.sum(c).alias(c) for c in sums])
    so_far = Window.partitionBy(key, *entry).orderBy(end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = {c: changed.schema[c].dataType for c in sums}
    return changed.select(key, end, *entry, *[F.sum(c).over(so_far).cast(kinds[c]).alias(c) for c in sums])


def lists_as_of(
    changed: DataFrame, cases: DataFrame, entry: Sequence[str], order: Sequence[Column], n: int,
    key: str = "mint", end: str = "win_end",
) -> DataFrame:
    """The first ``n`` entries by ``order`` at each case, with their ``rank``.

    ``changed``: (key, end, entry, values): an entry's state from this case on, until it changes again. Ordering by
    ``order`` must never put an unchanged entry before one that has changed and was before it. Without
    ``entry`` every row is an entry of its own.

    Rows are cut to ``n`` per (key, case) before they are dealt by key, and every row carries its places in the
    list's order, so the pass itself compares two numbers. A case of a key without rows has no list.
    """
    best = top_per_key(changed, [key, end], order, n).drop("rank")
    fields = [c for c in best.columns if c not in (key, end)]
    # Place of each row among all rows of the key; the pass needs nothing else to compare.
    placed = best.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint"))
    marks = cases.select(key, F.col(end).cast("bigint").alias(end)).distinct()
    rows = placed.withColumn(end, F.col(end).cast("bigint")).unionByName(marks, allowMissingColumns=True)
    rows = rows.repartition(key).sortWithinPartitions(key, end, F.col("_place").asc_nulls_last())
    id_of = F.struct(*entry) if entry else F.struct("_place")
    slim = rows.select(key, end, "_place", F.xxhash64(F.to_json(id_of)).alias("_entry"), F.struct(*fields).alias("_row"))
    schema = StructType([slim.schema[key], slim.schema[end], slim.schema["_row"], StructField("rank", LongType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks follow the rows of their case; ``held`` is the list so far."""
        now, held = None, {}
        for batch in batches:
            table: dict[str, list] = {"key": [], "end": [], "row": [], "rank": []}
            keys, ends = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            places, entries, values = (batch.column(i).to_pylist() for i in (2, 3, 4))
            for k, at, place, who, row in zip(keys, ends, places, entries, values, strict=True):
                if k != now:
                    now, held = k, {}
                if place is not None:
                    held[who] = (place, row)
                    continue
                first = sorted(held.items(), key=lambda x: x[1][0])[:n]
                held = dict(first)
                table["key"] += [k] * len(first)
                table["end"] += [at] * len(first)
                table["row"] += [row for _, (_, row) in first]
                table["rank"] += range(1, len(first) + 1)
            kinds = [batch.schema.field(0).type, batch.schema.field(1).type, batch.schema.field(4).type, pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(table.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, end, "_row", "rank"])

    merged = slim.mapInArrow(merge, schema)
    return merged.select(key, end, *[F.col(f"_row.{f}").alias(f) for f in fields], F.col("rank").cast("int").alias("rank"))
