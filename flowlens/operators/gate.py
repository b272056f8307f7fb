"""First-sight gate: after an event passes, its key is closed for a time to live.

Used for duplicate removal by key, alert cool-down, hot periods and wallet first-seen.

Events are first reduced to whole seconds. An event at least a TTL after the previous *event* of its
key always passes, so events fall into runs, found by comparing neighbours within time segments, and a
run shorter than the TTL passes its first event only. That settles keys that do not recur, such as
signatures, without Python. Which events of a longer run pass depends on the last one that passed; such
a run still splits: every segment works out in parallel where each possible entry would leave it, a
short chain over the segments fixes the true entries, and a second parallel pass marks the events. A
segment holds at most as many rows as it has seconds, however hot its key is. Null keys are keys.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.columns import bucket_start
from flowlens.session import materialize

SEGMENT_ROWS = 1_000_000
SEGMENT_TTLS = 64
# A threshold before all times.
NEVER = -(1 << 62)


def segment_seconds(ttl: int) -> int:
    """Segment length: several TTLs, but no more seconds than one task holds with ease."""
    return ttl * max(1, min(SEGMENT_TTLS, SEGMENT_ROWS // ttl))


# --- whole groups of a sorted partition, all at once --------------------------------------------


def _breaks(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Rows at which one of the columns differs from the row before; the first row counts. Nulls are equal."""
    n = table.num_rows
    out = np.zeros(n, dtype=bool)
    out[:1] = True
    for name in names:
        column = table.column(name).combine_chunks()
        a, b = column.slice(0, n - 1), column.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        empty = pc.is_null(column).to_numpy(zero_copy_only=False)
        out[1:] |= differ | (empty[1:] != empty[:-1])
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.Table]:
    """Tables that end with a group; the rows of an open group wait for the next batch."""
    held: list[pa.RecordBatch] = []
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        if rest is not None:
            table = pa.concat_tables([rest, table])
        cut = int(np.flatnonzero(_breaks(table, names))[-1])
        held, rest = [], table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if rest is not None:
        yield rest


class _Segments:
    """Seconds of many (key, segment) groups side by side: row ``i`` lies at ``line[i]``, and groups lie so far apart
    that a TTL never reaches the next one."""

    def __init__(self, starts: np.ndarray, seg: np.ndarray, times: np.ndarray, ttl: int) -> None:
        n = len(times)
        self.group = np.cumsum(starts) - 1
        self.first = np.flatnonzero(starts)
        self.end = np.append(self.first[1:], n)[self.group]
        self.base = self.group * (segment_seconds(ttl) + ttl + 1)
        self.line = self.base + (times - seg)
        # The first event that may pass after this one has, if the segment has it.
        self.following = np.searchsorted(self.line, self.line + ttl)

    def last_pass(self) -> np.ndarray:
        """Row of the segment's last pass, if this row passes."""
        own = np.arange(len(self.line))
        step = np.where(self.following < self.end, self.following, own)
        while not np.array_equal(further := step[step], step):  # twice as far each time
            step = further
        return step

    def passes(self, entry: np.ndarray) -> np.ndarray:
        """Mask of passing rows; ``entry`` is the first passing row of each group (its end: none)."""
        out = np.zeros(len(self.line), dtype=bool)
        now = entry[entry < self.end[self.first]] if len(entry) else entry
        while len(now):
            out[now] = True
            ahead = self.following[now]
            now = ahead[ahead < self.end[now]]
        return out


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which null keys are equal; keeps the left side's keys."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def _runs(seconds: DataFrame, keys: Sequence[str], ttl: int) -> DataFrame:
    """``seconds`` with ``_start`` (a TTL or more after the event before) and ``_run``, its run's start.

    Neighbours are compared within (key, segment); what a segment needs of those before it is one row
    per segment.
    """
    within = Window.partitionBy(*keys, "_seg").orderBy("_t")
    sofar = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = Window.partitionBy(*keys).orderBy("_seg")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    segments = seconds.groupBy(*keys, "_seg").agg(F.max("_t").alias("_last"))
    segments = segments.withColumn("_before", F.lag("_last").over(over)).drop("_last")
    previous = F.coalesce(F.lag("_t").over(within), F.col("_before"))
    marked = _join(seconds, segments, [*keys, "_seg"]).withColumn(
        "_start", F.coalesce(F.col("_t") - previous >= ttl, F.lit(True))
    )
    starts = marked.groupBy(*keys, "_seg").agg(F.max(F.when(F.col("_start"), F.col("_t"))).alias("_in"))
    starts = starts.withColumn("_earlier", F.last("_in", ignorenulls=True).over(before)).drop("_in")
    own = F.last(F.when(F.col("_start"), F.col("_t")), ignorenulls=True).over(sofar)
    return (
        _join(marked.withColumn("_own", own), starts, [*keys, "_seg"])
        .withColumn("_run", F.coalesce("_own", "_earlier"))
        .drop("_before", "_own", "_earlier")
    )


def first_sight(
    events: DataFrame,
    keys: Sequence[str],
    time: str,
    ttl: int,
    order: Sequence[str] = (),
    carry: Sequence[str] = (),
) -> DataFrame:
    """Events that pass the gate: one per key, then none for ``ttl`` seconds from that pass.

    ``time`` is epoch seconds. Within one second the first by ``order`` stands for all. Returns
    ``keys``, ``time`` and the columns ``carry`` of the passing event.
    """
    keys, carry = list(keys), list(carry)
    length = segment_seconds(ttl)
    rank = [c for c in order if c != time] or [time]
    second = F.col(time).cast("bigint").alias("_t")
    if not carry:
        seconds = events.select(*keys, second).distinct()
    elif carry == rank and len(carry) == 1:
        # A plain minimum stays in the hash aggregate; a struct would force a sort of the input.
        seconds = events.groupBy(*keys, second).agg(F.min(carry[0]).alias(carry[0]))
    else:
        kept = F.min_by(F.struct(*carry), F.struct(*rank)).alias("_carry")
        seconds = events.groupBy(*keys, second).agg(kept).select(*keys, "_t", "_carry.*")
    seconds, _ = materialize(seconds.withColumn("_seg", bucket_start(F.col("_t"), length)))
    rows, _ = materialize(_runs(seconds.select(*keys, "_seg", "_t"), keys, ttl))
    passed = rows.filter("_start").select(*keys, "_t")
    late = rows.filter(F.col("_t") - F.col("_run") >= ttl).select(*keys, "_run").distinct()
    if not late.isEmpty():
        slim = _join(rows.select(*keys, "_run", "_seg", "_t"), late, [*keys, "_run"], "left_semi")
        passed = passed.unionByName(_chained(slim, [*keys, "_run"], ttl).filter("_t > _run").drop("_run"))
    if not carry:
        return passed.withColumnRenamed("_t", time)
    return _join(seconds, passed, [*keys, "_t"], "left_semi").select(
        *keys, F.col("_t").alias(time), *carry
    )


def _chained(slim: DataFrame, keys: Sequence[str], ttl: int) -> DataFrame:
    """Passing seconds (``keys``, ``_t``) of runs longer than the TTL, from (keys, ``_seg``, ``_t``).

    Python sees sorted partitions and works out all their groups at once; no call is made per key or run.
    """
    key_fields = [f for f in slim.schema if f.name in keys]
    names = [f.name for f in key_fields]
    groups = [*names, "_seg"]

    def longs(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy().astype(np.int64)

    def rows_at(table: pa.Table, rows: np.ndarray, columns: Sequence[str], **new: np.ndarray) -> pa.RecordBatch:
        taken = table.select(columns).take(pa.array(rows))
        arrays = [taken.column(c).combine_chunks() for c in columns] + [pa.array(v, pa.int64()) for v in new.values()]
        return pa.RecordBatch.from_arrays(arrays, names=[*columns, *new])

    def entry_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per segment: entry thresholds and the last pass they lead to."""
        for table in _whole_groups(batches, groups):
            seg, times = longs(table, "_seg"), longs(table, "_t")
            held = _Segments(_breaks(table, groups), seg, times, ttl)
            leave = times[held.last_pass()]
            # An entry lies in the first TTL of the segment or is the first event after it.
            early = times < seg + ttl
            after = np.append(False, early[:-1])
            after[held.first] = True
            at = np.flatnonzero(early | after)
            last = np.append((held.group[at][1:] != held.group[at][:-1]) | (leave[at][1:] != leave[at][:-1]), True)
            at = at[last] if len(at) else at
            yield rows_at(table, at, groups, _upto=times[at], _leave=leave[at])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """True threshold of each segment: a step per segment, not per event."""
        now, last = NEVER, None
        for table in _whole_groups(batches, groups):
            # A key may go on in the next table: its first row says whether it is a new key.
            fresh = _breaks(table, names)
            at = np.flatnonzero(_breaks(table, groups))
            ends = np.append(at[1:], table.num_rows).tolist()
            upto, leave, new = longs(table, "_upto").tolist(), longs(table, "_leave").tolist(), fresh[at].tolist()
            key = [table.column(n)[0].as_py() for n in names]
            new[0] = key != last
            thresholds = []
            for a, b, first in zip(at.tolist(), ends, new, strict=True):
                now = NEVER if first else now
                thresholds.append(now)
                hit = bisect_left(upto, now, a, b)
                if hit < b:
                    now = leave[hit] + ttl
            last = [table.column(n)[table.num_rows - 1].as_py() for n in names]
            yield rows_at(table, at, groups, _t=np.array(thresholds, np.int64))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each group is its threshold, the others its events."""
        for table in _whole_groups(batches, groups):
            starts, seg, times = _breaks(table, groups), longs(table, "_seg"), longs(table, "_t")
            event = ~starts
            threshold = np.maximum(times[starts], seg[starts])
            group = (np.cumsum(starts) - 1)[event]
            if not len(group):
                continue
            first = np.append(True, group[1:] != group[:-1])
            held = _Segments(first, seg[event], times[event], ttl)
            wanted = held.base[held.first] + np.minimum(threshold[group[first]] - seg[event][first], segment_seconds(ttl))
            passed = held.passes(np.searchsorted(held.line, wanted))
            yield rows_at(table, np.flatnonzero(event)[passed], [*names, "_t"])

    def schema(*extra: str) -> T.StructType:
        return T.StructType(key_fields + [T.StructField(n, T.LongType()) for n in extra])

    dealt = slim.select(*groups, "_t").repartition(*groups).sortWithinPartitions(*groups, "_t")
    maps = dealt.mapInArrow(entry_map, schema("_seg", "_upto", "_leave"))
    ordered = maps.repartition(*names).sortWithinPartitions(*groups, "_upto")
    entries = ordered.mapInArrow(chain, schema("_seg", "_t"))
    both = entries.withColumn("_kind", F.lit(0)).unionByName(slim.select(*groups, "_t").withColumn("_kind", F.lit(1)))
    beside = both.repartition(*groups).sortWithinPartitions(*groups, "_kind", "_t").drop("_kind")
    return beside.mapInArrow(mark, schema("_t"))
