"""Stateful streams over keys that recur: the first-sight gate and the as-of lookup.

Rows of a key wait in its state until the watermark has passed them and are then taken in time order, so late and
unordered micro-batches give what the batch operators give. An event-time timer per key does that;
another clears the key when nothing of it can matter any more, so a quiet key has no state. What a key holds is
bounded by its distinct seconds within the lateness, however busy it is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowlens.streaming.jobs import event_time

# Rows for which this column is true belong to no key and only move the watermark.
CLOCK = "is_clock"


def with_clock(rows: DataFrame, at: DataFrame, time: str) -> DataFrame:
    """``rows`` and one row that carries the watermark beyond their end (for runs that stop)."""
    tick = at.select(F.col(time), F.lit(True).alias(CLOCK))
    return rows.withColumn(CLOCK, F.lit(False)).unionByName(tick, allowMissingColumns=True)


SECOND = T.StructField("second", T.LongType())


def _text(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def _packed(columns: Sequence[str]) -> Column:
    """The columns as one text, so that nulls and long integers wait and come back as they were."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("{}")


def _unpacked(text: str, schema: T.StructType) -> list[Column]:
    return [F.from_json(text, schema)[f.name].alias(f.name) for f in schema.fields]


class _Waiting(StatefulProcessor):
    """Rows (``second``, others) wait as columns of arrays beside the fields of ``kept``."""

    def __init__(self, fields: Sequence[T.StructField], kept: Sequence[T.StructField]) -> None:
        self.fields = list(fields)
        self.kept = list(kept)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        lists = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.fields]
        self.state = handle.getValueState("waiting", T.StructType([*self.kept, *lists]))

    def close(self) -> None:
        pass

    def start(self) -> tuple:
        """Fields of a key that has no state."""
        raise NotImplementedError

    def take(self, key: tuple, kept: tuple, due: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        """(fields after the rows ``due``, in order; rows to emit)"""
        raise NotImplementedError

    def until(self, kept: tuple) -> int | None:
        """Second at which the fields stop to matter; None: they don't matter now."""
        raise NotImplementedError

    def arrived(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows reduced as they come in."""
        return rows

    def _load(self) -> tuple[tuple, pd.DataFrame]:
        names = [f.name for f in self.fields]
        if not self.state.exists():
            return self.start(), pd.DataFrame({n: pd.Series(dtype=object) for n in names})
        value = self.state.get()
        n = len(self.kept)
        return tuple(value[:n]), pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(names, value[n:], strict=True)})

    def _save(self, kept: tuple, rows: pd.DataFrame) -> None:
        due = [int(rows["second"].min())] if len(rows) else []
        end = self.until(kept)
        due += [end] if end is not None else []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not due:
            self.state.clear()
            return
        self.state.update((*kept, *[rows[f.name].tolist() for f in self.fields]))
        self.handle.registerTimer(min(due) * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept, held = self._load()
        new = pd.concat(list(rows))
        if CLOCK in new:
            new = new[~new[CLOCK].astype(bool)]
        names = [f.name for f in self.fields]
        if len(new):
            self._save(kept, self.arrived(pd.concat([held, new[names].astype(object)], ignore_index=True)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept, held = self._load()
        now = timerValues.getCurrentWatermarkInMs() // 1000
        due = held["second"].astype("int64") <= now if len(held) else pd.Series([], dtype=bool)
        kept, out = self.take(key, kept, held[due])
        end = self.until(kept)
        if end is not None and end <= now:
            kept = self.start()
        self._save(kept, held[~due])
        if len(out):
            yield out


# --- gate --------------------------------------------------------------------------------------


class _Gate(_Waiting):
    """Passing seconds of a key; ``last`` is the one that closed it."""

    def __init__(self, ttl: int, keys: Sequence[str]) -> None:
        super().__init__([SECOND, _text("carried")], [T.StructField("last", T.LongType())])
        self.ttl, self.keys = ttl, list(keys)

    def start(self) -> tuple:
        return (None,)

    def until(self, kept: tuple) -> int | None:
        return None if kept[0] is None else int(kept[0]) + self.ttl

    def arrived(self, rows: pd.DataFrame) -> pd.DataFrame:
        def place(carried: str) -> tuple:  # nulls first
            return tuple((v is not None, v) for v in json.loads(carried).values())

        best: dict[int, str] = {}
        for t, carried in zip(rows["second"].tolist(), rows["carried"].tolist(), strict=True):
            if t not in best or place(carried) < place(best[t]):
                best[t] = carried
        return pd.DataFrame({"second": list(best), "carried": list(best.values())})

    def take(self, key: tuple, kept: tuple, due: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        last, passed = kept[0], []
        due = due.sort_values("second")
        for i, t in enumerate(due["second"].tolist()):
            if last is None or t - last >= self.ttl:
                passed.append(i)
                last = int(t)
        found = due.iloc[passed]
        table = {k: [v] * len(found) for k, v in zip(self.keys, key, strict=True)}
        return (last,), pd.DataFrame(table | {c: found[c].tolist() for c in ("second", "carried")})


def first_sight(
    events: DataFrame, keys: Sequence[str], time: str, ttl: int, carry: Sequence[str] = (), late: str = "10 minutes"
) -> DataFrame:
    """``operators.gate.first_sight`` of a stream: one event per key, then none for ``ttl`` seconds from it.

    Of events in one second the first by ``carry`` stands for all. Null keys are keys. An event is judged once the
    watermark has passed it; one that is later than ``late`` is dropped.
    """
    keys, carry = list(keys), list(carry)
    clock = F.col(CLOCK) if CLOCK in events.columns else F.lit(False)
    slim = events.select(*keys, F.col(time).cast("bigint").alias("second"), _packed(carry).alias("carried"), clock.alias(CLOCK))
    timed = event_time(slim, "second", late)
    schema = T.StructType([*[slim.schema[k] for k in keys], SECOND, _text("carried")])
    passed = timed.groupBy(*keys).transformWithStateInPandas(_Gate(ttl, keys), schema, "Append", "EventTime")
    carried = T.StructType([events.schema[c] for c in carry])
    return passed.select(*keys, F.col("second").alias(time), *_unpacked("carried", carried))


# --- as-of lookup ------------------------------------------------------------------------------


class _Latest(_Waiting):
    """Facts with the key's last value; values and facts wait together, values first at equal times."""

    def __init__(self, key: str, max_age: int) -> None:
        fields = [SECOND, T.StructField("tie", T.LongType()), T.StructField("fact_row", T.BooleanType()), _text("packed")]
        super().__init__(fields, [T.StructField("at", T.LongType()), _text("value")])
        self.key, self.max_age = key, max_age

    def start(self) -> tuple:
        return (None, None)

    def until(self, kept: tuple) -> int | None:
        return None if kept[0] is None else int(kept[0]) + self.max_age + 1

    def take(self, key: tuple, kept: tuple, due: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        at, value = kept
        out: dict[str, list] = {c: [] for c in (self.key, "fact", "value")}
        due = due.sort_values(["second", "fact_row", "tie"], kind="stable")
        for t, is_fact, packed in zip(due["second"], due["fact_row"], due["packed"], strict=True):
            if not is_fact:
                at, value = int(t), packed
                continue
            fresh = at is not None and t - at <= self.max_age
            out[self.key].append(key[0])
            out["fact"].append(packed)
            out["value"].append(value if fresh else None)
        return (at, value), pd.DataFrame(out)


def latest_before(
    facts: DataFrame, values: DataFrame, key: str, value: str, max_age: int, time: str = "block_time", tie: str = "slot",
    late: str = "10 minutes",
) -> DataFrame:
    """``operators.asof.latest_before`` of two streams: for each fact the key's last ``value`` at or before it and at
    most ``max_age`` seconds old. At equal times the value comes first, and of values the one with the larger ``tie``.

    ``facts``: key, ``time`` and other columns; ``values``: key, ``time``, ``tie``, ``value``.
    """
    rest = [f.name for f in facts.schema.fields if f.name not in (key, CLOCK)]
    clock = F.col(CLOCK) if CLOCK in facts.columns else F.lit(False)

    def waiting(rows: DataFrame, tie_order: Column, is_fact: bool, packed: Column, ticks: Column) -> DataFrame:
        second = F.col(time).cast("bigint")
        return rows.select(
            key, second.alias("second"), tie_order.cast("bigint").alias("tie"), F.lit(is_fact).alias("fact_row"),
            packed.alias("packed"), ticks.alias(CLOCK),
        )

    kept = F.struct(F.col(value).alias("value"), F.col(time).cast("bigint").alias("at"))
    known = values.filter(F.col(value).isNotNull())
    both = waiting(facts, F.lit(0), True, _packed(rest), clock).unionByName(
        waiting(known, F.col(tie), False, F.to_json(kept), F.lit(False))
    )
    schema = T.StructType([facts.schema[key], _text("fact"), _text("value")])
    found = event_time(both, "second", late).groupBy(key).transformWithStateInPandas(_Latest(key, max_age), schema, "Append", "EventTime")
    told = F.from_json("value", T.StructType([T.StructField("value", values.schema[value].dataType), T.StructField("at", T.LongType())]))
    return found.select(
        key, *_unpacked("fact", T.StructType([facts.schema[c] for c in rest])),
        told["value"].alias(value), told["at"].alias(f"{value}_time"),
    )
