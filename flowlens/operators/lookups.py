"""Joins of a large side with a keyed table, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import materialize

# A keyed table below this planned size may be sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024
# Planned sizes are those of compressed files. Rows in memory take ten times as much and more, so only a table planned
# below this share of the limit is broadcast without being measured.
PLANNED_SHARE = 16
# A task's part of a keyed table below this size is kept as a hash table, so the facts are not sorted for the join.
HASHED_BYTES = 64 * 1024 * 1024


def shuffled(df: DataFrame, size: int) -> DataFrame:
    """``df`` (of ``size`` bytes in memory, no hot key) hinted for a join by shuffle: hashed where a task's part is small, else sorted."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("shuffle_hash" if size <= HASHED_BYTES * parts else "merge")


def planned_bytes(df: DataFrame) -> int:
    """Size Catalyst plans with (file sizes carried through the plan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def measured(table: DataFrame) -> tuple[DataFrame, int]:
    """``table`` written once, and its size in memory from its real rows.

    Without a cost model the planned size of an aggregate is that of its input, so ten keys would seem as
    large as the facts they were reduced from. Text counts with its real mean length.
    """
    table, _ = materialize(table)
    text = [f.name for f in table.schema if f.dataType.simpleString() == "string"]
    lengths = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(f"_{i}") for i, c in enumerate(text)]
    rows, *sums = table.agg(F.count("*"), *lengths).first()
    return table, int(rows * (16 + 16 * len(table.columns)) + sum(sums))


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    salts: int = 32,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``facts`` with ``table`` (one row per key).

    A table planned very small is broadcast. Any other is written first and measured: if it turns out
    small it is broadcast all the same, so a few hot keys never shuffle the facts. A larger one is never broadcast,
    also not by Spark's own choice, which goes by compressed files and does not see salted copies. One that is still
    small beside the facts is copied to ``salts`` salted partitions, over which the rows of a hot key are
    spread, so no task gets a whole hot key. Where the copies would outweigh the facts, or with
    ``salts=1``, it is a plain join and hot keys are left to the adaptive skew join, which splits the
    facts' side.
    """
    keys = list(keys)
    size = planned_bytes(table)
    if size <= broadcast_bytes // PLANNED_SHARE:
        return facts.join(F.broadcast(table), keys, how)
    if not facts.isStreaming and not table.isStreaming:
        table, size = measured(table)
        if size <= broadcast_bytes:
            return facts.join(F.broadcast(table), keys, how)
    if salts <= 1 or size * salts > planned_bytes(facts):
        measured_table = not facts.isStreaming and not table.isStreaming
        return facts.join(shuffled(table, size) if measured_table else table.hint("merge"), keys, how)
    spread = [c for c in facts.columns if c not in keys] or keys
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows per key.

    The filter right above ``row_number`` lets Spark cut each partition to ``n`` rows per key
    before the exchange, so a hot key sends ``n`` rows per task and not its whole group.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def first_known(
    facts: DataFrame, sources: Sequence[DataFrame], key: str, fields: Sequence[str], **join: object
) -> DataFrame:
    """Per field: the fact's own value where it has one, else the first source that knows it.

    Empty text counts as unknown. Every source has one row per key.
    """
    out = facts
    for field in fields:
        if field not in facts.columns:
            out = out.withColumn(field, F.lit(None).cast("string"))
    for i, source in enumerate(sources):
        have = [f for f in fields if f in source.columns]
        renamed = source.select(key, *[F.col(f).alias(f"_{i}_{f}") for f in have])
        out = lookup_join(out, renamed, [key], "left", **join)
        for field in have:
            known = F.when(F.col(field) != "", F.col(field))
            out = out.withColumn(field, F.coalesce(known, F.col(f"_{i}_{field}")))
        out = out.drop(*[f"_{i}_{f}" for f in have])
    return out


def first_source(
    keys: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str, value: str
) -> DataFrame:
    """``value`` of the first source that has it, with the source's name."""
    out = keys
    names = []
    for i, (name, source) in enumerate(sources):
        column = f"_{i}_{value}"
        out = lookup_join(out, source.select(key, F.col(value).alias(column)), [key], "left")
        names.append((name, column))
    chosen = F.coalesce(*[F.col(c) for _, c in names])
    label = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in names])
    return out.select(*keys.columns, chosen.alias(value), label.alias("source"))
