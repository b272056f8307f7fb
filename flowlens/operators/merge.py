"""Keyed table changes on immutable files: insert-ignore, upsert, update by key, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.lookups import top_per_key


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``."""
    return top_per_key(rows, keys, order, 1, "_rank").drop("_rank")


def insert_ignore(
    target: DataFrame | None, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """New rows to append: the first per key among ``rows`` whose key ``target`` does not hold."""
    new = first_per_key(rows, keys, order)
    if target is None:
        return new
    return new.join(target.select(*keys), list(keys), "left_anti")


def upsert(
    target: DataFrame,
    changes: DataFrame,
    key: str,
    overwrite: Sequence[str] = (),
    fill: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """The table after merging ``changes`` (one row per key).

    ``overwrite`` columns take the change as it is, ``fill`` columns keep the old value where the
    change has none, ``keep`` columns are set only on insert.
    """
    old, new = target.alias("o"), changes.alias("n")
    changed = F.col(f"n.{key}").isNotNull()

    def pick(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in overwrite:
            return F.when(changed, n).otherwise(o)
        if c in fill:
            return F.coalesce(n, o)
        return F.when(F.col(f"o.{key}").isNotNull(), o).otherwise(n)

    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(
        F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key),
        *[pick(c).alias(c) for c in [*overwrite, *fill, *keep]],
    )


def update_by_key(
    target: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """The table with ``columns`` replaced where ``changes`` has the key; unknown keys do nothing."""
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(renamed, key, "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in target.columns
        ]
    )


def retained(rows: DataFrame, time: str, now: int, max_age: int, bucket: int = 1) -> DataFrame:
    """Rows young enough to keep, judged by the end of their time bucket.

    With ``bucket`` the test is on the bucket's end, the way whole files of a bucketed log expire.
    """
    end = (F.floor(F.col(time) / bucket) + 1) * bucket if bucket > 1 else F.col(time)
    return rows.filter(end >= now - max_age)
