"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.constants import LAMPORTS_PER_SOL
from flowlens.schema import AMOUNT


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body`` (row-local)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    Spark pushes filters through projections by repeating the projected expressions, which makes
    long row-local expressions run several times. A generator of one row stops that; it needs no
    shuffle and works on streams.
    """
    row = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*df.columns, F.inline_outer(row).alias(*columns))


def sol(lamports: Column) -> Column:
    """Whole lamports as SOL."""
    return lamports.cast("double") / F.lit(float(LAMPORTS_PER_SOL))


def wide(amount: Column) -> Column:
    """Widen before a sum that may pass the range of bigint."""
    return amount.cast(AMOUNT)


def ratio_or(num: Column, den: Column, otherwise: Column | float) -> Column:
    """``num / den`` as double, ``otherwise`` where ``den`` is zero or null."""
    if not isinstance(otherwise, Column):
        otherwise = F.lit(float(otherwise))
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), otherwise)


def fixed(value: Column, places: int) -> Column:
    """Decimal text with ``places`` digits, halves away from zero."""
    return F.round(value.cast("decimal(38,9)"), places).cast(f"decimal(38,{places})").cast("string")


def percent(value: Column) -> Column:
    """A share as whole percent text: 0.85 -> ``85%``."""
    return F.concat(fixed(value * 100, 0), F.lit("%"))


def day_text(epoch: Column) -> Column:
    """Calendar day (UTC) of epoch seconds, free of the session time zone."""
    days = F.floor(epoch / F.lit(86400)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")


def bucket_start(epoch: Column, seconds: int) -> Column:
    """Start of the bucket of ``seconds`` that holds ``epoch``."""
    return (F.floor(epoch / F.lit(seconds)) * F.lit(seconds)).cast("bigint")


def epoch_seconds(ntz: Column) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ntz)


def when_first(pairs: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first true test."""
    out = F
    for test, value in pairs:
        out = out.when(test, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
