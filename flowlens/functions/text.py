"""Text columns for reports and alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions.columns import fixed


def short_signature(signature: Column) -> Column:
    return F.concat(F.substring(signature, 1, 16), F.lit("..."))


def short_wallet(wallet: Column) -> Column:
    return F.concat(F.substring(wallet, 1, 8), F.lit("..."), F.right(wallet, F.lit(4)))


def _scaled(value: Column, prefix: str = "", plain_places: int = 2) -> Column:
    return (
        F.when(value.isNull(), F.lit("N/A"))
        .when(value >= 1e6, F.concat(F.lit(prefix), fixed(value / 1e6, 1), F.lit("M")))
        .when(value >= 1e3, F.concat(F.lit(prefix), fixed(value / 1e3, 1), F.lit("K")))
        .otherwise(F.concat(F.lit(prefix), fixed(value, plain_places)))
    )


def sol_text(value: Column) -> Column:
    """SOL with K/M from one thousand on."""
    return _scaled(value)


def usd_text(value: Column) -> Column:
    """Dollars with K/M from one thousand on."""
    return _scaled(value, "$")


def gain_text(value: Column) -> Column:
    """A fraction as signed whole percent."""
    sign = F.when(value >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.when(value.isNull(), F.lit("N/A")).otherwise(
        F.concat(sign, fixed(value * 100, 0), F.lit("%"))
    )


def ratio_text(ratio: Column) -> Column:
    """Buy/sell ratio in words."""
    finite = F.when(ratio <= 1000, ratio)
    return (
        F.when(ratio > 1000, F.lit("ALL BUYS (no sells)"))
        .when(ratio > 100, F.concat(fixed(finite, 0), F.lit("x (almost no sells)")))
        .when(ratio > 10, F.concat(fixed(finite, 0), F.lit("x")))
        .otherwise(F.concat(fixed(finite, 1), F.lit("x")))
    )


def mcap_text(mcap_sol: Column, sol_usd: float = 200.0) -> Column:
    """Market cap in dollars."""
    usd = mcap_sol * F.lit(sol_usd)
    return (
        F.when(usd >= 1e6, F.concat(F.lit("$"), fixed(usd / 1e6, 1), F.lit("M")))
        .when(usd >= 1e3, F.concat(F.lit("$"), fixed(usd / 1e3, 0), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), fixed(usd, 0)))
    )


def duration_text(seconds: Column) -> Column:
    """Seconds in the largest fitting unit."""
    return (
        F.when(seconds < 60, F.concat(fixed(seconds, 0), F.lit("s")))
        .when(seconds < 3600, F.concat(fixed(seconds / 60, 0), F.lit("m")))
        .when(seconds < 86400, F.concat(fixed(seconds / 3600, 1), F.lit("h")))
        .otherwise(F.concat(fixed(seconds / 86400, 1), F.lit("d")))
    )


def report_date(text: Column, today: Column) -> Column:
    """Date of ``today``, ``yesterday``, ISO, month-first or day-first text; null if none fits."""
    word = F.lower(text)
    return (
        F.when(word == "today", today)
        .when(word == "yesterday", F.date_sub(today, 1))
        .otherwise(
            F.coalesce(
                *[
                    F.try_to_timestamp(text, F.lit(fmt)).cast("date")
                    for fmt in ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy")
                ]
            )
        )
    )


def finite_ratio(ratio: Column, cap: float = 999.0) -> Column:
    """Infinite or undefined ratios as ``cap``: safe for JSON."""
    return F.when(F.isnan(ratio) | (F.abs(ratio) == float("inf")), F.lit(cap)).otherwise(ratio)


def finite_or_null(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def safe_double(text: Column) -> Column:
    return text.cast("string").try_cast("double")
