"""Statistics of sliding windows without one copy of a pane per window.

Windows end at every pane end. A pane counts from its own end until ``length`` after its start, so sums are
running sums of what panes bring and take away. A wallet is counted from its pane until it has had none
for ``length``: from a pane to the wallet's next one, or to the pane's expiry, whichever is first. Every pane of
a wallet is thus a fixed number of +/- events, combined per (mint, time) on the map side, whatever the ratio
of window to pane. A running sum per mint, over at most a few rows per pane of time, gives the statistics; they
are constant between two events, and only there, above all shuffles, is a row made for each window end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.columns import wide
from flowlens.operators.lookups import lookup_join, top_per_key
from flowlens.session import materialize

# Wallets listed per pane and wanted wallet; what is not listed is bounded by the next one's volume.
LISTED_PER_WANTED = 8
LISTED_LEAST = 32


def check_length(pane: int, length: int) -> None:
    if length % pane or length < pane:
        raise ValueError("window length must be a whole number of panes")


def _next_pane(has: Column) -> Column:
    """Start of the wallet's next pane for which ``has`` holds (rows of a wallet, newest first)."""
    newest = Window.partitionBy("mint", "user_wallet").orderBy(F.desc("pane"))
    return F.last(F.when(has, F.col("pane")), ignorenulls=True).over(
        newest.rowsBetween(Window.unboundedPreceding, -1)
    )


_EVENT = ("buys", "sells", "lamports", "buyers", "sellers", "fresh", "held")


def _event(at: Column, **deltas: Column | int) -> Column:
    values = {k: deltas.get(k, F.lit(0)) for k in _EVENT}
    kinds = {"lamports": "decimal(38,0)"}
    return F.struct(at.alias("at"), *[F.lit(v).cast(kinds.get(k, "bigint")).alias(k) for k, v in values.items()])


def sliding_totals(
    panes: DataFrame, pane: int, length: int, volume: Column, seen: DataFrame | None = None
) -> DataFrame:
    """Counts, distinct wallets, volume and new wallets per (mint, win_end).

    ``panes``: one row per (mint, pane, user_wallet) with buys and sells; ``volume``: its lamports. ``seen``:
    (user_wallet, first_seen); a wallet of the window is new if that is not before the window's start.
    Without it ``new_wallet_count`` is left out.
    """
    check_length(pane, length)
    rows = panes.select("mint", "pane", "user_wallet", "buys", "sells", wide(volume).alias("lamports"))
    buy, sell = F.col("buys") > 0, F.col("sells") > 0
    rows = rows.withColumns({"_buy": _next_pane(buy), "_sell": _next_pane(sell), "_any": _next_pane(F.lit(True))})
    start, gone = F.col("pane") + pane, F.col("pane") + pane + length

    def until(following: str) -> Column:
        return F.least(gone, F.col(following) + pane)  # ``least`` skips a null: no next pane

    events = [
        _event(start, buys=F.col("buys"), sells=F.col("sells"), lamports=F.col("lamports"),
               buyers=buy.cast("int"), sellers=sell.cast("int"), held=1),
        _event(gone, buys=-F.col("buys"), sells=-F.col("sells"), lamports=-F.col("lamports"), held=-1),
        F.when(buy, _event(until("_buy"), buyers=-1)),
        F.when(sell, _event(until("_sell"), sellers=-1)),
    ]
    if seen is not None:
        rows = lookup_join(rows, seen.select("user_wallet", "first_seen"), ["user_wallet"], salts=1)
        # The last window end, as a multiple of the pane, at which the wallet is still new; then one pane more.
        last = (F.floor((F.col("first_seen") + length) / pane) * pane).cast("bigint") + pane
        end = F.least(until("_any"), last)
        new = F.coalesce(end > start, F.lit(False))
        events += [F.when(new, _event(start, fresh=1)), F.when(new, _event(end, fresh=-1))]
    changes = rows.select("mint", F.explode(F.array(*events)).alias("e")).filter("e is not null").select("mint", "e.*")
    changes = changes.groupBy("mint", "at").agg(*[F.sum(c).alias(c) for c in _EVENT])
    order = Window.partitionBy("mint").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = changes.select(
        "mint", "at", F.lead("at").over(order).alias("next"), *[F.sum(c).over(so_far).alias(c) for c in _EVENT]
    ).filter(F.col("held") > 0)
    ends = F.sequence(F.col("at"), F.col("next") - pane, F.lit(pane).cast("bigint"))
    return running.select(
        "mint", F.explode(ends).alias("win_end"), F.col("buys").alias("buy_count"), F.col("sells").alias("sell_count"),
        F.col("buyers").alias("unique_buyers"), F.col("sellers").alias("unique_sellers"),
        F.col("lamports").cast("decimal(38,0)").alias("volume_lamports"),
        *([F.col("fresh").alias("new_wallet_count")] if seen is not None else []),
    )


def sliding_peaks(panes: DataFrame, pane: int, length: int) -> DataFrame:
    """Counts and volume of each window, and distinct wallets as its largest single pane.

    ``panes``: one row per (mint, pane), as made by ``window_totals``. Range frames over them are reduced rows
    already; windows without a pane of their own end follow from the runs between events.
    """
    check_length(pane, length)
    rows = panes.select("mint", "pane", "buy_count", "sell_count", "unique_buyers", "unique_sellers", "volume_lamports")
    start = rows.select("mint", (F.col("pane") + pane).alias("at"))
    gone = rows.select("mint", (F.col("pane") + pane + length).alias("at"))
    marks = start.unionByName(gone).distinct().withColumn("pane", F.lit(None).cast("bigint"))
    # A mark at ``at`` sees the panes whose ends lie in (at - length, at].
    both = rows.withColumn("at", F.col("pane") + pane).unionByName(marks, allowMissingColumns=True)
    frame = Window.partitionBy("mint").orderBy("at").rangeBetween(-(length - pane), 0)
    seen = both.select(
        "mint", "at", "pane",
        *[F.sum(c).over(frame).alias(c) for c in ("buy_count", "sell_count", "volume_lamports")],
        *[F.max(c).over(frame).alias(c) for c in ("unique_buyers", "unique_sellers")],
    ).filter("pane is null")
    order = Window.partitionBy("mint").orderBy("at")
    held = seen.withColumn("next", F.lead("at").over(order)).filter("buy_count is not null")
    ends = F.sequence(F.col("at"), F.col("next") - pane, F.lit(pane).cast("bigint"))
    return held.select(
        "mint", F.explode(ends).alias("win_end"), "buy_count", "sell_count", "unique_buyers", "unique_sellers", "volume_lamports"
    )


# --- largest wallets ---------------------------------------------------------------------------


def _window_sums(panes: DataFrame, pane: int, length: int) -> DataFrame:
    """Volume of every wallet in each of its windows: mint, win_end, user_wallet, lamports.

    A wallet's volume is constant between the panes that enter and leave, so its rows up to here are two per pane.
    """
    moves = F.array(
        F.struct((F.col("pane") + pane).alias("at"), F.col("lamports").alias("d"), F.lit(1).alias("h")),
        F.struct((F.col("pane") + pane + length).alias("at"), (-F.col("lamports")).alias("d"), F.lit(-1).alias("h")),
    )
    keys = ["mint", "user_wallet"]
    steps = panes.select(*keys, F.explode(moves).alias("m")).select(*keys, "m.*")
    steps = steps.groupBy(*keys, "at").agg(F.sum("d").alias("d"), F.sum("h").alias("h"))
    order = Window.partitionBy(*keys).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = steps.select(
        *keys, "at", F.lead("at").over(order).alias("next"),
        F.sum("d").over(so_far).cast("decimal(38,0)").alias("lamports"), F.sum("h").over(so_far).alias("held"),
    ).filter("held > 0")
    ends = F.sequence(F.col("at"), F.col("next") - pane, F.lit(pane).cast("bigint"))
    return runs.select("mint", F.explode(ends).alias("win_end"), "user_wallet", "lamports")


def _largest(sums: DataFrame, n: int) -> DataFrame:
    return top_per_key(sums, ["mint", "win_end"], [F.desc("lamports"), F.asc("user_wallet")], n)


def sliding_top_wallets(
    panes: DataFrame, pane: int, length: int, n: int, volume: Column, listed: int | None = None
) -> DataFrame:
    """The ``n`` wallets of largest volume per (mint, win_end), ties by wallet: exact, by candidates.

    Each pane lists its ``listed`` largest wallets; any other has at most the volume of the next one there. Only wallets
    that some pane lists get their window sums. A window's list is proven where its n-th sum is larger than the
    bounds of its panes together, or where its panes list every wallet. In the windows left over, if any, all wallets
    are summed, and those that reach the n-th sum of the listed ones are ranked. Volumes must not be negative.
    """
    check_length(pane, length)
    listed = listed or max(LISTED_LEAST, LISTED_PER_WANTED * n)
    rows = panes.select("mint", "pane", "user_wallet", wide(volume).alias("lamports"))
    if length == pane:
        return _largest(rows.withColumn("win_end", F.col("pane") + pane).drop("pane"), n)
    order = [F.desc("lamports"), F.asc("user_wallet")]
    heads, _ = materialize(top_per_key(rows, ["mint", "pane"], order, listed + 1))
    some = heads.filter(F.col("rank") <= listed).select("mint", "user_wallet").distinct()
    found, _ = materialize(_largest(_window_sums(rows.join(some, ["mint", "user_wallet"], "left_semi"), pane, length), n))
    cut = heads.filter(F.col("rank") > listed).select("mint", "pane", "lamports")
    if cut.isEmpty():  # every pane lists all its wallets
        return found
    none = F.lit(0)
    bounds = cut.select("mint", "pane", none.alias("buys"), none.alias("sells"), F.lit("").alias("user_wallet"), "lamports")
    bounds = sliding_totals(bounds, pane, length, F.col("lamports")).select("mint", "win_end", F.col("volume_lamports").alias("_bound"))
    last = found.filter(F.col("rank") == n).select("mint", "win_end", F.col("lamports").alias("_last"))
    open_, _ = materialize(
        bounds.join(last, ["mint", "win_end"], "left")
        .filter(F.col("_bound") >= F.coalesce("_last", F.lit(-1)))
        .select("mint", "win_end", F.coalesce("_last", F.lit(-1)).alias("_last"))
    )
    if open_.isEmpty():
        return found
    # Only panes that lie in a window left over are read again: those whose ends are at most a length before it.
    near = open_.select("mint", (F.floor(F.col("win_end") / length)).cast("bigint").alias("_span"))
    spans = near.unionByName(near.withColumn("_span", F.col("_span") - 1)).distinct()
    again = rows.withColumn("_span", F.floor((F.col("pane") + pane) / length).cast("bigint"))
    again = again.join(spans, ["mint", "_span"], "left_semi").drop("_span")
    # ``n`` listed wallets have ``_last`` or more there, so whoever has less needs no place in the ranking.
    asked = lookup_join(_window_sums(again, pane, length), open_, ["mint", "win_end"], "inner")
    rest = _largest(asked.filter("lamports >= _last").drop("_last"), n)
    return found.join(open_, ["mint", "win_end"], "left_anti").unionByName(rest)
