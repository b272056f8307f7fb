"""Row-local trade inference from the balance changes of one transaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.constants import (
    CONFIDENCE_START,
    DEDUCT_BUSY_USER,
    DEDUCT_MANY_QUOTES,
    DEDUCT_MANY_TOKENS,
    DEDUCT_RENT_SIZED,
    LAMPORTS_PER_SOL,
    PROGRAMS,
    QUOTE_MINTS,
    TOKEN_ACCOUNT_RENT,
    WSOL,
)
from flowlens.functions.columns import let
from flowlens.schema import AMOUNT


def confidence_tenths(
    n_tokens: Column, n_quotes: Column, raw_lamports: Column, n_user_deltas: Column
) -> Column:
    """Confidence of a trade in tenths: whole numbers, so the 0.7 cut is exact."""

    def minus(test: Column, tenths: int) -> Column:
        return F.when(test, F.lit(tenths)).otherwise(F.lit(0))

    return F.greatest(
        F.lit(CONFIDENCE_START)
        - minus(n_tokens > 1, DEDUCT_MANY_TOKENS)
        - minus(n_quotes > 1, DEDUCT_MANY_QUOTES)
        - minus(F.abs(raw_lamports) == TOKEN_ACCOUNT_RENT, DEDUCT_RENT_SIZED)
        - minus(n_user_deltas > 3, DEDUCT_BUSY_USER),
        F.lit(0),
    )


def _leg(mint: Column, amount: Column) -> Column:
    # Smallest struct = largest amount, then first mint.
    return F.struct(
        (-F.abs(amount)).cast(AMOUNT).alias("rank"),
        mint.alias("mint"),
        F.abs(amount).cast(AMOUNT).alias("amount"),
    )


def _amount_of(sols: Column, user: Column) -> Column:
    hit = F.filter(sols, lambda s: s["account"] == user)
    return F.try_element_at(hit, F.lit(1))["delta"]


def _trades_of(user: Column, tokens: Column, merged: Column, raw: Column, payer: Column) -> Column:
    """Zero, one or two trades (buy, sell) that ``user`` may have made."""

    def trades(me: Column) -> Column:
        own, net = me["own"], me["net"]

        def legs(sign: int, quote: bool) -> Column:
            picked = F.filter(
                own,
                lambda t: (t["delta"] > 0 if sign > 0 else t["delta"] < 0)
                & (t["mint"].isin(*QUOTE_MINTS) if quote else ~t["mint"].isin(*QUOTE_MINTS)),
            )
            return F.transform(picked, lambda t: _leg(t["mint"], t["delta"]))

        def quote_legs(sign: int) -> Column:
            tokens_paid = legs(sign, quote=True)
            sol_paid = net > 0 if sign > 0 else net < 0
            return F.when(
                sol_paid, F.concat(F.array(_leg(F.lit(WSOL), net)), tokens_paid)
            ).otherwise(tokens_paid)

        def trade(side: str, sign: int) -> Column:
            both = F.struct(
                legs(sign, quote=False).alias("base"), quote_legs(-sign).alias("quote")
            )
            return let(both, lambda b: one_trade(side, b))

        def one_trade(side: str, b: Column) -> Column:
            best = F.struct(
                F.array_min(b["base"]).alias("base"), F.array_min(b["quote"]).alias("quote")
            )
            tenths = confidence_tenths(F.size(b["base"]), F.size(b["quote"]), me["raw"], F.size(own))
            found = let(
                best,
                lambda x: F.struct(
                    (-tenths).alias("minus_tenths"),
                    F.when(user == payer, F.lit(0)).otherwise(F.lit(1)).alias("not_payer"),
                    F.lit(0 if side == "buy" else 1).alias("side_rank"),
                    user.alias("user_wallet"),
                    F.lit(side).alias("side"),
                    x["base"]["mint"].alias("base_mint"),
                    x["base"]["amount"].alias("base_amount"),
                    x["quote"]["mint"].alias("quote_mint"),
                    x["quote"]["amount"].alias("quote_amount"),
                ),
            )
            return F.when((F.size(b["base"]) > 0) & (F.size(b["quote"]) > 0), found)

        return F.array_compact(F.array(trade("buy", 1), trade("sell", -1)))

    me = F.struct(
        F.filter(tokens, lambda t: (t["owner"] == user) & (t["mint"] != WSOL)).alias("own"),
        F.coalesce(_amount_of(merged, user), F.lit(0).cast(AMOUNT)).alias("net"),
        _amount_of(raw, user).alias("raw"),
    )
    return let(me, trades)


def trade_candidates(
    candidates: Column, tokens: Column, merged: Column, raw: Column, fee_payer: Column
) -> Column:
    """All trades the candidate users may have made, best first by the struct's own order:
    confidence, fee payer before others, buy before sell, wallet."""
    return F.flatten(
        F.transform(candidates, lambda u: _trades_of(u, tokens, merged, raw, fee_payer))
    )


def best_trade(trades: Column) -> Column:
    """The best of ``trade_candidates``; null where there is none."""
    return F.when(F.size(trades) > 0, F.array_min(trades))


def _venue_map() -> Column:
    pairs: list[Column] = []
    for program, (_, venue) in PROGRAMS.items():
        pairs += [F.lit(program), F.lit(venue)]
    return F.create_map(*pairs)


def known_programs(programs: Column) -> Column:
    return F.array_intersect(programs, F.array(*[F.lit(p) for p in PROGRAMS]))


def venue(programs: Column) -> Column:
    """Venue of the invoked programs, ``unknown`` where none is a trading program.

    Several venues in one transaction: the first in alphabetical order.
    """
    table = _venue_map()
    names = F.transform(known_programs(programs), lambda p: table[p])
    return F.coalesce(F.array_min(names), F.lit("unknown"))


def route_depth(programs: Column) -> Column:
    """Number of trading programs on the route, at least 1."""
    return F.greatest(F.lit(1), F.size(known_programs(programs)))


def quote_lamports(quote_mint: Column, quote_amount: Column, wsol: str = WSOL) -> Column:
    """The quote amount where it is SOL, else 0 (dollars are not converted)."""
    return F.when(quote_mint == wsol, quote_amount).otherwise(F.lit(0))


def mcap_sol(
    quote_mint: Column, quote_amount: Column, base_amount: Column, supply: Column, wsol: str = WSOL
) -> Column:
    """Market cap in SOL at the price of one trade: decimals of the token cancel out."""
    price = F.try_divide(
        quote_amount.cast("double") / F.lit(float(LAMPORTS_PER_SOL)), base_amount.cast("double")
    )
    return F.when(
        (quote_mint == wsol) & (base_amount > 0) & supply.isNotNull(),
        price * supply.cast("double"),
    )


def price_sol(quote_amount: Column, base_amount: Column, decimals: Column) -> Column:
    """Price of one whole token in SOL."""
    per_unit = F.try_divide(
        quote_amount.cast("double") / F.lit(float(LAMPORTS_PER_SOL)), base_amount.cast("double")
    )
    return per_unit * F.pow(F.lit(10.0), decimals)
