"""Row-local balance arithmetic on one transaction: no shuffle, so it also runs on streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.constants import (
    PLAIN_ACCOUNT_RENT,
    TOKEN_ACCOUNT_RENT,
    WSOL,
)
from flowlens.functions.columns import let
from flowlens.schema import AMOUNT, SOL_DELTA, TOKEN_DELTA


def empty_tokens() -> Column:
    return F.array().cast(f"array<{TOKEN_DELTA.simpleString()}>")


def empty_sols() -> Column:
    return F.array().cast(f"array<{SOL_DELTA.simpleString()}>")


def all_accounts(static: Column, writable: Column, readonly: Column) -> Column:
    """Static keys, then loaded writable, then loaded read-only accounts."""
    nothing = F.array().cast("array<string>")
    return F.concat(static, F.coalesce(writable, nothing), F.coalesce(readonly, nothing))


def parse_balances(balances: Column, nested: bool = False) -> Column:
    """Balance entries with a numeric amount; entries without owner or mint are dropped.

    ``nested`` reads ``ui_token_amount.amount`` first and falls back to the flat field.
    """

    def one(b: Column) -> Column:
        raw = b["amount"]
        if nested:
            raw = F.coalesce(b["ui_token_amount"]["amount"], raw)
        amount = F.coalesce(raw.try_cast(AMOUNT), F.lit(0).cast(AMOUNT))
        return F.struct(b["owner"].alias("owner"), b["mint"].alias("mint"), amount.alias("delta"))

    kept = F.filter(
        balances,
        lambda b: (F.coalesce(b["owner"], F.lit("")) != "")
        & (F.coalesce(b["mint"], F.lit("")) != ""),
    )
    return F.coalesce(F.transform(kept, one), empty_tokens())


def _last_per_key(entries: Column) -> Column:
    return F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.filter(entries, lambda o, j: j > i),
            lambda o: (o["owner"] == e["owner"]) & (o["mint"] == e["mint"]),
        ),
    )


def _negated(entries: Column) -> Column:
    return F.transform(
        entries,
        lambda e: F.struct(
            e["owner"].alias("owner"),
            e["mint"].alias("mint"),
            (-e["delta"]).cast(AMOUNT).alias("delta"),
        ),
    )


def _sum_tokens(entries: Column) -> Column:
    """One entry per (owner, mint). Entries that are that already are not summed; mints differ more often than owners."""
    distinct = F.array_distinct(
        F.transform(entries, lambda e: F.struct(e["mint"].alias("m"), e["owner"].alias("o")))
    )

    def summed(keys: Column) -> Column:
        return F.transform(
            keys,
            lambda k: F.struct(
                k["o"].alias("owner"),
                k["m"].alias("mint"),
                F.aggregate(
                    entries,
                    F.lit(0).cast(AMOUNT),
                    lambda acc, e: F.when(
                        (e["mint"] == k["m"]) & (e["owner"] == k["o"]),
                        (acc + e["delta"]).cast(AMOUNT),
                    ).otherwise(acc),
                ).alias("delta"),
            ),
        )

    return let(distinct, lambda keys: F.when(F.size(keys) == F.size(entries), entries).otherwise(summed(keys)))


def token_deltas(
    pre: Column, post: Column, on_duplicate: str = "sum", nested: bool = False
) -> Column:
    """Change per (owner, mint): after minus before, missing is 0, no zero entries.

    ``on_duplicate`` says what an (owner, mint) listed twice on one side means: ``sum`` or ``last``.
    """
    if on_duplicate not in ("sum", "last"):
        raise ValueError("on_duplicate must be 'sum' or 'last'")

    def side(b: Column) -> Column:
        parsed = parse_balances(b, nested)
        return let(parsed, _last_per_key) if on_duplicate == "last" else parsed

    # What is nothing on its side adds nothing, and each entry left out is one less to compare with all others.
    entries = F.filter(F.concat(side(post), _negated(side(pre))), lambda e: e["delta"] != 0)
    return F.filter(let(entries, _sum_tokens), lambda e: e["delta"] != 0)


def _sol_changes(keys: Column, pre: Column, post: Column, fee: Column, fee_payer: Column) -> Column:
    payer = F.when(F.size(keys) > 0, F.element_at(keys, 1)).otherwise(fee_payer)
    rows = F.filter(
        F.arrays_zip(keys.alias("account"), pre.alias("pre"), post.alias("post")),
        lambda z: z["account"].isNotNull() & (z["pre"].isNotNull() | z["post"].isNotNull()),
    )

    def change(z: Column) -> Column:
        before = F.coalesce(z["pre"], F.lit(0)).cast(AMOUNT)
        after = F.coalesce(z["post"], F.lit(0)).cast(AMOUNT)
        created = (before == 0) & (after > 0)
        refund = F.when(z["account"] == payer, F.coalesce(fee, F.lit(0))).otherwise(F.lit(0))
        moved = after - before + refund.cast(AMOUNT)
        delta = (
            F.when(created & after.isin(TOKEN_ACCOUNT_RENT, PLAIN_ACCOUNT_RENT), F.lit(0))
            .when(created, moved - F.lit(TOKEN_ACCOUNT_RENT))
            .otherwise(moved)
        )
        return F.struct(
            z["account"].alias("account"),
            delta.cast(AMOUNT).alias("delta"),
            created.alias("created"),
        )

    return F.transform(rows, change)


def sol_deltas(keys: Column, pre: Column, post: Column, fee: Column, fee_payer: Column) -> Column:
    """Lamport change per account with the fee given back to its payer and new-account rent removed."""
    changes = F.filter(_sol_changes(keys, pre, post, fee, fee_payer), lambda c: c["delta"] != 0)
    plain = F.transform(
        changes,
        lambda c: F.struct(c["account"].alias("account"), c["delta"].alias("delta")),
    )
    return F.coalesce(plain, empty_sols())


def accounts_created(keys: Column, pre: Column, post: Column) -> Column:
    """Accounts that had nothing before and hold lamports after."""
    born = F.filter(
        F.arrays_zip(keys.alias("account"), pre.alias("pre"), post.alias("post")),
        lambda z: (F.coalesce(z["pre"], F.lit(0)) == 0) & (F.coalesce(z["post"], F.lit(0)) > 0),
    )
    return F.coalesce(F.size(born), F.lit(0))


def merge_wsol(tokens: Column, sols: Column) -> Column:
    """Lamport changes with wrapped SOL counted as SOL of its owner."""
    wrapped = F.transform(
        F.filter(tokens, lambda t: t["mint"] == WSOL),
        lambda t: F.struct(t["owner"].alias("account"), t["delta"].alias("delta")),
    )

    def grouped(entries: Column) -> Column:
        return F.transform(
            F.array_distinct(F.transform(entries, lambda e: e["account"])),
            lambda a: F.struct(
                a.alias("account"),
                F.aggregate(
                    entries,
                    F.lit(0).cast(AMOUNT),
                    lambda acc, e: F.when(
                        e["account"] == a, (acc + e["delta"]).cast(AMOUNT)
                    ).otherwise(acc),
                ).alias("delta"),
            ),
        )

    return let(F.concat(sols, wrapped), grouped)


def candidate_users(tokens: Column, fee_payer: Column) -> Column:
    """The fee payer and every owner whose token balance moved."""
    return F.array_compact(
        F.array_union(
            F.array(F.nullif(fee_payer, F.lit(""))), F.transform(tokens, lambda t: t["owner"])
        )
    )


def mints_touched(tokens: Column) -> Column:
    """Distinct mints that moved, wrapped SOL left out."""
    return F.array_distinct(
        F.transform(F.filter(tokens, lambda t: t["mint"] != WSOL), lambda t: t["mint"])
    )


def program_ids(*sources: Column) -> Column:
    """Distinct non-empty program ids over several arrays."""
    nothing = F.array().cast("array<string>")
    joined = F.concat(*[F.coalesce(s, nothing) for s in sources])
    return F.array_distinct(F.filter(joined, lambda p: p.isNotNull() & (p != "")))
