"""From raw transactions to balance changes and inferred trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.constants import CONFIDENCE_CUT, PROGRAMS, WSOL
from flowlens.functions import balances as B
from flowlens.functions import swaps as S
from flowlens.functions.columns import bind
from flowlens.operators.lookups import BROADCAST_BYTES, lookup_join, measured
from flowlens.operators.merge import insert_ignore


def subscribed(tx: DataFrame, programs: Sequence[str] = tuple(PROGRAMS)) -> DataFrame:
    """Successful non-vote transactions that touch one of the programs."""
    wanted = F.array(*[F.lit(p) for p in programs])
    return tx.filter(
        ~F.coalesce(F.col("is_vote"), F.lit(False))
        & ~F.coalesce(F.col("failed"), F.lit(False))
        & F.arrays_overlap(F.col("account_keys"), wanted)
    )


def normalized(tx: DataFrame, now: int | None = None, message_id: str | None = None) -> DataFrame:
    """Fill in what a record may lack: fee payer, time, and a usable signature.

    A missing or placeholder signature becomes ``id:`` and the source's message id. Without a
    message id a hash of the record is used, so that a replay gives the same id.
    """
    plain = F.lower(F.trim(F.coalesce(F.col("signature"), F.lit(""))))
    own_id = F.col(message_id).cast("string") if message_id else F.hex(F.xxhash64(*tx.columns))
    fallback = F.concat(F.lit("id:"), own_id)
    received = F.lit(now) if now is not None else F.unix_timestamp(F.current_timestamp())
    return tx.select(
        F.when(plain.isin("", "unknown", "error"), fallback)
        .otherwise(F.trim(F.col("signature")))
        .alias("signature"),
        F.coalesce(F.col("block_time"), received).alias("block_time"),
        F.coalesce(
            F.nullif(F.col("fee_payer"), F.lit("")),
            F.when(F.size("account_keys") > 0, F.element_at("account_keys", 1)),
        ).alias("fee_payer"),
        *[c for c in tx.columns if c not in ("signature", "block_time", "fee_payer")],
    )


def delta_records(tx: DataFrame, on_duplicate: str = "sum", nested: bool = False) -> DataFrame:
    """Balance changes of every transaction, also of those without a trade."""
    changes = bind(
        tx,
        {
            "token_deltas": B.token_deltas(
                F.col("pre_token_balances"), F.col("post_token_balances"), on_duplicate, nested
            ),
            "sol_deltas": B.sol_deltas(
                F.col("account_keys"),
                F.col("pre_balances"),
                F.col("post_balances"),
                F.col("fee"),
                F.col("fee_payer"),
            ),
        },
    )
    return changes.select(
        "signature",
        "slot",
        "block_time",
        "fee_payer",
        B.program_ids(F.col("programs_invoked")).alias("programs_invoked"),
        "token_deltas",
        "sol_deltas",
        F.col("fee").alias("tx_fee"),
        B.accounts_created(
            F.col("account_keys"), F.col("pre_balances"), F.col("post_balances")
        ).alias("accounts_created"),
        B.mints_touched(F.col("token_deltas")).alias("mints_touched"),
    )


def mint_events(deltas: DataFrame) -> DataFrame:
    """Which mints a transaction touched; kept for all transactions."""
    return deltas.select(
        "signature", "slot", "block_time", "fee_payer", "mints_touched", "programs_invoked"
    )


def trades_considered(deltas: DataFrame) -> DataFrame:
    """Per transaction all trades its users may have made (array, unordered)."""
    moved = deltas.filter(F.size("token_deltas") > 0)
    users = bind(
        moved,
        {
            "merged_sol": B.merge_wsol(F.col("token_deltas"), F.col("sol_deltas")),
            "candidates": B.candidate_users(F.col("token_deltas"), F.col("fee_payer")),
        },
    )
    trades = S.trade_candidates(
        F.col("candidates"),
        F.col("token_deltas"),
        F.col("merged_sol"),
        F.col("sol_deltas"),
        F.col("fee_payer"),
    )
    return bind(users, {"trades": trades})


def infer_trades(deltas: DataFrame, min_tenths: int = CONFIDENCE_CUT, carry: Sequence[str] = ()) -> DataFrame:
    """The best trade of each transaction with at least ``min_tenths`` confidence, with the columns ``carry``."""
    best = bind(trades_considered(deltas), {"best": S.best_trade(F.col("trades"))})
    return (
        best.filter(F.col("best").isNotNull() & (-F.col("best.minus_tenths") >= min_tenths))
        .select(
            "signature",
            "slot",
            "block_time",
            S.venue(F.col("programs_invoked")).alias("venue"),
            F.col("best.user_wallet").alias("user_wallet"),
            F.col("best.side").alias("side"),
            F.col("best.base_mint").alias("base_mint"),
            F.col("best.base_amount").alias("base_amount"),
            F.col("best.quote_mint").alias("quote_mint"),
            F.col("best.quote_amount").alias("quote_amount"),
            (-F.col("best.minus_tenths")).alias("confidence_tenths"),
            S.route_depth(F.col("programs_invoked")).alias("route_depth"),
            *carry,
        )
        .withColumn("confidence", F.col("confidence_tenths") / F.lit(10.0))
        .withColumn("quote_lamports", S.quote_lamports(F.col("quote_mint"), F.col("quote_amount")))
    )


def with_mcap(swaps: DataFrame, supply: DataFrame, wsol: str = WSOL) -> DataFrame:
    """Price and market cap at each trade; ``supply`` has (base_mint, supply, decimals)."""
    priced = lookup_join(swaps, supply, ["base_mint"], "left")
    wsol_trade = (F.col("quote_mint") == wsol) & F.col("supply").isNotNull()
    return priced.withColumn(
        "mcap_at_swap",
        S.mcap_sol(
            F.col("quote_mint"),
            F.col("quote_amount"),
            F.col("base_amount"),
            F.col("supply"),
            wsol,
        ),
    ).withColumn(
        "price_sol",
        F.when(
            wsol_trade,
            S.price_sol(F.col("quote_amount"), F.col("base_amount"), F.col("decimals")),
        ),
    )


def backfill(deltas: DataFrame, hot_mints: DataFrame) -> DataFrame:
    """Trades in stored delta records that involve a newly hot mint (``hot_mints.mint``).

    Hot mints that can be broadcast are looked up in each record where it lies: a record is told once for each hot mint it
    touched, and counts where its trade is of that mint. So no record is shuffled. Only more hot mints than that are
    met by a shuffle.
    """
    hot_mints = hot_mints.select("mint").distinct()
    if not hot_mints.isStreaming:
        hot_mints, size = measured(hot_mints)
        if size <= BROADCAST_BYTES:
            told = deltas.select("*", F.explode("mints_touched").alias("_mint"))
            told = told.join(F.broadcast(hot_mints.select(F.col("mint").alias("_mint"))), "_mint", "left_semi")
            found = infer_trades(told, carry=["_mint"]).filter("base_mint = _mint")
            return found.select(F.col("base_mint").alias("mint"), *[c for c in found.columns if c not in ("base_mint", "_mint")])
    touched = deltas.select(F.explode("mints_touched").alias("mint"), "signature")
    hits = lookup_join(touched, hot_mints, ["mint"], "left_semi")
    wanted = hits.select("signature").distinct()
    chosen = deltas.join(wanted, "signature", "left_semi")
    found = infer_trades(chosen).withColumnRenamed("base_mint", "mint")
    return lookup_join(found, hot_mints, ["mint"], "left_semi")


def backfill_missing(
    deltas: DataFrame, hot_mints: DataFrame, supply: DataFrame, stored: DataFrame | None = None
) -> DataFrame:
    """``backfill`` to the end: with price and market cap, without the trades that ``stored``
    (signature, base_mint) already holds."""
    hot = hot_mints.select(F.col("mint").alias("base_mint")).distinct()
    supply = lookup_join(supply, hot, ["base_mint"], "left_semi")
    found = with_mcap(backfill(deltas, hot_mints).withColumnRenamed("mint", "base_mint"), supply)
    order = [F.asc("slot"), F.asc("user_wallet")]
    return insert_ignore(stored, found, ["signature", "base_mint"], order)
