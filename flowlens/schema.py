"""Schemas of the records that enter and leave the engine."""

from pyspark.sql import types as T

AMOUNT = T.DecimalType(38, 0)

TOKEN_BALANCE = T.StructType(
    [
        T.StructField("owner", T.StringType()),
        T.StructField("mint", T.StringType()),
        T.StructField("amount", T.DecimalType(20, 0)),
    ]
)
# The source's other layout: the amount is text inside a nested struct.
TOKEN_BALANCE_NESTED = T.StructType(
    [
        T.StructField("owner", T.StringType()),
        T.StructField("mint", T.StringType()),
        T.StructField("amount", T.StringType()),
        T.StructField(
            "ui_token_amount", T.StructType([T.StructField("amount", T.StringType())])
        ),
    ]
)
TOKEN_DELTA = T.StructType(
    [
        T.StructField("owner", T.StringType()),
        T.StructField("mint", T.StringType()),
        T.StructField("delta", AMOUNT),
    ]
)
SOL_DELTA = T.StructType(
    [T.StructField("account", T.StringType()), T.StructField("delta", AMOUNT)]
)


def tx_schema(balance: T.StructType = TOKEN_BALANCE) -> T.StructType:
    """A raw transaction with balance snapshots before and after."""
    return T.StructType(
        [
            T.StructField("signature", T.StringType()),
            T.StructField("slot", T.LongType()),
            T.StructField("block_time", T.LongType()),
            T.StructField("fee_payer", T.StringType()),
            T.StructField("account_keys", T.ArrayType(T.StringType())),
            T.StructField("pre_token_balances", T.ArrayType(balance)),
            T.StructField("post_token_balances", T.ArrayType(balance)),
            T.StructField("pre_balances", T.ArrayType(T.LongType())),
            T.StructField("post_balances", T.ArrayType(T.LongType())),
            T.StructField("fee", T.LongType()),
            T.StructField("programs_invoked", T.ArrayType(T.StringType())),
            T.StructField("is_vote", T.BooleanType()),
            T.StructField("failed", T.BooleanType()),
        ]
    )


TX = tx_schema()

# Flat trade record. Money is whole lamports, so sums are exact in any order.
SWAP = T.StructType(
    [
        T.StructField("signature", T.StringType()),
        T.StructField("slot", T.LongType()),
        T.StructField("block_time", T.LongType()),
        T.StructField("venue", T.StringType()),
        T.StructField("user_wallet", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("base_mint", T.StringType()),
        T.StructField("base_amount", T.LongType()),
        T.StructField("quote_mint", T.StringType()),
        T.StructField("quote_amount", T.LongType()),
    ]
)

PRICE = T.StructType(
    [
        T.StructField("mint", T.StringType()),
        T.StructField("price_usd", T.DoubleType()),
        T.StructField("market_cap_usd", T.DoubleType()),
        T.StructField("liquidity_usd", T.DoubleType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("chain", T.StringType()),
    ]
)
