"""Balance changes and trade inference on single transactions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from flowlens.constants import PROGRAMS, USDC, WSOL
from flowlens.functions import balances as B
from flowlens.functions import swaps as S
from flowlens.operators import trades as T
from flowlens.schema import SOL_DELTA, TOKEN_BALANCE_NESTED, TOKEN_DELTA, TX, tx_schema

USER = "user_wallet"


def tx(**over):
    row = {
        "signature": "sig",
        "slot": 1,
        "block_time": 100,
        "fee_payer": USER,
        "account_keys": [USER, "pool", "token_account"],
        "pre_token_balances": [],
        "post_token_balances": [],
        "pre_balances": [10_000_000_000, 5_000_000_000, 1],
        "post_balances": [9_000_000_000, 6_000_000_000, 1],
        "fee": 5000,
        "programs_invoked": [],
        "is_vote": False,
        "failed": False,
    }
    row.update(over)
    for side in ("pre_token_balances", "post_token_balances"):
        row[side] = [(o, m, Decimal(a)) for o, m, a in row[side]]
    return tuple(row[f.name] for f in TX)


def deltas(spark, row, **kw):
    out = T.delta_records(spark.createDataFrame([row], TX), **kw).first()
    tokens = {(d.owner, d.mint): int(d.delta) for d in out.token_deltas}
    sols = {d.account: int(d.delta) for d in out.sol_deltas}
    return tokens, sols, out


def test_simple_buy(spark):
    tokens, sols, _ = deltas(
        spark,
        tx(
            pre_token_balances=[(USER, "meme", 0)],
            post_token_balances=[(USER, "meme", 1_000_000)],
        ),
    )
    assert tokens == {(USER, "meme"): 1_000_000}
    assert sols == {USER: -999_995_000, "pool": 1_000_000_000}


def test_fee_alone_is_no_change(spark):
    _, sols, _ = deltas(
        spark,
        tx(
            account_keys=[USER],
            pre_balances=[1_000_000_000],
            post_balances=[999_995_000],
        ),
    )
    assert sols == {}


@pytest.mark.parametrize(
    "post, delta", [(2039280, None), (890880, None), (5_000_000, 5_000_000 - 2039280)]
)
def test_new_accounts(spark, post, delta):
    _, sols, out = deltas(
        spark,
        tx(account_keys=[USER, "new"], pre_balances=[10, 0], post_balances=[10 - 5000, post]),
    )
    assert sols.get("new") == delta
    assert out.accounts_created == 1


def test_repeated_balance_entries(spark):
    row = tx(
        pre_token_balances=[],
        post_token_balances=[(USER, "m", 5), (USER, "m", 7), ("", "m", 9), ("x", None, 9)],
    )
    assert deltas(spark, row)[0] == {(USER, "m"): 12}
    assert deltas(spark, row, on_duplicate="last")[0] == {(USER, "m"): 7}


def test_nested_amount_layout(spark):
    row = list(tx())
    row[6] = [(USER, "m", None, ("18446744073709551615",)), (USER, "n", "3", None)]
    frame = spark.createDataFrame([tuple(row)], tx_schema(TOKEN_BALANCE_NESTED))
    out = T.delta_records(frame, nested=True).first()
    assert {(d.mint, int(d.delta)) for d in out.token_deltas} == {("m", 2**64 - 1), ("n", 3)}


def infer(spark, tokens, sols, payer=USER, programs=()):
    schema = (
        "signature string, slot long, block_time long, fee_payer string, programs_invoked array<string>, "
        f"token_deltas array<{TOKEN_DELTA.simpleString()}>, sol_deltas array<{SOL_DELTA.simpleString()}>"
    )
    tokens = [(o, m, Decimal(d)) for o, m, d in tokens]
    sols = [(a, Decimal(d)) for a, d in sols]
    return spark.createDataFrame([("s", 1, 1, payer, list(programs), tokens, sols)], schema)


def trade(spark, tokens, sols, minimum=0, **kw):
    return T.infer_trades(infer(spark, tokens, sols, **kw), minimum).first()


def test_wrapped_sol_counts_as_sol(spark):
    frame = infer(spark, [(USER, WSOL, -500_000_000), (USER, "other", 1_000_000)], [(USER, 0)])
    merged = frame.select(B.merge_wsol(F.col("token_deltas"), F.col("sol_deltas")).alias("m")).first().m
    assert {(m.account, int(m.delta)) for m in merged} == {(USER, -500_000_000)}


def test_mints_touched_leaves_out_wrapped_sol(spark):
    frame = infer(spark, [(USER, WSOL, 1), (USER, "a", 1), ("o", "b", 1), ("p", "a", 2)], [])
    assert sorted(frame.select(B.mints_touched(F.col("token_deltas")).alias("m")).first().m) == ["a", "b"]


@pytest.mark.parametrize("sign, side", [(1, "buy"), (-1, "sell")])
def test_buy_and_sell(spark, sign, side):
    found = trade(spark, [(USER, "meme", sign * 1_000_000)], [(USER, -sign * 500_000_000)])
    assert (found.side, found.base_mint, int(found.base_amount)) == (side, "meme", 1_000_000)
    assert (found.quote_mint, int(found.quote_amount), found.confidence) == (WSOL, 500_000_000, 1.0)


def test_no_quote_no_trade(spark):
    assert trade(spark, [(USER, "a", 1), (USER, "b", 2)], []) is None


def test_confidence_deductions(spark):
    many = [(USER, m, i + 1) for i, m in enumerate("abcd")]
    assert trade(spark, many[:2], [(USER, -500_000_000)]).confidence == 0.8
    assert trade(spark, many, [(USER, -500_000_000)]).confidence == 0.7
    assert trade(spark, many[:1], [(USER, -2039280)]).confidence == 0.9
    low = [*many, (USER, USDC, -9)]
    assert trade(spark, low, [(USER, -500_000_000)]).confidence == 0.6
    assert trade(spark, low, [(USER, -500_000_000)], minimum=7) is None


def test_ties_prefer_fee_payer_then_first_mint(spark):
    tokens = [("aaa", "meme", 5), (USER, "m2", 7), (USER, "m1", 7)]
    found = trade(spark, [*tokens[:1], ("zzz", "meme", 5)], [("aaa", -9), ("zzz", -9)], payer="zzz")
    assert found.user_wallet == "zzz"
    assert trade(spark, tokens[1:], [(USER, -9)]).base_mint == "m1"


def test_dollar_quote(spark):
    found = trade(spark, [(USER, "meme", 10), (USER, USDC, -300)], [])
    assert (found.quote_mint, int(found.quote_amount), int(found.quote_lamports)) == (USDC, 300, 0)


def test_venue_and_depth(spark):
    ids = list(PROGRAMS)
    rows = [([p],) for p in ids] + [([],), (["other"],), ([ids[2], ids[0], "x"],)]
    frame = spark.createDataFrame(rows, "p array<string>")
    out = frame.select(S.venue(F.col("p")).alias("v"), S.route_depth(F.col("p")).alias("d")).collect()
    assert [r.v for r in out[:9]] == [v for _, v in PROGRAMS.values()]
    assert [(r.v, r.d) for r in out[9:]] == [("unknown", 1), ("unknown", 1), ("jupiter", 2)]


def test_normalized_fallback_id_is_stable(spark):
    frame = spark.createDataFrame([tx(signature=" Error ", fee_payer="", block_time=None)], TX)
    a, b = (T.normalized(frame, now=7).first() for _ in range(2))
    assert a.signature.startswith("id:") and a.signature == b.signature
    assert (a.fee_payer, a.block_time) == (USER, 7)


def test_funder_is_first_loser_in_key_order(spark):
    from flowlens.operators.graph import funding_edges

    frame = spark.createDataFrame(
        [
            tx(
                account_keys=["w", "a", "b", "x"],
                pre_balances=[1, 9, 9, 4],
                post_balances=[5, 8, 2, 6],
            )
        ],
        TX,
    )
    assert {(e.wallet, e.funder) for e in funding_edges(frame).collect()} == {("w", "a"), ("x", "a")}
