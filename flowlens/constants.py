"""Fixed values of the domain. They must equal the published ones for results to agree."""

# Token ids that count as money, not as the traded token.
WSOL = "So11111111111111111111111111111111111111112"
USDC = "EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v"
USDT = "Es9vMFrzaCERmJfrF4H2FYD4KCoNkY11McCe8BenwNYB"
QUOTE_MINTS = (WSOL, USDC, USDT)

# Rent deposits in lamports, and lamports per SOL.
TOKEN_ACCOUNT_RENT = 2039280
PLAIN_ACCOUNT_RENT = 890880
LAMPORTS_PER_SOL = 1_000_000_000

# Program id -> (program label, venue).
PROGRAMS = {
    "6EF8rrecthR5Dkzon8Nwu78hRvfCKubJ14M5uBEwF6P": ("pump_fun_bonding", "pump"),
    "pAMMBay6oceH9fJKBRHGP5D4bD4sWpmSwMn52FMfXEA": ("pump_fun_amm", "pump"),
    "JUP6LkbZbjS1jKKwapdHNy74zcZ3tLUZoi5QNyVTaV4": ("jupiter_v6", "jupiter"),
    "675kPX9MHTjS2zt1qfr1NYHuzeLXfQM9H24wFSUt1Mp8": ("raydium_amm_v4", "raydium"),
    "CPMMoo8L3F4NbTegBCKVNunggL7H1ZpdTHKxQB5qKP1C": ("raydium_cpmm", "raydium"),
    "CAMMCzo5YL8w4VFF8KVHrK22GGUsp5VTaW7grrKgrWqK": ("raydium_clmm", "raydium"),
    "routeUGWgWzqBWFcrCfv8tritsqukccJPu3q5GPP3xS": ("raydium_routing", "raydium"),
    "whirLbMiicVdio4qvUfM5KAg6Ct8VwpYzGff3uctyCc": ("orca_whirlpools", "orca"),
    "LBUZKhRxPF3XUpBCjp4YzTKgLccjZhTSDM9YuVaPwxo": ("meteora_dlmm", "meteora"),
}

# Swap confidence in tenths (start, deductions, cut).
CONFIDENCE_START = 10
DEDUCT_MANY_TOKENS = 2
DEDUCT_MANY_QUOTES = 1
DEDUCT_RENT_SIZED = 1
DEDUCT_BUSY_USER = 1
CONFIDENCE_CUT = 7

# The statistics a rule may test, each with suffix _5m (short) or _1h (long).
RULE_STATS = (
    "buy_count",
    "sell_count",
    "unique_buyers",
    "unique_sellers",
    "buy_volume_sol",
    "avg_buy_size",
    "buy_sell_ratio",
    "top_3_buyers_volume_share",
    "new_wallet_pct",
)

# An alert is suppressed below this known market cap (SOL).
MIN_MCAP_SOL = 500

# Weights of the five score parts in percent.
SCORE_WEIGHTS = {
    "concentration": 25,
    "cluster": 30,
    "timing": 15,
    "new_wallet": 15,
    "ratio": 15,
}

# Alert wording per rule and display name per venue.
RULE_TEXT = {
    "concentrated_accumulation": "Few wallets accumulating aggressively",
    "stealth_accumulation": "Many small buys (avoiding detection)",
    "extreme_ratio": "Heavy buying, almost no selling",
    "sybil_pattern": "Suspicious new wallet activity",
    "whale_concentration": "Top buyers hold majority",
    "slow_stealth_accumulation": "Prolonged quiet accumulation",
    "slow_concentration": "Gradual concentration over time",
    "gradual_accumulation": "Steady buy pressure building",
}
VENUE_TEXT = {
    "pump": "pump.fun",
    "jupiter": "Jupiter",
    "raydium": "Raydium",
    "orca": "Orca",
    "meteora": "Meteora",
    "unknown": "DEX",
}
# Colour (RGB) and sign of each risk level, sign of each venue.
RISK_COLOUR = {
    "CRITICAL": 0xFF0000,
    "HIGH": 0xFF4400,
    "MEDIUM": 0xFFAA00,
    "LOW": 0xFFDD00,
    "MINIMAL": 0x00AA00,
}
RISK_SIGN = {
    "CRITICAL": "\U0001f6a8",
    "HIGH": "\U0001f534",
    "MEDIUM": "\U0001f7e0",
    "LOW": "\U0001f7e1",
    "MINIMAL": "\U0001f7e2",
}
VENUE_SIGN = {
    "pump": "\U0001f4a7",
    "jupiter": "\U0001f4ab",
    "raydium": "\u2728",
    "orca": "\U0001f433",
    "meteora": "\u2604",
    "unknown": "\u2753",
}
