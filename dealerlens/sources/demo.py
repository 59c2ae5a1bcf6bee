"""Seeded synthetic quotes, trades and bond metadata."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

BONDS, DEALERS, DAYS = 16, 4, 10


def make_demo(spark: SparkSession, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(quotes, trades, metadata): repeated rows, placeholder zeros, crossed and one-sided
    quotes, and one bond that only trades."""
    r = random.Random(seed)
    quotes, trades = [], []
    level = {b: 80 + 10 * (b % 7) for b in range(BONDS)}
    day, days = datetime(2026, 3, 2), []
    while len(days) < DAYS:
        if day.weekday() < 5:
            days.append(day)
        day += timedelta(days=1)
    for d in days:
        for b in range(BONDS):
            level[b] += r.gauss(0, 1)
            trades.append((f"BOND{b:02d}", d + timedelta(hours=10, minutes=r.randrange(300)), (level[b] + r.gauss(0, 1)) / 100, float(r.choice((50_000, 500_000, 2_000_000)))))
            if b == BONDS - 1:
                continue
            for minute in range(9 * 60, 16 * 60, 60):
                level[b] += r.gauss(0, 0.3)
                for f in range(DEALERS):
                    if r.random() < 0.3:
                        continue
                    at = d + timedelta(minutes=minute + r.randrange(60))
                    wide = -1.0 if r.random() < 0.03 else 2.0
                    for side, sign in (("bid", 1), ("ask", -1)):
                        if side == "ask" and (b, f) == (3, 1):
                            continue
                        spread = 0.0 if r.random() < 0.02 else round(level[b] + sign * wide, 1)
                        row = (f"BOND{b:02d}", f"Dealer{f}", side, at, spread, r.choice((None, 0.0, 1e6, 2e6)))
                        quotes += [row, row] if r.random() < 0.02 else [row]
    meta = [(f"BOND{b:02d}", f"Issuer{b // 8}", 2.0 + b) for b in range(BONDS)]
    return (
        spark.createDataFrame(quotes, "cusip string, firm string, side string, message_time timestamp_ntz, spread double, quantity double"),
        spark.createDataFrame(trades, "cusip string, trade_time timestamp_ntz, bm_spread double, quantity double"),
        spark.createDataFrame(meta, "cusip string, issuer string, years_to_maturity double"),
    )
