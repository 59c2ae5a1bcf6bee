"""Query features: both sides and the pairs of every query's bond and time, on one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AGE_MIN, SYNC_MIN
from .pairs import PAIR_FEATURES, pair_features, pair_snapshots
from .side import COUNTS, SIDE_FEATURES, side_features, slots

PAIR_COUNTS = ["n_pair", "n_size_time_pair"]


def check_queries(queries: DataFrame) -> DataFrame:
    """Raises ValueError unless row_id is unique and no key is missing; returns the input."""
    bad = queries.agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("ids"), F.count_if(F.col("cusip").isNull() | F.col("ns").isNull()).alias("missing")).first()
    if bad["n"] != bad["ids"] or bad["missing"]:
        raise ValueError("queries need a unique row_id, and cusip and time on every row")
    return queries


def point_features(events: DataFrame, queries: DataFrame, *, age_min: float = AGE_MIN, sync_min: float = SYNC_MIN, exact: bool = True, prefix: str = "bcq_") -> DataFrame:
    """``queries`` (row_id, cusip, ns, day) with the 62 features; counts without support are
    0, values NULL.  States are computed once per distinct (cusip, ns)."""
    sides = side_features(slots(events, queries, exact=exact), age_min)
    wide = sides.groupBy("cusip", "ns").agg(*(F.first(F.when(F.col("side") == side, F.col(c)), ignorenulls=True).alias(f"{prefix}{side}_{c}") for side in ("bid", "ask") for c in SIDE_FEATURES))
    pairs = pair_features(pair_snapshots(events, queries, age_min=age_min, sync_min=sync_min, exact=exact)).select("cusip", "ns", *(F.col(c).alias(prefix + c) for c in PAIR_FEATURES))
    out = queries.join(wide, ["cusip", "ns"], "left").join(pairs, ["cusip", "ns"], "left")
    counts = [f"{prefix}{side}_{c}" for side in ("bid", "ask") for c in COUNTS] + [prefix + c for c in PAIR_COUNTS]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in counts})
    return out.withColumn(f"{prefix}is_quoted", (F.col(f"{prefix}bid_n_dealers") + F.col(f"{prefix}ask_n_dealers") > 0).cast("double"))
