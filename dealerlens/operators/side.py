"""Dealer-equal side features: plain, age-weighted, and with robust control of outliers.

Slots (bond, side, query time, dealer) are collected per query and side as one array of
small structs, as long as there are dealers, and everything else is array arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AGE_MIN, CLIP_FLOOR_BPS, MAD_MULTIPLIER, MAD_SCALE, MIN_PEERS
from ..functions.scalar import array_median, is_unknown_tag, minutes
from .asof import asof

COUNTS = ["n_dealers", "n_fresh_dealers", "n_incomplete", "n_peer_supported", "n_clipped_dealers", "n_changed_centers"]
VALUES = [
    "center_equal", "center_decay", "center_max_age", "dispersion_bps", "mean_candidate_gap", "multi_fraction", "zero_quantity_fraction", "unknown_quantity_fraction",
    "median_message_age_min", "median_change_age_min", "unknown_change_age_fraction", "center_lower", "center_upper", "max_decay_weight_share", "decay_effective_dealers",
    "center_candidate_clip", "center_dealer_downweight",
]
SIDE_FEATURES = [*VALUES, *COUNTS]
STATE = ["complete", "center", "lo", "hi", "gap", "candidate_count", "spread_set", "quantity_set", "last_change"]


def slots(events: DataFrame, queries: DataFrame, *, exact: bool = True) -> DataFrame:
    """Latest state of every dealer and side at every query time of its bond, same day."""
    s = asof(events.filter("side in ('bid', 'ask')"), queries, STATE, exact=exact)
    n = F.size("spread_set")
    return s.withColumns(
        {
            "change_age_min": minutes(F.col("ns") - F.col("last_change")),
            "zero": F.array_contains("quantity_set", "Zero"),
            "unknown": F.exists("quantity_set", is_unknown_tag),
            "mid_low": F.get("spread_set", F.floor((n - 1) / 2).cast("int")),
            "mid_high": F.get("spread_set", F.floor(n / 2).cast("int")),
        }
    ).drop("spread_set", "quantity_set")


def _mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def _with_peers(dealer: Column, fresh: Column) -> Column:
    """struct(clipped, weight, supported, outside, changed) of one dealer against the others."""
    peers = F.transform(F.filter(fresh, lambda p: p["firm"] != dealer["firm"]), lambda p: p["center"])
    plain = F.struct(dealer["center"].alias("clipped"), F.lit(1.0).alias("weight"), F.lit(0).alias("supported"), F.lit(0).alias("outside"), F.lit(0).alias("changed"))

    def judged(x: Column) -> Column:
        low, high = x["ref"] - x["radius"], x["ref"] + x["radius"]
        clipped = (_clip(dealer["mid_low"], low, high) + _clip(dealer["mid_high"], low, high)) / 2
        residual = F.abs(dealer["center"] - x["ref"])
        return F.struct(
            clipped.alias("clipped"),
            F.when(residual > 0, F.least(F.lit(1.0), x["radius"] / residual)).otherwise(F.lit(1.0)).alias("weight"),
            F.lit(1).alias("supported"),
            ((dealer["lo"] < low) | (dealer["hi"] > high)).cast("int").alias("outside"),
            (F.abs(clipped - dealer["center"]) > 1e-9).cast("int").alias("changed"),
        )

    def measured(p: Column) -> Column:
        spread = lambda ref: F.struct(ref.alias("ref"), F.greatest(F.lit(CLIP_FLOOR_BPS), F.lit(MAD_MULTIPLIER * MAD_SCALE) * array_median(F.transform(p, lambda v: F.abs(v - ref)))).alias("radius"))
        return _once(_once(array_median(p), spread), judged)

    return _once(peers, lambda p: F.when(F.size(p) >= MIN_PEERS, measured(p)).otherwise(plain))


def side_features(slot_rows: DataFrame, age_min: float = AGE_MIN) -> DataFrame:
    """One row per (cusip, ns, day, side) that any dealer has a state for."""
    if age_min <= 0:
        raise ValueError("age_min must be positive")
    valid = F.col("complete")
    row = F.struct("firm", "center", "lo", "hi", "mid_low", "mid_high", "age_min")
    on = lambda c: F.when(valid, c)
    g = slot_rows.groupBy("cusip", "ns", "day", "side").agg(
        F.count_if(valid).alias("n_dealers"),
        F.count_if(valid & (F.col("age_min") <= age_min)).alias("n_fresh_dealers"),
        F.count_if(~valid).alias("n_incomplete"),
        F.avg(on(F.col("center"))).alias("center_equal"),
        F.avg(F.when(valid & (F.col("age_min") <= age_min), F.col("center"))).alias("center_max_age"),
        F.stddev_pop(on(F.col("center"))).alias("dispersion_bps"),
        F.avg(on(F.col("gap"))).alias("mean_candidate_gap"),
        F.avg(on((F.col("candidate_count") > 1).cast("int"))).alias("multi_fraction"),
        F.avg(on(F.col("zero").cast("int"))).alias("zero_quantity_fraction"),
        F.avg(on(F.col("unknown").cast("int"))).alias("unknown_quantity_fraction"),
        F.median(on(F.col("age_min"))).alias("median_message_age_min"),
        F.median(on(F.col("change_age_min"))).alias("median_change_age_min"),
        F.avg(on(F.col("change_age_min").isNull().cast("int"))).alias("unknown_change_age_fraction"),
        F.avg(on(F.col("lo"))).alias("center_lower"),
        F.avg(on(F.col("hi"))).alias("center_upper"),
        F.array_sort(F.collect_list(on(row))).alias("_d"),
    )
    least = F.array_min(F.transform("_d", lambda d: d["age_min"]))
    g = g.withColumn("_least", least).withColumn("_w", F.transform("_d", lambda d: F.pow(F.lit(2.0), -(d["age_min"] - F.col("_least")) / age_min)))
    g = g.withColumn("_fresh", F.filter("_d", lambda d: d["age_min"] <= age_min)).withColumn("_sum", _sum(F.col("_w")))
    g = g.withColumn("_p", F.transform("_d", lambda d: _with_peers(d, F.col("_fresh"))))
    weighted = _sum(F.zip_with("_d", "_w", lambda d, w: d["center"] * w))
    part = lambda name: F.transform("_p", lambda p: p[name])
    count = lambda name: F.aggregate(part(name), F.lit(0).cast("bigint"), lambda x, y: x + y)
    some = F.col("n_dealers") > 0
    g = g.withColumns(
        {
            "center_decay": F.when(some, weighted / F.col("_sum")),
            "max_decay_weight_share": F.when(some, F.array_max("_w") / F.col("_sum")),
            "decay_effective_dealers": F.when(some, F.col("_sum") * F.col("_sum") / _sum(F.transform("_w", lambda w: w * w))),
            "center_candidate_clip": _mean(part("clipped")),
            "center_dealer_downweight": F.when(some, _sum(F.zip_with("_d", "_p", lambda d, p: d["center"] * p["weight"])) / _sum(part("weight"))),
            "n_peer_supported": count("supported"),
            "n_clipped_dealers": count("outside"),
            "n_changed_centers": count("changed"),
        }
    )
    return g.select("cusip", "ns", "day", "side", *SIDE_FEATURES)
