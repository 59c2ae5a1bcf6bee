"""Same-dealer bid/ask pairs with interval-valued gaps, crossing classes and size matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AGE_MIN, SYNC_MIN
from ..functions.scalar import array_median, minutes
from .asof import asof

PAIR_FEATURES = [
    "n_pair", "n_size_time_pair", "pair_gap", "pair_gap_low", "pair_gap_high", "pair_mid", "pair_mid_range", "pair_cross_some", "pair_cross_all", "pair_time_gap",
    "pair_unknown_size", "size_time_gap", "size_time_mid", "size_time_cross_some", "size_time_cross_all",
]
STATE = ["complete", "center", "lo", "hi", "pair_set"]


def _crossing(low: Column, high: Column, eligible: Column) -> Column:
    return F.when(~eligible, "Unassessed").when(low >= 0, "None").when(high < 0, "All").otherwise("Some")


def _matches(bid: Column, ask: Column) -> Column:
    """array<struct(low, high, gap, mid)>, one for each positive size that both sides have."""
    tags = lambda side: F.array_distinct(F.filter(F.transform(side, lambda p: p["qtag"]), lambda t: t.startswith("q=")))
    spreads = lambda side, tag: F.transform(F.filter(side, lambda p: p["qtag"] == tag), lambda p: p["s"])

    def one(tag: Column) -> Column:
        b, a = spreads(bid, tag), spreads(ask, tag)
        return F.struct(
            (F.array_min(b) - F.array_max(a)).alias("low"), (F.array_max(b) - F.array_min(a)).alias("high"),
            (array_median(b) - array_median(a)).alias("gap"), ((array_median(b) + array_median(a)) / 2).alias("mid"),
        )

    return F.transform(F.array_intersect(tags(bid), tags(ask)), one)


def pair_snapshots(events: DataFrame, queries: DataFrame, *, age_min: float = AGE_MIN, sync_min: float = SYNC_MIN, exact: bool = True) -> DataFrame:
    """One row per (cusip, ns, firm) with a state on either side.

    Both sides meet in one aggregate instead of a full outer join, as they come from the
    same as-of pass."""
    s = asof(events.filter("side in ('bid', 'ask')"), queries, STATE, exact=exact)
    take = lambda side: F.max(F.when(F.col("side") == side, F.struct("event_ns", "age_min", *STATE))).alias(side)
    p = s.groupBy("cusip", "ns", "day", "firm").agg(take("bid"), take("ask"))
    b, a = F.col("bid"), F.col("ask")
    p = p.withColumns({"both": b.isNotNull() & a.isNotNull(), "complete": F.coalesce(b["complete"] & a["complete"], F.lit(False))})
    full = F.col("complete")
    nothing = F.array().cast("array<struct<low:double,high:double,gap:double,mid:double>>")
    p = p.withColumns(
        {
            "max_age": F.when(F.col("both"), F.greatest(b["age_min"], a["age_min"])),
            "time_gap": F.abs(minutes(b["event_ns"] - a["event_ns"])),
            "same_time": F.coalesce(b["event_ns"] == a["event_ns"], F.lit(False)),
            "gap_low": F.when(full, b["lo"] - a["hi"]),
            "gap_high": F.when(full, b["hi"] - a["lo"]),
            "gap_center": F.when(full, b["center"] - a["center"]),
            "mid": F.when(full, (b["center"] + a["center"]) / 2),
            "mid_range": F.when(full, (b["hi"] - b["lo"] + a["hi"] - a["lo"]) / 2),
            "_m": F.when(full, _matches(b["pair_set"], a["pair_set"])).otherwise(nothing),
        }
    )
    n = F.size("_m")
    mean = lambda f: F.when(n > 0, F.aggregate("_m", F.lit(0.0), lambda x, m: x + m[f]) / n)
    positive = F.forall(F.concat(b["pair_set"], a["pair_set"]), lambda x: x["qtag"].startswith("q="))
    p = p.withColumns(
        {
            "positive_matches": n,
            "size_state": F.when(~full, "Unassessed").when(n > 0, "Shared positive").when(positive, "Positive unmatched").otherwise("Unknown / mixed"),
            "matched_gap_low": F.array_min(F.transform("_m", lambda m: m["low"])),
            "matched_gap_high": F.array_max(F.transform("_m", lambda m: m["high"])),
            "matched_gap": mean("gap"),
            "matched_mid": mean("mid"),
        }
    )
    p = p.withColumns({"cross": _crossing(F.col("gap_low"), F.col("gap_high"), full), "cross_matched": _crossing(F.col("matched_gap_low"), F.col("matched_gap_high"), F.col("positive_matches") > 0)})
    flat = [F.col(f"{side}.{f}").alias(f"{f}_{side}") for side in ("bid", "ask") for f in ("event_ns", "age_min", "lo", "hi", "center")]
    return policy_masks(p.select(*(c for c in p.columns if c not in ("bid", "ask", "_m")), *flat), age_min, sync_min)


def policy_masks(pairs: DataFrame, age_min: float = AGE_MIN, sync_min: float = SYNC_MIN) -> DataFrame:
    """Masks of the two selection policies, from pairs already computed."""
    if age_min <= 0 or sync_min < 0:
        raise ValueError("age_min must be positive and sync_min not negative")
    fresh = F.coalesce(F.col("complete") & (F.col("max_age") <= age_min), F.lit(False))
    return pairs.withColumn("fresh_pair", fresh).withColumn("size_time_pair", F.coalesce(F.col("fresh_pair") & (F.col("time_gap") <= sync_min) & (F.col("positive_matches") > 0), F.lit(False)))


def policy_comparison(pairs: DataFrame) -> DataFrame:
    """Three policies in one pass: each pair is repeated for the policies that it is in."""
    row = lambda name, mask, cross, gap, mid: F.struct(F.lit(name).alias("policy"), F.col(mask).alias("on"), F.col(cross).alias("cross"), F.col(gap).alias("gap"), F.col(mid).alias("mid"))
    each = F.array(
        row("A fresh / original", "fresh_pair", "cross", "gap_center", "mid"),
        row("B match slots / original", "size_time_pair", "cross", "gap_center", "mid"),
        row("C same slots / matched", "size_time_pair", "cross_matched", "matched_gap", "matched_mid"),
    )
    x = pairs.select("firm", F.explode(each).alias("x")).select("firm", "x.*")
    on = lambda c: F.when(F.col("on"), c)
    share = lambda state: F.avg(on((F.col("cross") == state).cast("int"))).alias(f"{state.lower()}_fraction")
    return x.groupBy("policy").agg(
        F.count_if("on").alias("n_slots"), F.count_distinct(on(F.col("firm"))).alias("n_dealers"), F.avg(on(F.col("gap"))).alias("gap_mean_bps"),
        F.avg(on(F.col("mid"))).alias("mid_mean_bps"), share("None"), share("Some"), share("All"),
    )


def extreme_sources(quotes: DataFrame, pairs: DataFrame, limit_each: int = 2) -> DataFrame:
    """Raw rows behind the lowest and highest gap bounds of each bond's distinct messages."""
    distinct = pairs.filter("fresh_pair").groupBy("cusip", "firm", "event_ns_bid", "event_ns_ask").agg(F.min("ns").alias("ns"), *(F.first(c).alias(c) for c in ("gap_low", "gap_high", "lo_bid", "hi_bid", "lo_ask", "hi_ask")))
    order = lambda key: Window.partitionBy("cusip").orderBy(key, "ns", "firm", "event_ns_bid", "event_ns_ask")
    side = lambda name, bound: F.struct(F.lit(name).alias("side"), F.col(f"event_ns_{name}").alias("message_ns"), F.col(f"{bound}_{name}").alias("bound"))
    pick = lambda label, field, key, b, a: distinct.withColumn("_r", F.row_number().over(order(key))).filter(F.col("_r") <= limit_each).select(
        F.lit(label).alias("extreme"), "cusip", "firm", "ns", F.col(field).alias("gap_bound_bps"), F.explode(F.array(side("bid", b), side("ask", a))).alias("_s")
    )
    chosen = pick("Low gap boundary", "gap_low", F.asc("gap_low"), "lo", "hi").unionByName(pick("High gap boundary", "gap_high", F.desc("gap_high"), "hi", "lo")).select("*", "_s.*").drop("_s")
    raw = quotes.select("cusip", "firm", "side", F.col("ns").alias("message_ns"), "spread", "quantity")
    return chosen.join(raw, ["cusip", "firm", "side", "message_ns"]).withColumn("boundary_candidate", F.coalesce(F.col("spread") == F.col("bound"), F.lit(False))).drop("bound")


def pair_features(pairs: DataFrame) -> DataFrame:
    """One row per (cusip, ns) with any pair row."""
    fresh, sized = F.col("fresh_pair"), F.col("size_time_pair")
    avg = lambda mask, c: F.avg(F.when(mask, c))
    is_ = lambda c, state: (F.col(c) == state).cast("int")
    return pairs.groupBy("cusip", "ns").agg(
        F.count_if(fresh).alias("n_pair"),
        F.count_if(sized).alias("n_size_time_pair"),
        avg(fresh, F.col("gap_center")).alias("pair_gap"),
        avg(fresh, F.col("gap_low")).alias("pair_gap_low"),
        avg(fresh, F.col("gap_high")).alias("pair_gap_high"),
        avg(fresh, F.col("mid")).alias("pair_mid"),
        avg(fresh, F.col("mid_range")).alias("pair_mid_range"),
        avg(fresh, is_("cross", "Some")).alias("pair_cross_some"),
        avg(fresh, is_("cross", "All")).alias("pair_cross_all"),
        F.median(F.when(fresh, F.col("time_gap"))).alias("pair_time_gap"),
        avg(fresh, (F.col("positive_matches") == 0).cast("int")).alias("pair_unknown_size"),
        avg(sized, F.col("matched_gap")).alias("size_time_gap"),
        avg(sized, F.col("matched_mid")).alias("size_time_mid"),
        avg(sized, is_("cross_matched", "Some")).alias("size_time_cross_some"),
        avg(sized, is_("cross_matched", "All")).alias("size_time_cross_all"),
    )
