"""The grid cleaner: replay of messages, states on a session grid with reason codes,
consensus levels, matched movement and co-movement.

States here have no day limit: what is too old carries the reason "expired".
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    CHANGE_LAG_MIN, GRID_MIN, MAD_SCALE, MAX_AGE_MIN, MIN_COMMON_OBS, MIN_MATCHED, MIN_PEERS, MINUTE_NS, NOISE_FLOOR_BPS, PAIR_MAX_GAP_MIN, PEER_Z, SESSION, TIE_TOL_BPS, ZERO_PAIR_GAP_BPS,
)
from ..functions.scalar import coerce, day_of, minutes
from .asof import asof

STEP = GRID_MIN * MINUTE_NS
KEY = ["cusip", "firm", "side"]


def top_bonds(quotes: DataFrame, limit: int | None = 40) -> DataFrame:
    """The bonds with most messages; ties to the smaller cusip."""
    counted = quotes.groupBy("cusip").agg(F.count("*").alias("messages")).orderBy(F.desc("messages"), "cusip")
    return counted.limit(limit) if limit else counted


def replay(quotes: DataFrame, sequence_col: str | None = None) -> DataFrame:
    """One row per (series, time): repeated payloads count once, the median of a batch, and
    a conflict where a batch spreads further than the tolerance.  If every row of a batch has a sequence
    number and the largest is unique, that row wins."""
    types = dict(quotes.dtypes)
    spread, raw_size = coerce(F.col("spread"), types["spread"]), coerce(F.col("quantity"), types["quantity"])
    size = F.when(raw_size > 0, raw_size)
    number = F.col(sequence_col).cast("double") if sequence_col else F.lit(None).cast("double")
    rows = quotes.filter("cusip is not null and firm is not null and ns is not null and side in ('bid', 'ask')")
    rows = rows.groupBy(*KEY, "ns", spread.alias("spread"), raw_size.alias("raw_size"), size.alias("size")).agg(F.max(number).alias("seq"))
    top = F.max("seq")
    b = rows.groupBy(*KEY, "ns").agg(
        F.median("spread").alias("spread"), F.max("size").alias("quantity"), (F.count_distinct("size") + F.max(F.col("size").isNull().cast("int"))).alias("_sizes"),
        F.min("spread").alias("_low"), F.max("spread").alias("_high"), F.count("*").alias("_rows"), F.count("spread").alias("_finite"), F.count("seq").alias("_numbered"),
        top.alias("_top"), F.max_by(F.struct("spread", "size"), "seq").alias("_winner"), F.sort_array(F.collect_list("seq")).alias("_seqs"),
    )
    ruled = (F.col("_numbered") == F.col("_rows")) & (F.size(F.filter("_seqs", lambda s: s == F.col("_top"))) == 1)
    ruled = F.coalesce(ruled, F.lit(False)) if sequence_col else F.lit(False)
    conflict = (F.col("_rows") > 1) & (F.coalesce(F.col("_high") - F.col("_low") > TIE_TOL_BPS, F.lit(False)) | (F.col("_finite") != F.col("_rows")))
    b = b.withColumn("tie_conflict", ~ruled & conflict)
    b = b.withColumns(
        {
            "quantity": F.when(ruled, F.col("_winner.size")).when(F.col("_sizes") == 1, F.col("quantity")),
            "spread": F.when(ruled, F.col("_winner.spread")).when(~F.col("tie_conflict"), F.col("spread")),
        }
    )
    w = Window.partitionBy(*KEY).orderBy("ns")
    first = F.row_number().over(w) == 1
    b = b.withColumn("_changed", first | ~F.col("spread").eqNullSafe(F.lag("spread").over(w)))
    b = b.withColumn("last_change", F.max(F.when(F.col("_changed"), F.col("ns"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return b.select(*KEY, "ns", "spread", "quantity", "tie_conflict", "last_change")


def session_grid(quotes: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """(ns): weekday session points of the grid from the first to past the last message."""
    span = quotes.agg(F.min("ns").alias("low"), F.max("ns").alias("high"))
    low = F.floor(F.col("low") / STEP).cast("bigint") * STEP if start_ns is None else F.lit(start_ns)
    high = F.ceil(F.col("high") / STEP).cast("bigint") * STEP + STEP if end_ns is None else F.lit(end_ns)
    grid = span.filter("low is not null").select(F.explode(F.sequence(low, high, F.lit(STEP))).alias("ns"))
    minute = (F.col("ns") % (1440 * MINUTE_NS)) / MINUTE_NS
    return grid.filter(F.weekday(day_of(F.col("ns"))) < 5).filter((minute >= SESSION[0]) & (minute <= SESSION[1]))


def grid_states(batches: DataFrame, grid: DataFrame, *, zero_is_missing: bool = False) -> DataFrame:
    """Strictly earlier state of every series at every grid point, with the first reasons."""
    # Every bond is asked at every grid point: that grid is the result.
    points = grid.crossJoin(batches.select("cusip").distinct())
    s = asof(batches, points, ["spread", "quantity", "tie_conflict", "last_change"], same_day=False, exact=False)
    s = s.withColumn("change_age_min", minutes(F.col("ns") - F.col("last_change")))
    reason = F.when(F.col("age_min") > MAX_AGE_MIN, "expired").when(F.col("tie_conflict"), "timestamp conflict").when(F.col("spread").isNull(), "nonfinite")
    if zero_is_missing:
        reason = reason.when(F.col("spread") == 0, "explicit zero policy")
    return s.withColumn("reason", reason.otherwise("kept"))


def _pair_state(states: DataFrame, allow_unknown_size: bool) -> DataFrame:
    """Adds the pair's facts to both legs: eligible, crossed, zero legs.  Both legs lie in
    one group of a window, so no join is needed."""
    w = Window.partitionBy("ns", "cusip", "firm")
    kept = F.col("reason") == "kept"
    leg = lambda side: F.max(F.when(kept & (F.col("side") == side), F.struct(F.col("event_ns"), F.col("spread"), F.col("quantity")))).over(w)
    s = states.withColumns({"_b": leg("bid"), "_a": leg("ask")})
    b, a = F.col("_b"), F.col("_a")
    unknown = b["quantity"].isNull() | a["quantity"].isNull()
    same = F.coalesce((b["quantity"] > 0) & (b["quantity"] == a["quantity"]), F.lit(False))
    near = F.abs(b["event_ns"] - a["event_ns"]) <= PAIR_MAX_GAP_MIN * MINUTE_NS
    s = s.withColumn("eligible", F.coalesce(b.isNotNull() & a.isNotNull() & near & (same | (unknown & F.lit(allow_unknown_size))), F.lit(False)))
    flag = lambda c: F.col("eligible") & F.coalesce(c, F.lit(False))
    return s.withColumns(
        {
            "crossed": flag(b["spread"] < a["spread"]),
            "zero_bid": flag((b["spread"] == 0) & (F.abs(a["spread"]) >= ZERO_PAIR_GAP_BPS)),
            "zero_ask": flag((a["spread"] == 0) & (F.abs(b["spread"]) >= ZERO_PAIR_GAP_BPS)),
        }
    ).drop("_b", "_a")


def clean_states(states: DataFrame, *, allow_unknown_size: bool = True) -> DataFrame:
    """Final reasons: contextual zeros, crossed pairs, then peer outliers among what is kept."""
    s = _pair_state(states, allow_unknown_size)
    own_zero = ((F.col("side") == "bid") & F.col("zero_bid")) | ((F.col("side") == "ask") & F.col("zero_ask"))
    kept = F.col("reason") == "kept"
    s = s.withColumn("reason", F.when(kept & own_zero, "contextual zero").when(kept & F.col("crossed") & ~F.col("zero_bid") & ~F.col("zero_ask"), "crossed dealer pair").otherwise(F.col("reason")))
    w = Window.partitionBy("ns", "cusip", "side")
    on = lambda c: F.when(F.col("reason") == "kept", c)
    s = s.withColumn("_residual", on(F.abs(F.col("spread") - F.median(on(F.col("spread"))).over(w))))
    s = s.withColumns({"_mad": F.median("_residual").over(w), "_peers": F.count("_residual").over(w)})
    outlier = (F.col("_peers") >= MIN_PEERS) & (F.col("_residual") > PEER_Z * F.greatest(MAD_SCALE * F.col("_mad"), F.lit(NOISE_FLOOR_BPS)))
    return s.withColumn("reason", F.when(F.coalesce(outlier, F.lit(False)), "peer outlier").otherwise(F.col("reason"))).drop("_residual", "_mad", "_peers")


def consensus_levels(cleaned: DataFrame) -> DataFrame:
    """(ns, cusip, bid, ask, bid_n, ask_n): medians of kept states; medians over clean pairs
    take their place where there are any; both are void if the bid is below the ask."""
    kept = cleaned.filter("reason = 'kept'")
    take = lambda side, c: F.when(F.col("side") == side, c)
    w = Window.partitionBy("ns", "cusip", "firm")
    paired = F.col("eligible") & ~F.col("crossed") & (F.count("*").over(w) == 2)
    kept = kept.withColumn("_pair", paired)
    g = kept.groupBy("ns", "cusip").agg(
        F.coalesce(F.median(F.when(F.col("_pair"), take("bid", F.col("spread")))), F.median(take("bid", F.col("spread")))).alias("bid"),
        F.coalesce(F.median(F.when(F.col("_pair"), take("ask", F.col("spread")))), F.median(take("ask", F.col("spread")))).alias("ask"),
        F.count(take("bid", F.lit(1))).alias("bid_n"),
        F.count(take("ask", F.lit(1))).alias("ask_n"),
    )
    crossed = F.coalesce(F.col("bid") < F.col("ask"), F.lit(False))
    return g.withColumns({"bid": F.when(~crossed, F.col("bid")), "ask": F.when(~crossed, F.col("ask"))})


def coverage(cleaned: DataFrame, grid: DataFrame, bonds: DataFrame) -> DataFrame:
    """Per bond, the share of grid points with at least one and two dealers, by side."""
    n = F.broadcast(grid.agg(F.count("*").alias("points")))
    counts = cleaned.filter("reason = 'kept'").groupBy("cusip", "ns", "side").agg(F.count("*").alias("n"))
    per = counts.groupBy("cusip").agg(*(F.count_if((F.col("side") == s) & (F.col("n") >= k)).alias(f"{s}_{name}") for s in ("bid", "ask") for name, k in (("fresh", 1), ("multi", 2))))
    out = bonds.select("cusip").join(per, "cusip", "left").join(n, F.lit(True))
    return out.select("cusip", *((F.coalesce(f"{s}_{name}", F.lit(0)) / F.col("points")).alias(f"{s}_{name}") for s in ("bid", "ask") for name in ("fresh", "multi")))


def matched_movement(cleaned: DataFrame) -> DataFrame:
    """Same-dealer change over the lag, per (ns, cusip, side); thin medians are void."""
    lag = CHANGE_LAG_MIN * MINUTE_NS
    now = cleaned.filter("reason = 'kept'").select("ns", *KEY, "spread")
    old = now.select((F.col("ns") + lag).alias("ns"), *KEY, F.col("spread").alias("old"))
    m = now.join(old, ["ns", *KEY]).filter(day_of(F.col("ns")) == day_of(F.col("ns") - lag))
    m = m.withColumn("delta", F.col("spread") - F.col("old")).withColumn("moved", F.abs("delta") > 1e-10)
    solid = (F.col("spread") != 0) & (F.col("old") != 0)
    g = m.groupBy("ns", "cusip", "side").agg(
        F.median("delta").alias("delta"), F.count("*").alias("n"), F.avg(F.col("moved").cast("int")).alias("moved_fraction"), F.median(F.when(F.col("moved"), F.col("delta"))).alias("moved_median"),
        F.median(F.when(solid, F.col("delta"))).alias("nonzero_delta"), F.count_if(solid).alias("_solid"),
    )
    enough = F.col("n") >= MIN_MATCHED
    return g.withColumns({"delta": F.when(enough, F.col("delta")), "moved_median": F.when(enough, F.col("moved_median")), "nonzero_delta": F.when(F.col("_solid") >= MIN_MATCHED, F.col("nonzero_delta"))}).drop("_solid")


def overlap_and_correlation(movement: DataFrame, side: str = "bid", value: str = "delta", least: int = MIN_COMMON_OBS) -> DataFrame:
    """(bond_a, bond_b, overlap, correlation) for all pairs of bonds that share a time; a
    self-join on time, so a time's bonds meet, never all times."""
    x = movement.filter((F.col("side") == side) & F.col(value).isNotNull()).select("ns", "cusip", F.col(value).alias("v"))
    both = x.select("ns", F.col("cusip").alias("bond_a"), F.col("v").alias("a")).join(x.select("ns", F.col("cusip").alias("bond_b"), F.col("v").alias("b")), "ns")
    return both.groupBy("bond_a", "bond_b").agg(F.count("*").alias("overlap"), F.when(F.count("*") >= least, F.corr("a", "b")).alias("correlation"))


def pca(movement: DataFrame, side: str = "bid", *, bonds: int = 6, least: int = MIN_COMMON_OBS) -> DataFrame:
    """(bond, loading, variance_share): first component over the best covered bonds.  Spark
    makes the sums of the complete rows; the matrix of at most ``bonds`` squared is decomposed here."""
    x = movement.filter((F.col("side") == side) & F.col("delta").isNotNull())
    ranked = x.groupBy("cusip").agg(F.count("*").alias("n"), F.stddev_samp("delta").alias("sd")).filter((F.col("n") >= least) & (F.col("sd") > 0))
    chosen = [r["cusip"] for r in ranked.orderBy(F.desc("n"), "cusip").limit(bonds).collect()]
    spark = movement.sparkSession
    schema = "bond string, loading double, variance_share double"
    if len(chosen) < 3:
        return spark.createDataFrame([], schema)
    wide = x.filter(F.col("cusip").isin(chosen)).groupBy("ns").pivot("cusip", chosen).agg(F.first("delta")).dropna()
    n, *rest = wide.agg(F.count("*"), *(F.avg(f"`{c}`") for c in chosen), *(F.avg(F.col(f"`{a}`") * F.col(f"`{b}`")) for a in chosen for b in chosen)).first()
    if n < least:
        return spark.createDataFrame([], schema)
    mean, square = np.asarray(rest[: len(chosen)], float), np.asarray(rest[len(chosen) :], float).reshape(len(chosen), -1)
    cov = square - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    value, vector = np.linalg.eigh(cov / np.outer(sd, sd))
    first = vector[:, -1] * (1 if vector[:, -1].sum() >= 0 else -1)
    return spark.createDataFrame([(b, float(v), float(value[-1] / value.sum())) for b, v in zip(chosen, first, strict=True)], schema)


def ewma(levels: DataFrame, value: str, span: int = 3, gap_min: int = 2 * GRID_MIN) -> DataFrame:
    """Display trend: an exponential mean that starts anew at a gap, a new day or a NULL."""
    alpha = 2.0 / (span + 1)
    w = Window.partitionBy("cusip", day_of(F.col("ns"))).orderBy("ns")
    rows = levels.filter(F.col(value).isNotNull()).select("cusip", "ns", F.col(value).alias("v"))
    rows = rows.withColumn("_new", F.coalesce(F.col("ns") - F.lag("ns").over(w) > gap_min * MINUTE_NS, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("cusip", day_of(F.col("ns")).alias("day"), "_run").agg(F.array_sort(F.collect_list(F.struct("ns", "v"))).alias("r"))
    step: Column = F.aggregate(
        "r", F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<struct<ns:bigint,trend:double>>").alias("out")),
        lambda a, x: F.transform(F.array(F.coalesce(F.lit(alpha) * x["v"] + (1 - alpha) * a["last"], x["v"])), lambda t: F.struct(t.alias("last"), F.concat(a["out"], F.array(F.struct(x["ns"].alias("ns"), t.alias("trend")))).alias("out")))[0],
        lambda a: a["out"],
    )
    return runs.select("cusip", F.explode(step).alias("x")).select("cusip", "x.ns", "x.trend")
