"""Set-valued dealer events and their causal history.

Rows with the same firm, cusip, side and time are one event that holds the *set* of its
distinct spreads.  History looks backward only, within one series and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HISTORY_GAP_MIN, LOOKBACK_MIN, MINUTE_NS, SERIES
from ..functions.scalar import coerce, is_unknown_tag, minutes, quantity_kind, quantity_tag, sorted_median, usable_key

SERIES_DAY = [*SERIES, "day"]


def normalized(quotes: DataFrame) -> DataFrame:
    """Adds ``s`` (finite spread), ``q`` (finite quantity), ``qkind`` and ``qtag``."""
    types = dict(quotes.dtypes)
    spread = coerce(F.col("spread"), types["spread"])
    number = coerce(F.col("quantity"), types["quantity"])
    return quotes.withColumns({"s": spread, "q": number, "qkind": quantity_kind(F.col("quantity"), number), "qtag": quantity_tag(F.col("quantity"), number)})


def keyed(quotes: DataFrame) -> DataFrame:
    """Rows whose firm, cusip, side and time are all present and not blank."""
    good = F.col("ns").isNotNull()
    for key in SERIES:
        good = good & usable_key(F.col(key))
    return quotes.filter(good)


def unkeyed_count(quotes: DataFrame) -> DataFrame:
    return quotes.agg(F.count("*").alias("raw_rows")).crossJoin(keyed(quotes).agg(F.count("*").alias("keyed_rows"))).select("raw_rows", (F.col("raw_rows") - F.col("keyed_rows")).alias("unkeyed_rows"))


def dealer_events(quotes: DataFrame) -> DataFrame:
    """One row per event.  Full-row repeats are counted over every column of ``quotes``:
    equal rows are combined first, on the map side, with their number."""
    source = quotes.columns
    rows = normalized(keyed(quotes).groupBy(*source).agg(F.count("*").alias("_n")))
    pair = F.struct("s", "qtag")
    events = rows.groupBy(*SERIES, "ns", "day").agg(
        F.sum("_n").alias("rows"),
        F.sum(F.col("_n") - 1).alias("repeats"),
        F.sum(F.when(F.col("s").isNull(), F.col("_n")).otherwise(0)).alias("bad"),
        F.array_sort(F.collect_set("s")).alias("spread_set"),
        F.array_sort(F.collect_set("qtag")).alias("quantity_set"),
        F.array_sort(F.collect_set(pair)).alias("pair_set"),
    )
    return with_candidate_stats(events)


def with_candidate_stats(events: DataFrame) -> DataFrame:
    sets = F.col("spread_set")
    return (
        events.withColumn("candidate_count", F.size(sets))
        .withColumns({"lo": F.get(sets, 0), "hi": F.element_at(F.when(F.size(sets) > 0, sets), -1), "center": sorted_median(sets)})
        .withColumns(
            {
                "gap": F.col("hi") - F.col("lo"),
                "center_nearest_gap": F.array_min(F.transform(sets, lambda s: F.abs(s - F.col("center")))),
                "complete": (F.col("bad") == 0) & (F.col("candidate_count") > 0),
            }
        )
    )


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def event_history(events: DataFrame) -> DataFrame:
    """Breaks, refresh and change flags, guarded deltas, ABA, change age and the number of
    changes in the left-open last 30 minutes.  One shuffle by series and day."""
    w = Window.partitionBy(*SERIES_DAY).orderBy("ns")
    prev = lambda c: F.lag(c).over(w)
    d = events.withColumns(
        {
            "_ns": prev("ns"), "_spreads": prev("spread_set"), "_quantities": prev("quantity_set"), "_pairs": prev("pair_set"), "_complete": prev("complete"),
            "_count": prev("candidate_count"), "_center": prev("center"), "_lo": prev("lo"), "_hi": prev("hi"), "_pairs2": F.lag("pair_set", 2).over(w),
        }
    )
    d = d.withColumn("interval_min", minutes(F.col("ns") - F.col("_ns")))
    steady = F.coalesce((F.col("interval_min") <= HISTORY_GAP_MIN) & F.col("complete") & F.col("_complete"), F.lit(False))
    d = d.withColumn("history_break", ~steady)
    on = ~F.col("history_break")
    d = d.withColumns(
        {
            "spread_changed": on & _differs(F.col("spread_set"), F.col("_spreads")),
            "pair_refresh": on & F.col("pair_set").eqNullSafe(F.col("_pairs")),
            "condition_changed": on & (_differs(F.col("quantity_set"), F.col("_quantities")) | _differs(F.col("candidate_count"), F.col("_count"))),
        }
    )
    guarded = on & ~F.col("condition_changed")
    d = d.withColumns(
        {
            "center_delta": F.when(on, F.col("center") - F.col("_center")),
            "guarded_delta": F.when(guarded, F.col("center") - F.col("_center")),
            "lo_delta": F.when(guarded, F.col("lo") - F.col("_lo")),
            "hi_delta": F.when(guarded, F.col("hi") - F.col("_hi")),
            "observed_aba": on & F.coalesce(~F.lag("history_break").over(w), F.lit(False)) & F.col("pair_set").eqNullSafe(F.col("_pairs2")) & _differs(F.col("pair_set"), F.col("_pairs")),
            "_segment": F.sum(F.col("history_break").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    segment = Window.partitionBy(*SERIES_DAY, "_segment").orderBy("ns")
    recent = segment.rangeBetween(-(LOOKBACK_MIN * MINUTE_NS - 1), 0)
    d = d.withColumns(
        {
            "history_start": F.min("ns").over(segment),
            "last_change": F.max(F.when(F.col("spread_changed"), F.col("ns"))).over(segment.rowsBetween(Window.unboundedPreceding, 0)),
            "changes_30m": F.coalesce(F.sum(F.col("spread_changed").cast("bigint")).over(recent), F.lit(0).cast("bigint")),
        }
    )
    d = d.withColumns({"change_age_min": minutes(F.col("ns") - F.col("last_change")), "change_age_unknown": F.col("last_change").isNull()})
    return d.drop(*(c for c in d.columns if c.startswith("_")))


def prepare_events(quotes: DataFrame) -> DataFrame:
    return event_history(dealer_events(quotes))


def quantity_kinds(quotes: DataFrame) -> DataFrame:
    return normalized(quotes).groupBy("firm", "qkind").agg(F.count("*").alias("rows"))


def group_quotes(quotes: DataFrame) -> DataFrame:
    """Light grouping: ranges and quantity classes per event, without history."""
    q = normalized(keyed(quotes))
    zero, unknown = F.col("qkind") == "Zero", F.col("qkind").isin("Missing", "Other")
    g = q.groupBy(*SERIES, "ns").agg(
        F.count("*").alias("rows"),
        F.count_distinct("s").alias("n_spreads"),
        F.min("s").alias("lo"),
        F.max("s").alias("hi"),
        F.count_distinct("qtag").alias("n_quantity"),
        F.bool_or(zero).alias("has_zero"),
        F.bool_and(zero).alias("all_zero"),
        F.bool_or(unknown).alias("has_unknown"),
        F.sum(F.col("s").isNull().cast("bigint")).alias("bad"),
    )
    return g.withColumns({"range": F.col("hi") - F.col("lo"), "multi": F.col("n_spreads") > 1}).withColumn("qclass", quantity_class())


def quantity_class() -> Column:
    return F.when(F.col("has_unknown"), "unknown").when(F.col("has_zero"), "zero").when(F.col("n_quantity") > 1, "different").otherwise("same")


def annotated_events(events: DataFrame) -> DataFrame:
    """Events with ``multi``, same-positive-size ambiguity and quantity classes."""
    tags = F.col("quantity_set")
    positive = F.filter("pair_set", lambda p: p["qtag"].startswith("q=") & p["s"].isNotNull())
    ambiguous = F.exists(positive, lambda a: F.exists(positive, lambda b: (a["qtag"] == b["qtag"]) & (a["s"] != b["s"])))
    return events.withColumns(
        {
            "multi": F.col("candidate_count") > 1,
            "same_positive_multi": ambiguous,
            "has_zero": F.array_contains(tags, "Zero"),
            "all_zero": F.forall(tags, lambda t: t == "Zero"),
            "has_unknown": F.exists(tags, is_unknown_tag),
            "n_quantity": F.size(tags),
        }
    ).withColumn("qclass", quantity_class())


def quantity_evidence(quotes: DataFrame) -> DataFrame:
    """Cells per (event, size): range, center and count of distinct spreads; the residual to
    the event's median only where every size is positive and has one spread."""
    q = normalized(keyed(quotes))
    cells = q.groupBy(*SERIES, "ns", "qtag").agg(F.array_sort(F.collect_set("s")).alias("set"), F.sum(F.col("s").isNull().cast("int")).alias("bad"))
    cells = cells.select(*SERIES, "ns", "qtag", "bad", F.size("set").alias("n_spreads"), F.array_min("set").alias("lo"), F.array_max("set").alias("hi"), sorted_median(F.col("set")).alias("center"))
    event = Window.partitionBy(*SERIES, "ns")
    clean = (F.sum("bad").over(event) == 0) & (F.count("*").over(event) >= 2) & F.min((F.col("qtag").startswith("q=") & (F.col("n_spreads") == 1)).cast("int")).over(event).cast("boolean")
    return cells.withColumn("residual", F.when(clean, F.col("center") - F.median("center").over(event))).drop("bad")
