"""Choosing what to look at: scopes, issuers, dealers, cases and their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CASE_SEED, CASES_PER_KIND
from ..functions.scalar import label
from .events import annotated_events
from .population import percent_rank, pick_cases

SCOPES = {"SECTOR": "sector", "Issuer": "issuer", "Dealer": "firm"}


def scope_selection(events: DataFrame, universe: DataFrame, scope: str = "Global", value: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, universe) of one sector, issuer or dealer; a dealer keeps the whole universe as its
    denominator.  ``events`` have cusip and firm, ``universe`` cusip, issuer and sector."""
    known = events.join(universe.select("cusip", "issuer", "sector"), "cusip")
    if scope == "Global":
        return known, universe
    column = F.col(SCOPES[scope])
    return known.filter(column == value), universe if scope == "Dealer" else universe.filter(column == value)


def evenly_spaced(df: DataFrame, order: list[str], most: int, by: list[str]) -> DataFrame:
    """At most ``most`` rows of each group of ``by``, evenly spaced in ``order`` from the first to the
    last: places floor(i * (n - 1) / (most - 1))."""
    w = Window.partitionBy(*by)
    x = df.withColumns({"_n": F.count("*").over(w), "_i": (F.row_number().over(w.orderBy(*order)) - 1).cast("bigint")})
    # The place is taken if some i maps to it: the least i not below it lands on it.
    i = F.ceil(F.col("_i") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    taken = (F.col("_n") <= most) | (F.floor(i * (F.col("_n") - 1) / (most - 1)) == F.col("_i"))
    return x.filter(taken).drop("_n", "_i")


def case_events(events: DataFrame, kind: str) -> DataFrame:
    """Annotated events of one kind: single, incomplete, multi, or a quantity class."""
    x = annotated_events(events)
    kinds = {"single": ~F.col("multi") & F.col("complete"), "incomplete": ~F.col("complete"), "multi": F.col("multi")}
    return x.filter(kinds.get(kind, F.col("multi") & (F.col("qclass") == kind)))


def page(df: DataFrame, order: list, number: int, size: int = 50) -> DataFrame:
    """The rows of page ``number`` (from 0) in ``order``: a top-n, not a global sort."""
    if number < 0 or size < 1:
        raise ValueError("pages count from 0 and hold rows")
    return df.orderBy(*order).offset(number * size).limit(size)


def issuer_support(events: DataFrame, universe: DataFrame) -> DataFrame:
    """(issuer, events, multi, gap): keyed events, those of several prices, and the widest gap."""
    x = events.join(universe.select("cusip", "issuer"), "cusip").filter("issuer is not null")
    return x.groupBy("issuer").agg(F.count("*").alias("events"), F.count_if(F.col("candidate_count") > 1).alias("multi"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"))


def promoted_issuers(support: DataFrame, reviewed: list[str], *, least_events: int = 20, top: int = 2) -> DataFrame:
    """(issuer, place, reason), every issuer once: the first by name of each ``reviewed`` prefix, then
    the ``top`` supported issuers by events of several prices, gap and events, then all others by name."""
    n = len(reviewed)
    prefix = F.lit(None).cast("int")
    for i, text in reversed(list(enumerate(reviewed))):
        prefix = F.when(F.upper("issuer").startswith(text.upper()), i).otherwise(prefix)
    known = support.withColumn("p", prefix).filter("p is not null").groupBy("p").agg(F.min("issuer").alias("issuer"))
    parts = known.select("issuer", F.col("p").alias("rank"), F.lit("Reviewed case").alias("reason"))
    for k, measure in enumerate(("multi", "gap", "events")):
        best = support.filter(F.col("events") >= least_events).orderBy(F.desc(measure), "issuer").limit(top)  # a top-n
        place = F.row_number().over(Window.orderBy(F.desc(measure), "issuer"))
        parts = parts.unionByName(best.select("issuer", (place + n + k * top).alias("rank"), F.lit(f"High {measure}").alias("reason")))
    first = parts.groupBy("issuer").agg(F.min(F.struct("rank", "reason")).alias("x")).select("issuer", "x.*")
    return support.select("issuer").join(first, "issuer", "left").select("issuer", F.coalesce("rank", F.lit(n + 3 * top + 1)).alias("place"), "reason")


def dealer_order(events: DataFrame) -> DataFrame:
    """(firm, multi, events): dealers with most events of several prices first, then most events."""
    g = events.groupBy("firm").agg(F.count_if(F.col("candidate_count") > 1).alias("multi"), F.count("*").alias("events"))
    return g.orderBy(F.desc("multi"), F.desc("events"), "firm")


def traded_issuers(events: DataFrame, universe: DataFrame) -> DataFrame:
    """Every traded issuer with its bonds, trades, and the events seen of them (0 if none)."""
    seen = issuer_support(events, universe)
    u = universe.groupBy("issuer").agg(F.count("*").alias("bonds"), F.sum("trade_rows").alias("trade_rows"))
    return u.join(seen, "issuer", "left").select("issuer", "bonds", "trade_rows", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "multi")), "gap")


def with_trade_counts(coverage: DataFrame, trades: DataFrame, start_ns: Column, end_ns: Column) -> DataFrame:
    """Adds ``n_trades`` and ``window_trades`` (between two instants, both included) per bond."""
    g = trades.groupBy("cusip").agg(F.count("*").alias("n_trades"), F.count_if(F.col("ns").between(start_ns, end_ns)).alias("window_trades"))
    x = coverage.join(g, "cusip", "left")
    return x.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_trades", "window_trades")})


def position_bands(bonds: DataFrame, bands: int = 4) -> DataFrame:
    """(band, n, liquid, sparse): bonds in order of tenor cut at the quantiles of their positions, and of
    each band the bonds of most and fewest trades (other than the first).  A bond a row; ties by cusip."""
    x = bonds.withColumn("_i", F.row_number().over(Window.orderBy(F.asc_nulls_last("tenor"), "cusip")) - 1)
    last = F.count("*").over(Window.partitionBy()) - 1
    # Right-closed bands of the positions 0 to n - 1.
    x = x.withColumn("band", F.when(F.col("_i") == 0, 0).otherwise(F.ceil(F.col("_i") * bands / last) - 1).cast("int"))
    best = F.struct(-F.col("n_trades"), F.col("cusip"))
    g = x.withColumn("_liquid", F.min_by("cusip", best).over(Window.partitionBy("band")))
    other = F.when(F.col("cusip") != F.col("_liquid"), F.struct(F.col("n_trades").alias("t"), F.col("cusip").alias("c")))
    return g.groupBy("band").agg(F.count("*").alias("n"), F.min("_liquid").alias("liquid"), F.min(other)["c"].alias("sparse"))


METRICS = ["quoted_fraction", "mean_dealer_count", "mean_candidate_gap", "unknown_quantity_fraction"]


def trade_case_candidates(frame: DataFrame, impacts: DataFrame, seed: int = CASE_SEED) -> DataFrame:
    """Bond-side-days of trade queries with their support, measured rule effects and the distance
    to their stratum's medians in units of its ranges.  ``frame`` has query features, issuer, sector."""
    sides = F.array(*(F.struct(
        F.lit(s).alias("side"), F.when(F.col(f"bcq_{s}_n_dealers") >= 0, F.col(f"bcq_{s}_n_dealers")).alias("dealers"), F.col(f"bcq_{s}_mean_candidate_gap").alias("gap"),
        F.col(f"bcq_{s}_unknown_quantity_fraction").alias("unknown")) for s in ("bid", "ask")))
    x = frame.select("cusip", "day", label(F.col("issuer"), None).alias("issuer"), label(F.col("sector"), None).alias("sector"), F.explode(sides).alias("x")).select("cusip", "day", "issuer", "sector", "x.*")
    one = lambda c, missing, conflict: F.when(F.min(c) != F.max(c), conflict).otherwise(F.coalesce(F.min(c), F.lit(missing))).alias(c)
    g = x.groupBy("cusip", "side", "day").agg(
        F.count("*").alias("trade_queries"), F.count("dealers").alias("known_support_queries"), F.avg((F.col("dealers") > 0).cast("int")).alias("quoted_fraction"), F.avg("dealers").alias("mean_dealer_count"),
        F.avg("gap").alias("mean_candidate_gap"), F.avg("unknown").alias("unknown_quantity_fraction"), one("issuer", "[Missing issuer]", "[Conflicting issuer]"), one("sector", "Unknown", "Conflicting"),
    )
    activity = F.when(F.col("trade_queries") <= 3, "Sparse").when(F.col("trade_queries") <= 30, "Medium").otherwise("Active")
    case_id = F.concat_ws("|", "cusip", "side", F.col("day").cast("string"))
    g = g.withColumns({"activity": activity, "case_id": case_id}).withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}|"), F.col("case_id")), 256))
    g = g.join(impacts.select("cusip", "side", "day", "max_center_effect_bps", "coverage_loss_fraction"), ["cusip", "side", "day"], "left")
    stratum = ["sector", "activity"]
    strata = g.groupBy(*stratum).agg(*(f.alias(f"_{k}_{m}") for m in METRICS for k, f in (("med", F.median(m)), ("range", F.max(m) - F.min(m)))))
    g = g.join(strata, stratum)
    far = sum((F.coalesce(F.abs(F.col(m) - F.col(f"_med_{m}")) / F.when(F.col(f"_range_{m}") == 0, 1.0).otherwise(F.col(f"_range_{m}")), F.lit(0.0)) for m in METRICS), F.lit(0.0))
    return g.withColumn("typical", far).drop(*(f"_{k}_{m}" for m in METRICS for k in ("med", "range")))


#: Support states that the random cases should hold, in Spark and on a driver's row.
_NEEDS = (
    ("quoted_fraction = 0", lambda r: r["quoted_fraction"] == 0),
    ("trade_queries <= 3", lambda r: r["trade_queries"] <= 3),
    ("unknown_quantity_fraction > 0", lambda r: (r["unknown_quantity_fraction"] or 0) > 0),
)
_SHIFTED = (
    "quoted_fraction > 0 and (max_center_effect_bps > 1e-9 or coverage_loss_fraction > 0)",
    lambda r: (r["quoted_fraction"] or 0) > 0 and ((r["max_center_effect_bps"] or 0) > 1e-9 or (r["coverage_loss_fraction"] or 0) > 0),
)


def trade_case_manifest(candidates: DataFrame, n: int = CASES_PER_KIND) -> DataFrame:
    """Random, typical and high-impact bond-side-days for navigation, at most two of an issuer unless
    nothing else is left (``issuer_cap_relaxed``).  No dealer is known on this level."""
    high = candidates.filter(_SHIFTED[0])
    ranks = percent_rank(percent_rank(high, "max_center_effect_bps", "_ra"), "coverage_loss_fraction", "_rb")
    impact = ranks.select("case_id", (F.col("_ra") + F.col("_rb")).alias("impact"))
    scored = candidates.join(impact, "case_id", "left").withColumn("firm", F.lit(None).cast("string"))
    found = pick_cases(scored, n, needs=_NEEDS, shifted=_SHIFTED, caps=("issuer",), relax_needs=False)
    many = {r["issuer"] for _, _, r in found if sum(x["issuer"] == r["issuer"] for _, _, x in found) > 2}
    out = [(i + 1, kind, r["case_id"], r["cusip"], r["side"], str(r["day"]), r["issuer"], r["sector"], r["activity"], r["issuer"] in many) for i, (kind, _, r) in enumerate(found)]
    return candidates.sparkSession.createDataFrame(out, "case_number int, selection string, case_id string, cusip string, side string, day string, issuer string, sector string, activity string, issuer_cap_relaxed boolean")
