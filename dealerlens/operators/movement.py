"""Movement features: same-dealer differences over a fixed lookback, and votes of the
issuer's other bonds.

Both endpoints are as-of queries of one pass; an endpoint counts if its latest event is
complete and at most ``age_min`` old.  The mapping of bonds to issuers is known only from
its first label on and ends at the first conflicting one; later labels never reach back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AGE_MIN, LOOKBACK_MIN, MINUTE_NS
from ..functions.scalar import day_of, usable_key
from .asof import asof

MOVE_COUNTS = ["common_n", "current_n", "lookback_n", "guarded_common_n"]
MOVE_VALUES = ["mean_bps", "median_bps", "guarded_mean_bps", "up_fraction", "down_fraction", "flat_fraction", "retention", "condition_changed_fraction", "mean_support_age_min", "max_support_age_min"]
ISSUER_COUNTS = ["other_bond_n", "common_dealer_n"]
ISSUER_VALUES = ["mean_bps", "median_bps", "up_fraction", "down_fraction", "flat_fraction", "dispersion_bps", "mean_support_age_min", "max_support_age_min"]
MISSING_LABELS = ("", "unknown", "none", "nan", "<na>")
NEVER = 2**63 - 1


def endpoint_states(events: DataFrame, times: DataFrame, *, lookback_min: int = LOOKBACK_MIN, age_min: float = AGE_MIN, exact: bool = True) -> DataFrame:
    """One row per (cusip, ns, day, side, firm) with a fresh complete state at either end:
    structs ``now`` and ``old``."""
    back = lookback_min * MINUTE_NS
    asked = times.select("cusip", "ns", "day").distinct()
    earlier = asked.select("cusip", (F.col("ns") - back).alias("ns"), "day").filter(day_of(F.col("ns")) == F.col("day"))
    states = asof(events.filter("side in ('bid', 'ask')"), asked.unionByName(earlier), ["complete", "center", "quantity_set", "candidate_count"], exact=exact)
    fresh = states.filter(F.col("complete") & F.col("center").isNotNull() & (F.col("age_min") <= age_min))
    state = F.struct("center", "quantity_set", "candidate_count", "age_min")
    ends = F.array(F.struct(F.lit("now").alias("end"), F.col("ns").alias("at")), F.struct(F.lit("old").alias("end"), (F.col("ns") + back).alias("at")))
    each = fresh.select("cusip", "day", "side", "firm", state.alias("state"), F.explode(ends).alias("x")).select("cusip", "day", "side", "firm", "state", "x.end", F.col("x.at").alias("ns"))
    take = lambda end: F.max(F.when(F.col("end") == end, F.col("state"))).alias(end)
    both = each.groupBy("cusip", "ns", "day", "side", "firm").agg(take("now"), take("old"))
    return both.join(asked, ["cusip", "ns", "day"], "left_semi")


def _sides(values: Column) -> dict[str, Column]:
    return {f"{name}_fraction": F.avg(F.when(values.isNotNull(), test.cast("int"))) for name, test in (("up", values > 0), ("down", values < 0), ("flat", values == 0))}


def direction(states: DataFrame) -> DataFrame:
    """The 14 statistics per (cusip, ns, day, side), and the ages of the guarded dealers."""
    now, old = F.col("now"), F.col("old")
    common = now.isNotNull() & old.isNotNull()
    changed = (now["quantity_set"] != old["quantity_set"]) | (now["candidate_count"] != old["candidate_count"])
    s = states.withColumns(
        {
            "_delta": F.when(common, now["center"] - old["center"]),
            "_guarded": F.when(common & ~changed, now["center"] - old["center"]),
            "_age": F.when(common, F.greatest(now["age_min"], old["age_min"])),
            "_changed": F.when(common, changed.cast("int")),
        }
    )
    held = F.when(F.col("_guarded").isNotNull(), F.col("_age"))
    n = F.count("_delta")
    return s.groupBy("cusip", "ns", "day", "side").agg(
        F.avg("_delta").alias("mean_bps"), F.median("_delta").alias("median_bps"), F.avg("_guarded").alias("guarded_mean_bps"),
        *(c.alias(name) for name, c in _sides(F.col("_delta")).items()),
        n.alias("common_n"), F.count_if(now.isNotNull()).alias("current_n"), F.count_if(old.isNotNull()).alias("lookback_n"), F.count("_guarded").alias("guarded_common_n"),
        F.when(n > 0, n / F.greatest(F.count_if(now.isNotNull()), F.count_if(old.isNotNull()))).alias("retention"),
        F.avg("_changed").alias("condition_changed_fraction"), F.avg("_age").alias("mean_support_age_min"), F.max("_age").alias("max_support_age_min"),
        F.avg(held).alias("guarded_mean_age"), F.max(held).alias("guarded_max_age"),
    )


def issuer_records(queries: DataFrame) -> DataFrame:
    """(cusip, issuer, first_ns, conflict_ns): what was known from when to when."""
    clean = F.trim(F.col("issuer").cast("string"))
    rows = queries.filter("ns is not null and cusip is not null").select("cusip", "ns", F.when(~F.lower(clean).isin(*MISSING_LABELS), clean).alias("label"))
    first = rows.groupBy("cusip").agg(F.min(F.when(F.col("label").isNotNull(), F.col("ns"))).alias("first_ns")).filter("first_ns is not null")
    rows = rows.join(first, "cusip")
    at_first = rows.filter("ns = first_ns").groupBy("cusip", "first_ns").agg(F.count_if(F.col("label").isNull()).alias("gaps"), F.count_distinct("label").alias("labels"), F.min("label").alias("issuer")).filter("gaps = 0 and labels = 1").select("cusip", "issuer")
    seen = rows.join(at_first, "cusip").filter("ns >= first_ns")
    against = F.min(F.when(~F.col("label").eqNullSafe(F.col("issuer")), F.col("ns")))
    return seen.groupBy("cusip", "issuer", "first_ns").agg(F.coalesce(against, F.lit(NEVER)).alias("conflict_ns"))


def _wide(df: DataFrame, keys: list[str], names: list[str], infix: str) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.first(F.when(F.col("side") == s, F.col(n)), ignorenulls=True).alias(f"bcq_{s}_{infix}_{n}") for s in ("bid", "ask") for n in names))


def direction_features(events: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """``queries`` with the 28 direction columns."""
    good = queries.filter(usable_key(F.col("cusip")) & F.col("ns").isNotNull())
    wide = _wide(direction(endpoint_states(events, good, **options)), ["cusip", "ns"], MOVE_VALUES + MOVE_COUNTS, "move")
    out = queries.join(wide, ["cusip", "ns"], "left")
    return out.withColumns({f"bcq_{s}_move_{c}": F.coalesce(f"bcq_{s}_move_{c}", F.lit(0).cast("bigint")) for s in ("bid", "ask") for c in MOVE_COUNTS})


def issuer_votes(events: DataFrame, queries: DataFrame, *, lookback_min: int = LOOKBACK_MIN, **options) -> DataFrame:
    """Per query and side, the votes of the issuer's other bonds: their guarded means.

    Movement is computed once per (donor, time); every query of an issuer's bond at that
    time then sees its donors but itself."""
    records = issuer_records(queries)
    asked = queries.select("row_id", "cusip", "ns", "day").join(records, "cusip").filter("ns >= first_ns and ns < conflict_ns").select("row_id", "cusip", "ns", "day", "issuer")
    donors = records.select(F.col("cusip").alias("donor"), "issuer", "first_ns", "conflict_ns")
    known = (F.col("first_ns") <= F.col("ns") - lookback_min * MINUTE_NS) & (F.col("conflict_ns") > F.col("ns"))
    times = asked.select("issuer", "ns", "day").distinct().join(donors, "issuer").filter(known)
    moves = direction(endpoint_states(events, times.select(F.col("donor").alias("cusip"), "ns", "day"), lookback_min=lookback_min, **options))
    votes = times.join(moves.withColumnRenamed("cusip", "donor").drop("day"), ["donor", "ns"]).filter("guarded_mean_bps is not null")
    seen = asked.join(votes.select("issuer", "ns", "donor", "side", "guarded_mean_bps", "guarded_common_n", "guarded_mean_age", "guarded_max_age"), ["issuer", "ns"]).filter("donor <> cusip")
    v, n = F.col("guarded_mean_bps"), F.count("*")
    two = lambda c: F.when(n >= 2, c)
    return seen.groupBy("row_id", "side").agg(
        two(F.avg(v)).alias("mean_bps"), two(F.median(v)).alias("median_bps"), *(two(c).alias(name) for name, c in _sides(v).items()),
        n.alias("other_bond_n"), F.sum("guarded_common_n").alias("common_dealer_n"), two(F.stddev_pop(v)).alias("dispersion_bps"),
        two(F.avg("guarded_mean_age")).alias("mean_support_age_min"), two(F.max("guarded_max_age")).alias("max_support_age_min"),
    )


def movement_features(events: DataFrame, queries: DataFrame, *, include_issuer: bool = True, **options) -> DataFrame:
    """The sidecar: row_id, cusip, ns and 28 direction columns, with 20 issuer columns."""
    out = direction_features(events, queries.select("row_id", "cusip", "ns", "day"), **options)
    if include_issuer:
        wide = _wide(issuer_votes(events, queries, **options), ["row_id"], ISSUER_VALUES + ISSUER_COUNTS, "issuer_move")
        out = out.join(wide, "row_id", "left")
        out = out.withColumns({f"bcq_{s}_issuer_move_{c}": F.coalesce(f"bcq_{s}_issuer_move_{c}", F.lit(0).cast("bigint")) for s in ("bid", "ask") for c in ISSUER_COUNTS})
    return out.drop("day")


def composition_30m(events: DataFrame, queries: DataFrame, *, lookback_min: int = LOOKBACK_MIN, exact: bool = True) -> DataFrame:
    """Aggregate and common-dealer change per side without a freshness rule: rosters,
    retention and changed conditions between the two ends."""
    states = endpoint_states(events, queries, lookback_min=lookback_min, age_min=float("inf"), exact=exact)
    now, old = F.col("now"), F.col("old")
    common = now.isNotNull() & old.isNotNull()
    changed = common & ((now["quantity_set"] != old["quantity_set"]) | (now["candidate_count"] != old["candidate_count"]))
    g = states.groupBy("cusip", "ns", "day", "side").agg(
        F.count_if(now.isNotNull()).alias("n_now"), F.count_if(old.isNotNull()).alias("n_past"), F.count_if(common).alias("n_common_dealers_30m"), F.count_if(changed).alias("_changed"),
        (F.avg(now["center"]) - F.avg(old["center"])).alias("aggregate_delta_30m"), F.avg(F.when(common, now["center"] - old["center"])).alias("common_dealer_delta_30m"),
    )
    n = F.col("n_common_dealers_30m")
    known = (F.col("n_now") > 0) & (F.col("n_past") > 0)
    g = g.withColumn("composition_changed_30m", F.when(known, (n != F.col("n_now")) | (n != F.col("n_past")) | (F.col("_changed") > 0)))
    return g.withColumns(
        {
            "center_delta_30m": F.when(~F.col("composition_changed_30m"), F.col("aggregate_delta_30m")),
            "common_retention_30m": F.when(F.col("n_now") > 0, n / F.col("n_now")),
            "past_common_retention_30m": F.when(F.col("n_past") > 0, n / F.col("n_past")),
            "common_condition_changed_fraction_30m": F.when(n > 0, F.col("_changed") / n),
        }
    ).drop("_changed")
