"""Universe, coverage tables with explicit denominators, and case scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import AGE_MIN, CASE_SEED, CASES_PER_KIND
from ..functions.scalar import label, usable_key
from .events import annotated_events, normalized
from .side import side_features, slots

SCOPES = ("Global", "SECTOR", "Issuer", "Dealer")


def bond_universe(trades: DataFrame) -> DataFrame:
    """One row per traded bond; a label holds only if it is the bond's single one."""
    one = lambda c: F.when(F.count_distinct(label(F.col(c))) == 1, F.min(label(F.col(c)))).when(F.count_distinct(label(F.col(c))) > 1, "Conflicting").otherwise("Unknown")
    return trades.filter(usable_key(F.col("cusip"))).groupBy(F.trim("cusip").alias("cusip")).agg(one("issuer").alias("issuer"), one("sector").alias("sector"), F.count("*").alias("trade_rows"))


def _by_scope(df: DataFrame, dealer: bool = True) -> DataFrame:
    """Each row once per scope: (scope, entity) next to its columns."""
    names = {"Global": F.lit("All"), "SECTOR": F.col("sector"), "Issuer": F.col("issuer")}
    if dealer:
        names["Dealer"] = label(F.col("firm"), "[Missing dealer]")
    each = [F.struct(F.lit(scope).alias("scope"), entity.alias("entity")) for scope, entity in names.items()]
    return df.withColumn("_x", F.explode(F.array(*each))).select("*", "_x.scope", "_x.entity").drop("_x")


def event_population(events: DataFrame, universe: DataFrame) -> DataFrame:
    """Event counts and rates per scope, from events with history.

    Events are counted once per dealer-bond-side-day; all scopes, distinct counts and
    equal-weight rates then come from these much fewer rows."""
    e = annotated_events(events).join(universe.select("cusip", "issuer", "sector"), "cusip")
    flags = {
        "multi_events": F.col("multi"), "same_positive_multi_events": F.col("same_positive_multi"), "unknown_quantity_events": F.col("has_unknown"), "zero_quantity_events": F.col("has_zero"),
        "incomplete_events": ~F.col("complete"), "history_breaks": F.col("history_break"), "pair_refreshes": F.col("pair_refresh"), "spread_changes": F.col("spread_changed"), "aba_events": F.col("observed_aba"),
        **{f"quantity_event_{q}": F.col("qclass") == q for q in ("same", "different", "zero", "unknown")},
    }
    sums = ["events", "repeats", *flags]
    units = e.groupBy("cusip", "firm", "side", "day", "issuer", "sector").agg(F.count("*").alias("events"), F.sum("repeats").cast("bigint").alias("repeats"), *(F.count_if(c).alias(n) for n, c in flags.items()))
    x = _by_scope(units)
    affected = F.col("multi_events") > 0
    base = x.groupBy("scope", "entity").agg(
        *(F.sum(c).alias(c) for c in sums), F.count_distinct("issuer").alias("observed_issuers"), F.count_distinct("firm").alias("observed_dealers"), F.count_distinct("cusip").alias("keyed_bonds"),
        F.count_distinct("cusip", "day").alias("observed_bond_days"), F.count_distinct(F.when(affected, F.struct("cusip", "day"))).alias("affected_bond_days"),
        F.count("*").alias("dealer_bond_side_days"), F.count_if(affected).alias("affected_dealer_bond_side_days"), F.avg(F.col("multi_events") / F.col("events")).alias("unit_equal_multi_rate"),
    )
    equal = lambda by, name: x.groupBy("scope", "entity", F.col(by).alias("_by")).agg((F.sum("multi_events") / F.sum("events")).alias("_r")).groupBy("scope", "entity").agg(F.avg("_r").alias(name))
    total = units.agg(F.sum("events").alias("_all"))
    out = base.join(equal("issuer", "issuer_equal_multi_rate"), ["scope", "entity"]).join(equal("firm", "dealer_equal_multi_rate"), ["scope", "entity"]).join(F.broadcast(total), F.lit(True))
    return out.withColumns(
        {
            "multi_event_rate": F.col("multi_events") / F.col("events"),
            "affected_unit_rate": F.col("affected_dealer_bond_side_days") / F.col("dealer_bond_side_days"),
            "share_of_all_events": F.col("events") / F.col("_all"),
        }
    ).drop("_all")


def raw_population(quotes: DataFrame, universe: DataFrame) -> DataFrame:
    """Raw rows per scope by quantity kind, whether they have a full key or not."""
    q = normalized(quotes).join(universe.select("cusip", "issuer", "sector"), "cusip")
    bad = ~(usable_key(F.col("firm")) & usable_key(F.col("side")) & F.col("ns").isNotNull())
    kinds = [F.count_if(F.col("qkind") == k).alias(f"raw_{k.lower()}_rows") for k in ("Positive", "Zero", "Missing", "Other")]
    g = _by_scope(q).groupBy("scope", "entity").agg(F.count("*").alias("raw_rows"), F.count_if(bad).alias("unkeyed_rows"), F.count_distinct("cusip").alias("quoted_bonds"), *kinds)
    return g.withColumns({f"raw_{k}_share": F.col(f"raw_{k}_rows") / F.col("raw_rows") for k in ("positive", "zero", "missing", "other")})


def trade_day_coverage(trades: DataFrame, quotes: DataFrame, universe: DataFrame) -> DataFrame:
    """Traded bond-days per scope (no dealer), those with quotes, and those outside the days
    that the quotes span."""
    days = trades.select(F.trim("cusip").alias("cusip"), "day").distinct().join(universe.select("cusip", "issuer", "sector"), "cusip")
    seen = quotes.filter("day is not null").select("cusip", "day").distinct().withColumn("_quoted", F.lit(True))
    span = quotes.agg(F.min("day").alias("_low"), F.max("day").alias("_high"))
    d = days.join(seen, ["cusip", "day"], "left").join(F.broadcast(span), F.lit(True))
    g = _by_scope(d, dealer=False).groupBy("scope", "entity")
    return g.agg(
        F.count_distinct("cusip").alias("traded_bonds"), F.count_distinct("issuer").alias("traded_issuers"), F.count("*").alias("traded_bond_days"), F.count_if("_quoted").alias("covered_traded_bond_days"),
        F.count_distinct(F.when(F.col("_quoted"), F.col("cusip"))).alias("covered_bonds"), F.count_if((F.col("day") < F.col("_low")) | (F.col("day") > F.col("_high"))).alias("outside_file_window_trade_days"),
        F.count_if(F.col("_low").isNull()).alias("unknown_window_trade_days"),
    ).withColumn("day_coverage", F.col("covered_traded_bond_days") / F.col("traded_bond_days"))


def case_candidates(events: DataFrame, universe: DataFrame) -> DataFrame:
    """Dealer-bond-side-days with their rates, stratum and a stable hash order."""
    e = annotated_events(events).join(universe.select("cusip", "issuer", "sector"), "cusip")
    rate = lambda c: F.avg(F.col(c).cast("int"))
    g = e.groupBy("firm", "cusip", "side", "day", "issuer", "sector").agg(F.count("*").alias("events"), rate("multi").alias("multi_rate"), rate("has_unknown").alias("unknown_rate"), rate("pair_refresh").alias("refresh_rate"))
    sides = F.size(F.collect_set("side").over(Window.partitionBy("firm", "cusip", "day")))
    activity = F.when(F.col("events") <= 3, "1-3").when(F.col("events") <= 30, "4-30").otherwise("31+")
    case_id = F.concat_ws("|", "firm", "cusip", "side", F.col("day").cast("string"))
    g = g.withColumns({"one_sided_day": sides == 1, "activity": activity, "case_id": case_id})
    return g.withColumn("hash", F.sha2(F.concat(F.lit(f"{CASE_SEED}|"), F.col("case_id")), 256))


def rule_impacts(events: DataFrame, age_min: float = AGE_MIN) -> DataFrame:
    """Per bond, side and day, the rules' effect at the first, middle and last event time."""
    times = events.filter("side in ('bid', 'ask')").select("cusip", "side", "day", "ns").distinct()
    w = Window.partitionBy("cusip", "side", "day")
    n = F.count("*").over(w)
    at = F.row_number().over(w.orderBy("ns")) - 1
    chosen = times.withColumns({"_n": n, "_at": at}).filter((F.col("_at") == 0) | (F.col("_at") == F.floor(F.col("_n") / 2)) | (F.col("_at") == F.col("_n") - 1)).select("cusip", "side", "day", "ns")
    f = side_features(slots(events, chosen.select("cusip", "ns", "day")), age_min).join(chosen, ["cusip", "side", "day", "ns"], "left_semi")
    base = F.col("center_equal")
    effect = F.greatest(*(F.abs(F.col(c) - base) for c in ("center_decay", "center_max_age", "center_candidate_clip", "center_dealer_downweight")))
    lost = F.when(F.col("n_dealers") > 0, 1 - F.col("n_fresh_dealers") / F.col("n_dealers"))
    return f.withColumns({"_e": effect, "_l": lost}).groupBy("cusip", "side", "day").agg(F.max("_e").alias("max_center_effect_bps"), F.avg("_e").alias("mean_center_effect_bps"), F.avg("_l").alias("coverage_loss_fraction"), F.count("*").alias("impact_queries"))


def percent_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds ``name``: the percent rank of ``column`` with ties at their mean rank, NULL for NULL.  From
    counts per value: only the distinct values are ordered."""
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_c").over(Window.partitionBy())
    ranks = values.select("_v", ((upto - (F.col("_c") - 1) / 2) / total).alias(name))
    return df.join(ranks, df[column] == F.col("_v"), "left").drop("_v")


def scored_cases(candidates: DataFrame, impacts: DataFrame) -> DataFrame:
    """Candidates with ``typical`` (distance to the stratum's medians) and ``impact`` (sum of
    two average-tie percent ranks)."""
    c = candidates.join(impacts, ["cusip", "side", "day"], "left")
    stratum = Window.partitionBy("sector", "activity")
    distance = sum((F.abs(F.col(m) - F.median(m).over(stratum)) for m in ("multi_rate", "unknown_rate", "refresh_rate")), F.lit(0.0))
    for name, source in (("_ra", "max_center_effect_bps"), ("_rb", "coverage_loss_fraction")):
        c = percent_rank(c, source, name)
    return c.withColumns({"typical": distance, "impact": F.coalesce("_ra", F.lit(0.0)) + F.coalesce("_rb", F.lit(0.0))}).drop("_ra", "_rb")


def _pick(rows: list, order, used: list, n: int, requirements=(), caps=("firm", "issuer"), relax_needs: bool = True) -> list:
    """Round robin over strata in ``order``; requirements first; at most two cases of a
    dealer and of an issuer, a limit that falls only when nothing else is left."""
    left, out = sorted(rows, key=order), []
    crowded = lambda r, limit: any(sum(u[k] == r[k] for u in [*used, *out]) >= limit for k in caps)
    taken = lambda r: any(u["case_id"] == r["case_id"] for u in [*used, *out])
    for need in requirements:
        found = next((r for limit in (2, n + len(used) + 1)[: 1 + relax_needs] for r in left if need(r) and not taken(r) and not crowded(r, limit)), None)
        if found is not None and len(out) < n:
            out.append(found)
    for limit in (2, n + len(used) + 1):
        moved = True
        while moved and len(out) < n:
            moved = False
            for stratum in dict.fromkeys((r["sector"], r["activity"]) for r in left):
                found = next((r for r in left if (r["sector"], r["activity"]) == stratum and not taken(r) and not crowded(r, limit)), None)
                if found is not None and len(out) < n:
                    out.append(found)
                    moved = True
    return out


#: What each kind may take, as a condition in Spark and on a driver's row, and its order.
_NEEDS = (("events <= 3", lambda r: r["events"] <= 3), ("one_sided_day", lambda r: r["one_sided_day"]), ("unknown_rate > 0", lambda r: r["unknown_rate"] > 0))
_SHIFTED = ("max_center_effect_bps > 1e-9 or coverage_loss_fraction > 0", lambda r: (r["max_center_effect_bps"] or 0) > 1e-9 or (r["coverage_loss_fraction"] or 0) > 0)


def picked_cases(rows: list, n: int, *, needs=_NEEDS, shifted=_SHIFTED, caps=("firm", "issuer"), relax_needs: bool = True) -> list:
    """(kind, place, row) of the greedy pick of all kinds."""
    used: list = []
    kinds = (
        ("Random", lambda r: r["hash"], rows, [need for _, need in needs]),
        ("Typical", lambda r: (r["typical"], r["hash"]), rows, ()),
        ("High impact", lambda r: (r["impact"] is None, -(r["impact"] or 0), r["hash"]), [r for r in rows if shifted[1](r)], ()),
    )
    out = []
    for kind, key, pool, wanted in kinds:
        found = _pick(pool, key, used, n, wanted, caps, relax_needs)
        used += found
        out += [(kind, i + 1, r) for i, r in enumerate(found)]
    return out


def _first_free(pool: DataFrame, key, n: int) -> DataFrame:
    """Rows of each stratum that hold the first one in order of ``key`` that is left, whatever at most
    3 n cases are taken and whatever dealers and issuers have two of them.

    At most 3 n / 2 dealers and as many issuers are barred.  So the first free row is among the
    first 3 n + 1 of its dealer and issuer; that pair is among the first ``most`` issuers of its dealer and
    the first ``most`` dealers of its issuer; and of such pairs at most 3 n * most are
    barred, 3 n taken."""
    taken, barred = 3 * n, 3 * n // 2
    most = barred + taken + 1
    stratum = ["sector", "activity"]
    over = lambda *c: Window.partitionBy(*stratum, *c)
    x = pool.withColumn("_k", key)
    x = x.withColumns({"_any": F.row_number().over(over().orderBy("_k")), "_own": F.row_number().over(over("firm", "issuer").orderBy("_k")), "_first": F.min("_k").over(over("firm", "issuer"))})
    x = x.filter((F.col("_own") <= taken + 1) | (F.col("_any") <= taken + 1))
    x = x.withColumns({"_i": F.dense_rank().over(over("firm").orderBy("_first")), "_f": F.dense_rank().over(over("issuer").orderBy("_first"))})
    near = (F.col("_own") <= taken + 1) & (F.col("_i") <= most) & (F.col("_f") <= most)
    x = x.withColumn("_near", near).filter(F.col("_near") | (F.col("_any") <= taken + 1))
    x = x.withColumn("_p", F.dense_rank().over(over("_near").orderBy("_first")))
    return x.filter((F.col("_near") & (F.col("_p") <= 2 * barred * most + taken + 1)) | (F.col("_any") <= taken + 1)).select(*pool.columns)


def pick_cases(scored: DataFrame, n: int, *, needs=_NEEDS, shifted=_SHIFTED, **rules) -> list:
    """(kind, place, row) of the pick over all rows of ``scored``.  Of each stratum only rows that the
    pick can reach come to the driver, a number that depends on ``n`` alone."""
    scored = scored.persist()
    random, typical, impact = F.struct("hash"), F.struct("typical", "hash"), F.struct(F.col("impact").isNull().alias("none"), (-F.col("impact")).alias("i"), "hash")
    parts = [_first_free(scored, random, n), *(_first_free(scored.filter(c), random, n) for c, _ in needs), _first_free(scored, typical, n), _first_free(scored.filter(shifted[0]), impact, n)]
    rows = list({r["case_id"]: r.asDict() for part in parts for r in part.collect()}.values())
    scored.unpersist()
    return picked_cases(rows, n, needs=needs, shifted=shifted, **rules)


def case_manifest(scored: DataFrame, n: int = CASES_PER_KIND) -> DataFrame:
    """Random, typical and high-impact cases; the result is that of all rows."""
    out = [(kind, i, r["case_id"], r["firm"], r["cusip"], r["side"], str(r["day"]), r["sector"], r["activity"]) for kind, i, r in pick_cases(scored, n)]
    return scored.sparkSession.createDataFrame(out, "kind string, place int, case_id string, firm string, cusip string, side string, day string, sector string, activity string")


def issuer_choices(events: DataFrame, universe: DataFrame, *, least_events: int = 100, least_days: int = 2, least_dealers: int = 2, least_multi: int = 5, top: int = 2) -> DataFrame:
    """The ``top`` supported issuers by each of four measures, with the first that names them."""
    e = annotated_events(events).join(universe.select("cusip", "issuer"), "cusip")
    g = e.groupBy("issuer").agg(F.count("*").alias("events"), F.count_distinct("day").alias("days"), F.count_distinct("firm").alias("dealers"), F.count_if("multi").alias("multi"), F.avg(F.col("multi").cast("int")).alias("multi_rate"), F.avg(F.col("has_unknown").cast("int")).alias("unknown_rate"))
    g = g.filter((F.col("events") >= least_events) & (F.col("days") >= least_days) & (F.col("dealers") >= least_dealers) & (F.col("multi") >= least_multi))
    measures = ["events", "multi_rate", "unknown_rate", "dealers"]
    ranked = g.withColumn("_m", F.explode(F.array(*(F.struct(F.lit(i).alias("p"), F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for i, m in enumerate(measures))))).select("issuer", "_m.*")
    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy("measure").orderBy(F.desc("v"), "issuer"))).filter(F.col("_r") <= top).groupBy("issuer").agg(F.min_by("measure", "p").alias("measure"))
