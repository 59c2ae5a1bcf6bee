"""Evaluation diagnostics on predictions (row_id, model, pred, truth, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import label


def bins(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """Right-closed bins; missing and negative values are Unknown."""
    out = F.when(value.isNull() | (value < 0), "Unknown")
    for edge, name in edges:
        out = out.when(value <= edge, name)
    return out.otherwise(last)


AGE_BINS = ([(5, "0-5"), (30, "5-30")], ">30")
GAP_BINS = ([(0, "0"), (2, "0-2"), (10, "2-10")], ">10")
DEALER_BINS = ([(0, "0"), (1, "1"), (3, "2-3")], "4+")
ISSUER_BINS = ([(20, "1-20"), (100, "21-100"), (500, "101-500")], "500+")
SIZE_BINS = ([(100_000, "<=100K"), (999_999.99, "100K-1MM")], ">=1MM")


def state_families(frame: DataFrame) -> DataFrame:
    """Each row once per family: (family, state) next to its columns.  ``frame`` has the
    query features, sector, quantity, trade_type and issuer."""
    frame = frame.withColumn("_per_issuer", F.count("*").over(Window.partitionBy("issuer")))
    dealers = F.col("bcq_bid_n_dealers") + F.col("bcq_ask_n_dealers")
    yes = lambda c: F.when(c.isNull(), "Unknown").when(c > 0, "Some").otherwise("None")
    families: dict[str, Column] = {
        "support_state": F.when(F.col("bcq_is_quoted") == 0, "Unquoted").when((F.col("bcq_bid_n_dealers") > 0) & (F.col("bcq_ask_n_dealers") > 0), "Two-sided").otherwise("One-sided"),
        "dealer_support": bins(dealers, *DEALER_BINS),
        "peer_support": bins(F.col("bcq_bid_n_peer_supported") + F.col("bcq_ask_n_peer_supported"), *DEALER_BINS),
        "paired_support": bins(F.col("bcq_n_pair"), *DEALER_BINS),
        "issuer_trade_count": bins(F.col("_per_issuer"), *ISSUER_BINS),
        "SECTOR": label(F.col("sector"), "Unknown"),
        "trade_size": bins(F.col("quantity"), *SIZE_BINS),
        "trade_type": label(F.col("trade_type"), "Unknown"),
    }
    for s in ("bid", "ask"):
        families |= {
            f"{s}_message_age": bins(F.col(f"bcq_{s}_median_message_age_min"), *AGE_BINS),
            f"{s}_change_age": bins(F.col(f"bcq_{s}_median_change_age_min"), *AGE_BINS),
            f"{s}_candidate_gap": bins(F.col(f"bcq_{s}_mean_candidate_gap"), *GAP_BINS),
            f"{s}_dispersion": bins(F.col(f"bcq_{s}_dispersion_bps"), *GAP_BINS),
            f"{s}_zero_quantity": yes(F.col(f"bcq_{s}_zero_quantity_fraction")),
            f"{s}_unknown_quantity": yes(F.col(f"bcq_{s}_unknown_quantity_fraction")),
        }
    each = F.array(*(F.struct(F.lit(k).alias("family"), v.alias("state")) for k, v in families.items()))
    return frame.withColumn("_x", F.explode(each)).select("*", "_x.family", "_x.state").drop("_x", "_per_issuer")


def paired_errors(predictions: DataFrame, selected: str, reference: str) -> DataFrame:
    """(row_id, sel, ref): absolute errors of two models on their common rows."""
    take = lambda m: F.max(F.when(F.col("model") == m, F.abs("error_bps")))
    return predictions.filter(F.col("model").isin(selected, reference)).groupBy("row_id").agg(take(selected).alias("sel"), take(reference).alias("ref")).filter("sel is not null and ref is not null")


def _metrics() -> list[Column]:
    return [
        F.count("*").alias("n"), F.count_distinct("day").alias("dates"), F.avg("sel").alias("mae"), F.avg("ref").alias("reference_mae"), F.avg(F.col("sel") - F.col("ref")).alias("delta_mae"),
        F.sum(F.col("sel") - F.col("ref")).alias("delta_sum"), F.percentile("sel", 0.95).alias("p95"), F.percentile("ref", 0.95).alias("reference_p95"),
        F.avg((F.col("sel") > 10).cast("int")).alias("gt10"), F.avg((F.col("ref") > 10).cast("int")).alias("reference_gt10"),
    ]


def state_diagnostics(frame: DataFrame, predictions: DataFrame, selected: str, reference: str) -> DataFrame:
    """Per (family, state): errors, contribution to the overall change, the mean over days,
    and the range of the change when one day is left out."""
    x = state_families(frame).join(paired_errors(predictions, selected, reference), "row_id")
    total = F.broadcast(paired_errors(predictions, selected, reference).join(frame.select("row_id"), "row_id", "left_semi").agg(F.count("*").alias("_all")))
    g = x.groupBy("family", "state").agg(*_metrics())
    daily = x.groupBy("family", "state", "day").agg(F.sum(F.col("sel") - F.col("ref")).alias("_s"), F.count("*").alias("_n"))
    whole = Window.partitionBy("family", "state")
    left_out = (F.sum("_s").over(whole) - F.col("_s")) / F.nullif(F.sum("_n").over(whole) - F.col("_n"), F.lit(0))
    by_day = daily.withColumn("_l", left_out).groupBy("family", "state").agg(F.avg(F.col("_s") / F.col("_n")).alias("day_equal_delta"), F.min("_l").alias("lodo_min"), F.max("_l").alias("lodo_max"))
    return g.join(by_day, ["family", "state"]).join(total, F.lit(True)).withColumn("contribution", F.col("delta_sum") / F.col("_all")).drop("_all", "delta_sum")


def sector_tails(frame: DataFrame, predictions: DataFrame, selected: str, reference: str) -> DataFrame:
    x = frame.select("row_id", "day", label(F.col("sector"), "Unknown").alias("sector")).join(paired_errors(predictions, selected, reference), "row_id")
    g = x.groupBy("sector").agg(*_metrics())
    return g.select("sector", "n", "dates", "mae", "delta_mae", (F.col("p95") - F.col("reference_p95")).alias("delta_p95"), (F.col("gt10") - F.col("reference_gt10")).alias("delta_gt10"))


def _rows(frame: DataFrame, predictions: DataFrame, selected: str, reference: str) -> DataFrame:
    """``frame`` with ``sector`` as a label, ``sel``, ``ref`` and their difference ``delta``."""
    x = frame.withColumn("sector", label(F.col("sector"), "Unknown")).join(paired_errors(predictions, selected, reference), "row_id")
    return x.withColumn("delta", F.col("sel") - F.col("ref"))


def sector_diagnostics(frame: DataFrame, predictions: DataFrame, selected: str, reference: str) -> DataFrame:
    """Per sector of the target: errors of both models, tails, the mean over days, days that got
    worse, and the share of targets with any price, a fresh pair and a size-time pair."""
    x = _rows(frame, predictions, selected, reference)
    share = lambda c: F.avg((F.col(c) > 0).cast("int"))
    g = x.groupBy("sector").agg(
        F.count("*").alias("n"), F.count_distinct("day").alias("dates"), F.avg("sel").alias("selected_mae"), F.avg("ref").alias("reference_mae"), F.avg("delta").alias("delta_mae"),
        (F.percentile("sel", 0.95) - F.percentile("ref", 0.95)).alias("delta_p95"), (F.avg((F.col("sel") > 10).cast("int")) - F.avg((F.col("ref") > 10).cast("int"))).alias("delta_gt10"),
        share("bcq_is_quoted").alias("any_price"), share("bcq_n_pair").alias("fresh_pair"), share("bcq_n_size_time_pair").alias("size_time_pair"),
    )
    by_day = sector_days(frame, predictions, selected, reference).groupBy("sector").agg(F.avg("delta").alias("day_equal_delta"), F.count_if(F.col("delta") > 0).alias("worse_dates"))
    return g.join(by_day, "sector")


def sector_days(frame: DataFrame, predictions: DataFrame, selected: str, reference: str) -> DataFrame:
    """(sector, day, n, delta): the long form of the sector by day matrix."""
    return _rows(frame, predictions, selected, reference).groupBy("sector", "day").agg(F.count("*").alias("n"), F.avg("delta").alias("delta"))


def delta_slices(frame: DataFrame, predictions: DataFrame, selected: str, reference: str) -> DataFrame:
    """(slice, n, delta_mae) of fixed slices by support and par quantity."""
    masks = {"All": F.lit(True), "Unquoted": F.col("bcq_is_quoted") == 0, "Covered": F.col("bcq_is_quoted") > 0, "<=100K par": F.col("quantity") <= 100_000, ">=1MM par": F.col("quantity") >= 1_000_000}
    names = F.array(*(F.when(m, F.lit(k)) for k, m in masks.items()))
    x = _rows(frame, predictions, selected, reference).withColumn("slice", F.explode(F.array_compact(names)))
    found = x.groupBy("slice").agg(F.count("*").alias("n"), F.avg("delta").alias("delta_mae"))
    every = frame.sparkSession.createDataFrame([(k,) for k in masks], "slice string")
    return every.join(found, "slice", "left").select("slice", F.coalesce("n", F.lit(0)).alias("n"), "delta_mae")


def leave_one_date(frame: DataFrame, predictions: DataFrame, selected: str, reference: str) -> DataFrame:
    """One row: the change overall, over days, and its range when one day is left out (NULL for a
    single day)."""
    days = _rows(frame, predictions, selected, reference).groupBy("day").agg(F.count("*").alias("n"), F.sum("delta").alias("s"))
    total = F.broadcast(days.agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"), F.count("*").alias("days")))
    x = days.join(total, F.lit(True))
    left = F.when(F.col("days") > 1, (F.col("s_all") - F.col("s")) / F.nullif(F.col("n_all") - F.col("n"), F.lit(0)))
    return x.agg(F.max("n_all").alias("n"), F.count("*").alias("dates"), (F.max("s_all") / F.max("n_all")).alias("delta"), F.avg(F.col("s") / F.col("n")).alias("day_equal_delta"), F.min(left).alias("lowest"), F.max(left).alias("highest"))


def largest_states(states: DataFrame, panels: dict[str, list[str]], k: int = 16) -> DataFrame:
    """(panel, place, family, state, n, contribution): each panel's ``k`` states of the largest
    absolute contribution; ties by family and state."""
    of = F.lit(None).cast("string")
    for panel, families in panels.items():
        of = F.when(F.col("family").isin(families), panel).otherwise(of)
    place = F.row_number().over(Window.partitionBy("panel").orderBy(F.desc(F.abs("contribution")), "family", "state"))
    x = states.withColumn("panel", of).filter("panel is not null").withColumn("place", place)
    return x.filter(F.col("place") <= k).select("panel", "place", "family", "state", "n", "contribution")


def in_window(frame: DataFrame, quotes: DataFrame) -> DataFrame:
    """The rows of ``frame`` on days from the first to the last that has quotes."""
    span = F.broadcast(quotes.agg(F.min("day").alias("_low"), F.max("day").alias("_high")))
    return frame.join(span, F.lit(True)).filter(F.col("day").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


RULES = {"Decay": "center_decay", "Max age": "center_max_age", "Clip": "center_candidate_clip", "Downweight": "center_dealer_downweight"}


def rule_sectors(frame: DataFrame) -> DataFrame:
    """Per sector: targets, dates, and by side what rules have to work with and would lose."""
    x = frame.withColumn("sector", label(F.col("sector"), "Unknown"))
    out = [F.count("*").alias("n"), F.count_distinct("day").alias("dates")]
    for s in ("bid", "ask"):
        get = lambda c: F.col(f"bcq_{s}_{c}")  # noqa: E731, B023
        has = get("n_dealers") > 0
        out += [
            F.count_if(has).alias(f"{s}_covered_n"), F.count_if(has & (get("n_fresh_dealers") == 0)).alias(f"{s}_lost_n"), F.count_if(has & (get("n_peer_supported") > 0)).alias(f"{s}_peer_supported_n"),
            F.median(get("median_message_age_min")).alias(f"{s}_message_age"), F.median(get("median_change_age_min")).alias(f"{s}_change_age"), F.avg(get("unknown_change_age_fraction")).alias(f"{s}_unknown_change_fraction"),
        ]
    out += [F.count_if(F.col(c) > 0).alias(n) for n, c in (("priced_n", "bcq_is_quoted"), ("pair_n", "bcq_n_pair"), ("size_pair_n", "bcq_n_size_time_pair"))]
    return x.groupBy("sector").agg(*out)


def _shift(s: str, rule: str) -> Column:
    """How far a rule moves the center; the peer rules only where peers support them."""
    shift = F.abs(F.col(f"bcq_{s}_{RULES[rule]}") - F.col(f"bcq_{s}_center_equal"))
    return F.when((F.col(f"bcq_{s}_n_peer_supported") > 0) & (F.col(f"bcq_{s}_n_dealers") > 0), shift) if rule in ("Clip", "Downweight") else shift


def rule_case_impacts(frame: DataFrame) -> DataFrame:
    """Per bond, side and day: targets, the largest and mean rule effect, and the dealer slots
    that an age limit loses."""
    sides = F.array(*(F.struct(
        F.lit(s).alias("side"), F.greatest(*(_shift(s, r) for r in RULES)).alias("effect"), F.col(f"bcq_{s}_n_dealers").alias("slots"), F.col(f"bcq_{s}_n_fresh_dealers").alias("fresh"),
        ((F.col(f"bcq_{s}_n_peer_supported") > 0) & (F.col(f"bcq_{s}_n_dealers") > 0)).alias("supported")) for s in ("bid", "ask")))
    x = frame.select("cusip", "day", F.explode(sides).alias("x")).select("cusip", "day", "x.*")
    g = x.groupBy("cusip", "side", "day").agg(
        F.count("*").alias("impact_queries"), F.count_if("supported").alias("peer_supported_queries"), F.max("effect").alias("max_center_effect_bps"), F.avg("effect").alias("mean_center_effect_bps"),
        F.sum("slots").alias("baseline_dealer_slots"), F.sum("fresh").alias("fresh_dealer_slots"),
    )
    lost = F.col("baseline_dealer_slots") - F.col("fresh_dealer_slots")
    return g.withColumns({"max_age_lost_slots": lost, "coverage_loss_fraction": F.when(F.col("baseline_dealer_slots") > 0, lost / F.col("baseline_dealer_slots"))})


def daily_deltas(predictions: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(model, against, day, n, delta): the mean paired change of each pair of models by day."""
    error = predictions.select("row_id", "day", "model", F.abs("error_bps").alias("e"))
    chain = F.array(*(F.struct(F.lit(a).alias("model"), F.lit(b).alias("against")) for a, b in pairs))
    sides = error.withColumn("x", F.explode(F.filter(chain, lambda p: (p["model"] == F.col("model")) | (p["against"] == F.col("model")))))
    take = lambda c: F.max(F.when(F.col("model") == F.col(f"x.{c}"), F.col("e")))
    both = sides.groupBy("x", "row_id", "day").agg(take("model").alias("a"), take("against").alias("b")).filter("a is not null and b is not null")
    return both.groupBy("x.model", "x.against", "day").agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("delta"))


def model_ranking(predictions: DataFrame) -> DataFrame:
    e = F.abs("error_bps")
    return predictions.groupBy("model").agg(F.count("*").alias("n"), F.avg(e).alias("mae"), F.percentile(e, 0.95).alias("p95"), F.avg((e > 10).cast("int")).alias("gt10"))


def rule_shifts(frame: DataFrame) -> DataFrame:
    """Per side, rule and sector: median and p95 of the shift against the equal center; rules
    that need peers count only where some dealer had them."""
    rules = []
    for s in ("bid", "ask"):
        for rule in ("center_decay", "center_max_age", "center_candidate_clip", "center_dealer_downweight"):
            ok = F.lit(True) if rule in ("center_decay", "center_max_age") else F.col(f"bcq_{s}_n_peer_supported") > 0
            shift = F.when(ok, F.abs(F.col(f"bcq_{s}_{rule}") - F.col(f"bcq_{s}_center_equal")))
            lost = (F.col(f"bcq_{s}_center_equal").isNotNull() & F.col(f"bcq_{s}_{rule}").isNull()).cast("int")
            rules.append(F.struct(F.lit(s).alias("side"), F.lit(rule).alias("rule"), shift.alias("shift"), lost.alias("lost")))
    x = frame.select(label(F.col("sector"), "Unknown").alias("sector"), F.explode(F.array(*rules)).alias("x")).select("sector", "x.*")
    return x.groupBy("side", "rule", "sector").agg(F.count("shift").alias("n"), F.median("shift").alias("median_shift"), F.percentile("shift", 0.95).alias("p95_shift"), F.avg("lost").alias("coverage_loss"))


def movement_coverage(sidecar: DataFrame, split: DataFrame, by: str = "split") -> DataFrame:
    """Share of rows per split, or per other column ``by`` of ``split``, with a finite signal of each kind."""
    x = sidecar.join(split.select("row_id", by), "row_id")
    any_of = lambda *c: F.coalesce(*(F.col(n) for n in c)).isNotNull().cast("int")
    return x.groupBy(by).agg(F.count("*").alias("n"), F.avg(any_of("bcq_bid_move_mean_bps", "bcq_ask_move_mean_bps")).alias("direction_share"), F.avg(any_of("bcq_bid_issuer_move_mean_bps", "bcq_ask_issuer_move_mean_bps")).alias("issuer_share"))


def prediction_problems(frame: DataFrame, predictions: DataFrame) -> DataFrame:
    """Integrity of predictions against the cohort: (problem, rows), empty if all is well."""
    p = predictions.join(frame.select("row_id", F.col("ns").alias("_ns"), F.col("truth").alias("_truth")), "row_id", "left")
    close = F.abs(F.col("error_bps") - (F.col("pred") - F.col("_truth")) * 100) <= 1e-7 + 1e-9 * F.abs(F.col("error_bps"))
    # A model's name a row: as many as were fitted.
    models = predictions.select("model").distinct()
    checks = [
        p.groupBy("row_id", "model").count().filter("count > 1").select(F.lit("repeated").alias("problem")),
        p.filter("_ns is null").select(F.lit("outside the cohort").alias("problem")),
        p.filter(F.col("pred").isNull() | F.isnan("pred")).select(F.lit("not finite").alias("problem")),
        p.filter("_ns is not null and ns <> _ns").select(F.lit("other time").alias("problem")),
        p.filter(F.col("_truth").isNotNull() & ~close).select(F.lit("other error").alias("problem")),
        frame.select("row_id").join(models.groupBy().agg(F.collect_set("model").alias("_m")), F.lit(True)).select("row_id", F.explode("_m").alias("model")).join(predictions.select("row_id", "model"), ["row_id", "model"], "left_anti").select(F.lit("missing").alias("problem")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.groupBy("problem").agg(F.count("*").alias("rows"))


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) / width).alias("bin")).agg(F.count("*").alias("n"))


def cdf(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share at or below it): only distinct values are ordered in one place."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("share", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()))


def quantile_bands(df: DataFrame, key: str, value: str, weight: str, bands: int = 4) -> DataFrame:
    """Bands of ``value`` at its own quantiles, with the keys of most and least ``weight``."""
    cuts = df.agg(F.percentile(value, F.array(*(F.lit(i / bands) for i in range(1, bands)))).alias("_q"))
    x = df.filter(F.col(value).isNotNull()).join(F.broadcast(cuts), F.lit(True))
    x = x.withColumn("band", F.size(F.filter("_q", lambda q: q < F.col(value))))
    return x.groupBy("band").agg(F.count("*").alias("n"), F.min_by(key, F.struct(-F.col(weight), F.col(key))).alias("liquid"), F.min_by(key, F.struct(F.col(weight), F.col(key))).alias("sparse"))
