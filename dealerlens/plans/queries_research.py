"""Queries of diagnostics, selection and cases, with their SQL.  Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, diagnostics, events, features, movement, population, selection
from ..sources import ingest
from ..sources.ingest import DERIVED_BASE, base_trades_view, quotes_view, trades_view
from . import sql, sql_more
from .queries import BASE, CLEAN_SQL, SIDE_SQL, WIDE_BASE, _moves, _states, history, predictions_view, register, rounded

PAIR_OF = ("Age decay", "Reliability")

# The frame of query features as SQL.
_COUNTS = ("n_dealers", "n_fresh_dealers", "n_peer_supported")
_VALUES = (
    "center_equal", "center_decay", "center_max_age", "center_candidate_clip", "center_dealer_downweight", "median_message_age_min", "median_change_age_min",
    "unknown_change_age_fraction", "mean_candidate_gap", "unknown_quantity_fraction",
)
_WIDE = ", ".join(f"max(CASE WHEN side = '{s}' THEN {c} END) AS {s}_{c}" for s in ("bid", "ask") for c in (*_COUNTS, *_VALUES))
_FILLED = ", ".join(f"coalesce({s}_{c}, 0) AS {s}_{c}" for s in ("bid", "ask") for c in _COUNTS) + ", " + ", ".join(f"{s}_{c}" for s in ("bid", "ask") for c in _VALUES)
FRAME_SQL = [
    *SIDE_SQL, sql.PAIRS, sql_more.PREDICTIONS, f"wide AS (SELECT cusip, ns, {_WIDE} FROM side GROUP BY ALL)",
    f"fr AS (SELECT t.*, {_FILLED}, coalesce(pf.n_pair, 0) AS n_pair, coalesce(pf.n_size_time_pair, 0) AS n_size_time_pair, CAST(coalesce(bid_n_dealers, 0) + coalesce(ask_n_dealers, 0) > 0 AS DOUBLE) AS is_quoted, coalesce(t.sector, 'Unknown') AS sec FROM trades t LEFT JOIN wide USING (cusip, ns) LEFT JOIN pf USING (cusip, ns))",
    "ro AS (SELECT fr.*, pe.sel, pe.ref, pe.sel - pe.ref AS delta FROM fr JOIN pe USING (row_id))",
    "sdays AS (SELECT sec AS sector, day, count(*) AS n, avg(delta) AS delta FROM ro GROUP BY ALL)",
]


def _frame(spark, d):
    return features.point_features(history(spark, d), trades_view(spark, d))


_SECTOR = ["selected_mae", "reference_mae", "delta_mae", "delta_p95", "delta_gt10", "any_price", "fresh_pair", "size_time_pair", "day_equal_delta"]


@register("sector_diagnostics", sql.query(*FRAME_SQL, """sg AS (SELECT sec AS sector, count(*) AS n, count(DISTINCT day) AS dates, avg(sel) AS selected_mae, avg(ref) AS reference_mae, avg(delta) AS delta_mae,
  quantile_cont(sel, 0.95) - quantile_cont(ref, 0.95) AS delta_p95, avg(CAST(sel > 10 AS INTEGER)) - avg(CAST(ref > 10 AS INTEGER)) AS delta_gt10, avg(CAST(is_quoted > 0 AS INTEGER)) AS any_price,
  avg(CAST(n_pair > 0 AS INTEGER)) AS fresh_pair, avg(CAST(n_size_time_pair > 0 AS INTEGER)) AS size_time_pair FROM ro GROUP BY ALL)""",
  "sw AS (SELECT sector, avg(delta) AS day_equal_delta, count(*) FILTER (WHERE delta > 0) AS worse_dates FROM sdays GROUP BY ALL)",
  select=f"SELECT sector, n, dates, worse_dates, {sql.rounded(*_SECTOR)} FROM sg JOIN sw USING (sector)"))
def sector_diagnostics(spark, d):
    return rounded(diagnostics.sector_diagnostics(_frame(spark, d), predictions_view(spark, d), *PAIR_OF), *_SECTOR)


@register("sector_days", sql.query(sql.trades(), sql_more.PREDICTIONS, select="SELECT coalesce(sector, 'Unknown') AS sector, CAST(day AS VARCHAR) AS day, count(*) AS n, round(avg(sel - ref), 6) AS delta FROM trades JOIN pe USING (row_id) GROUP BY ALL"))
def sector_days(spark, d):
    return rounded(diagnostics.sector_days(trades_view(spark, d), predictions_view(spark, d), *PAIR_OF), "delta").withColumn("day", F.col("day").cast("string"))


_SLICES = {"All": "true", "Unquoted": "is_quoted = 0", "Covered": "is_quoted > 0", "<=100K par": "quantity <= 100000", ">=1MM par": "quantity >= 1000000"}


@register("delta_slices", sql.query(*FRAME_SQL, select=" UNION ALL ".join(f"SELECT '{k}' AS slice, count(*) AS n, round(avg(delta), 6) AS delta_mae FROM ro WHERE {w}" for k, w in _SLICES.items())))
def delta_slices(spark, d):
    return rounded(diagnostics.delta_slices(_frame(spark, d), predictions_view(spark, d), *PAIR_OF), "delta_mae")


@register("leave_one_date", sql.query(sql.trades(), sql_more.PREDICTIONS, "d AS (SELECT day, count(*) AS n, sum(sel - ref) AS s FROM trades JOIN pe USING (row_id) GROUP BY ALL)",
  select="SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS dates, round(sum(s) / sum(n), 6) AS delta, round(avg(s / n), 6) AS day_equal_delta, round(min(l), 6) AS lowest, round(max(l), 6) AS highest FROM (SELECT *, (sum(s) OVER () - s) / nullif(sum(n) OVER () - n, 0) AS l FROM d)"))
def leave_one_date(spark, d):
    return rounded(diagnostics.leave_one_date(trades_view(spark, d), predictions_view(spark, d), *PAIR_OF), "delta", "day_equal_delta", "lowest", "highest")


_PANELS = {"size": ["trade_size", "trade_type"], "where": ["SECTOR", "issuer_trade_count"]}
_SIZE = "CASE WHEN quantity IS NULL OR quantity < 0 THEN 'Unknown' WHEN quantity <= 100000 THEN '<=100K' WHEN quantity <= 999999.99 THEN '100K-1MM' ELSE '>=1MM' END"


@register("largest_states", sql.query(sql.trades(), sql_more.PREDICTIONS, f"""st AS (SELECT *, count(*) OVER (PARTITION BY issuer) AS k FROM trades JOIN pe USING (row_id)),
ls AS (SELECT 'size' AS panel, 'trade_size' AS family, {_SIZE} AS state, sel - ref AS delta FROM st UNION ALL SELECT 'size', 'trade_type', trade_type, sel - ref FROM st
  UNION ALL SELECT 'where', 'SECTOR', coalesce(sector, 'Unknown'), sel - ref FROM st UNION ALL SELECT 'where', 'issuer_trade_count', CASE WHEN k <= 20 THEN '1-20' WHEN k <= 100 THEN '21-100' WHEN k <= 500 THEN '101-500' ELSE '500+' END, sel - ref FROM st),
lg AS (SELECT panel, family, state, count(*) AS n, round(sum(delta) / (SELECT count(*) FROM st), 6) AS contribution FROM ls GROUP BY ALL)""",
  select="SELECT panel, CAST(row_number() OVER (PARTITION BY panel ORDER BY abs(contribution) DESC, family, state) AS INTEGER) AS place, family, state, n, contribution FROM lg QUALIFY place <= 3"))
def largest_states(spark, d):
    states = rounded(diagnostics.state_diagnostics(_frame(spark, d), predictions_view(spark, d), *PAIR_OF), "contribution")
    return diagnostics.largest_states(states, _PANELS, 3)


_CHAIN = [("Age decay", "Reliability"), ("Reliability", "Base")]


@register("daily_deltas", sql.query(sql.trades(), sql_more.PREDICTIONS, select=" UNION ALL ".join(f"SELECT '{a}' AS model, '{b}' AS against, CAST(x.day AS VARCHAR) AS day, count(*) AS n, round(avg(abs(x.error_bps) - abs(y.error_bps)), 6) AS delta FROM preds x JOIN preds y USING (row_id) WHERE x.model = '{a}' AND y.model = '{b}' GROUP BY x.day" for a, b in _CHAIN)))
def daily_deltas(spark, d):
    return rounded(diagnostics.daily_deltas(predictions_view(spark, d), _CHAIN), "delta").withColumn("day", F.col("day").cast("string"))


_WINDOW = "fw AS (SELECT * FROM fr WHERE day BETWEEN (SELECT min(day) FROM quotes) AND (SELECT max(day) FROM quotes))"
_RULE_ROUND = [f"{s}_{c}" for s in ("bid", "ask") for c in ("message_age", "change_age", "unknown_change_fraction")]


@register("rule_sectors", sql.query(*FRAME_SQL, _WINDOW, select="SELECT sec AS sector, count(*) AS n, count(DISTINCT day) AS dates, " + ", ".join(f"count(*) FILTER (WHERE {s}_n_dealers > 0) AS {s}_covered_n, count(*) FILTER (WHERE {s}_n_dealers > 0 AND {s}_n_fresh_dealers = 0) AS {s}_lost_n, count(*) FILTER (WHERE {s}_n_dealers > 0 AND {s}_n_peer_supported > 0) AS {s}_peer_supported_n, round(median({s}_median_message_age_min), 6) AS {s}_message_age, round(median({s}_median_change_age_min), 6) AS {s}_change_age, round(avg({s}_unknown_change_age_fraction), 6) AS {s}_unknown_change_fraction" for s in ("bid", "ask"))
  + ", count(*) FILTER (WHERE is_quoted > 0) AS priced_n, count(*) FILTER (WHERE n_pair > 0) AS pair_n, count(*) FILTER (WHERE n_size_time_pair > 0) AS size_pair_n FROM fw GROUP BY ALL"))
def rule_sectors(spark, d):
    return rounded(diagnostics.rule_sectors(diagnostics.in_window(_frame(spark, d), quotes_view(spark, d))), *_RULE_ROUND)


def _side_shift(s: str) -> str:
    own = [f"abs({s}_{c} - {s}_center_equal)" for c in ("center_decay", "center_max_age")]
    peer = [f"CASE WHEN {s}_n_peer_supported > 0 AND {s}_n_dealers > 0 THEN abs({s}_{c} - {s}_center_equal) END" for c in ("center_candidate_clip", "center_dealer_downweight")]
    return f"SELECT cusip, day, '{s}' AS side, greatest({', '.join(own + peer)}) AS effect, {s}_n_dealers AS slots, {s}_n_fresh_dealers AS fresh, {s}_n_peer_supported > 0 AND {s}_n_dealers > 0 AS supported FROM fw"


IMPACT_SQL = [_WINDOW, f"fx AS ({_side_shift('bid')} UNION ALL {_side_shift('ask')})",
  """imp AS (SELECT cusip, side, day, count(*) AS impact_queries, count(*) FILTER (WHERE supported) AS peer_supported_queries, max(effect) AS max_center_effect_bps, avg(effect) AS mean_center_effect_bps,
  CAST(sum(slots) AS BIGINT) AS baseline_dealer_slots, CAST(sum(fresh) AS BIGINT) AS fresh_dealer_slots, CAST(sum(slots) - sum(fresh) AS BIGINT) AS max_age_lost_slots, CASE WHEN sum(slots) > 0 THEN (sum(slots) - sum(fresh)) / sum(slots) END AS coverage_loss_fraction FROM fx GROUP BY ALL)"""]  # fmt: skip
_IMPACT = ["max_center_effect_bps", "mean_center_effect_bps", "coverage_loss_fraction"]


@register("rule_case_impacts", sql.query(*FRAME_SQL, *IMPACT_SQL, select=f"SELECT cusip, side, CAST(day AS VARCHAR) AS day, impact_queries, peer_supported_queries, baseline_dealer_slots, fresh_dealer_slots, max_age_lost_slots, {sql.rounded(*_IMPACT)} FROM imp"))
def rule_case_impacts(spark, d):
    f = diagnostics.in_window(_frame(spark, d), quotes_view(spark, d))
    return rounded(diagnostics.rule_case_impacts(f), *_IMPACT).withColumn("day", F.col("day").cast("string"))


_CASES = f"""cx AS ({" UNION ALL ".join(f"SELECT cusip, day, '{s}' AS side, issuer, sector, {s}_n_dealers AS dealers, {s}_mean_candidate_gap AS gap, {s}_unknown_quantity_fraction AS unk FROM fw" for s in ("bid", "ask"))}),
cg AS (SELECT cusip, side, day, count(*) AS trade_queries, count(dealers) AS known_support_queries, avg(CAST(dealers > 0 AS INTEGER)) AS quoted_fraction, avg(dealers) AS mean_dealer_count, avg(gap) AS mean_candidate_gap, avg(unk) AS unknown_quantity_fraction,
  CASE WHEN count(DISTINCT issuer) > 1 THEN '[Conflicting issuer]' ELSE coalesce(min(issuer), '[Missing issuer]') END AS issuer, CASE WHEN count(DISTINCT sector) > 1 THEN 'Conflicting' ELSE coalesce(min(sector), 'Unknown') END AS sector FROM cx GROUP BY ALL),
ch AS (SELECT *, CASE WHEN trade_queries <= 3 THEN 'Sparse' WHEN trade_queries <= 30 THEN 'Medium' ELSE 'Active' END AS activity, cusip || '|' || side || '|' || CAST(day AS VARCHAR) AS case_id FROM cg),
cm AS (SELECT sector, activity, {", ".join(f"median({m}) AS med_{m}, max({m}) - min({m}) AS range_{m}" for m in selection.METRICS)} FROM ch GROUP BY ALL),
cc AS (SELECT ch.*, sha256('2026|' || case_id) AS hash, max_center_effect_bps, coverage_loss_fraction, {" + ".join(f"coalesce(abs({m} - med_{m}) / CASE WHEN range_{m} = 0 THEN 1 ELSE range_{m} END, 0)" for m in selection.METRICS)} AS typical FROM ch JOIN cm USING (sector, activity) LEFT JOIN imp USING (cusip, side, day))"""
_CASE = [*selection.METRICS, "max_center_effect_bps", "coverage_loss_fraction", "typical"]


def _candidates(spark, d):
    f = diagnostics.in_window(_frame(spark, d), quotes_view(spark, d))
    return selection.trade_case_candidates(f, diagnostics.rule_case_impacts(f))


@register("trade_case_candidates", sql.query(*FRAME_SQL, *IMPACT_SQL, _CASES, select=f"SELECT cusip, side, CAST(day AS VARCHAR) AS day, trade_queries, known_support_queries, issuer, sector, activity, case_id, hash, {sql.rounded(*_CASE)} FROM cc"))
def trade_case_candidates(spark, d):
    return rounded(_candidates(spark, d), *_CASE).withColumn("day", F.col("day").cast("string"))


@register("trade_cases")
def trade_cases(spark, d):
    return selection.trade_case_manifest(_candidates(spark, d))


# Sources and selection.

@register("combined_metadata", sql.query(sql.trades(), sql.quotes(), f"""meta AS (SELECT 0 AS p, cusip, issuer, {DERIVED_BASE['yrs_to_maturity']} AS tenor FROM trades UNION ALL SELECT DISTINCT 1, cusip, 'Q' || firm, CAST(NULL AS DOUBLE) FROM quotes WHERE cusip = 'B1')""",
  select="SELECT cusip, max(struct_pack(p := p, i := issuer, t := tenor)).i AS issuer, max(struct_pack(p := p, i := issuer, t := tenor)).t AS tenor FROM meta WHERE issuer IS NOT NULL GROUP BY cusip"))
def combined_metadata(spark, d):
    t = base_trades_view(spark, d).select("cusip", "issuer", F.col("yrs_to_maturity").alias("tenor"))
    q = quotes_view(spark, d).filter("cusip = 'B1'").select("cusip", F.concat(F.lit("Q"), "firm").alias("issuer"), F.lit(None).cast("double").alias("tenor"))
    return ingest.combined_metadata(t, q)


_HALF = "(SELECT CAST(min(ns) + (max(ns) - min(ns)) // 2 AS BIGINT) FROM trades)"


@register("trade_universe", sql.query(sql.trades(), select=f"SELECT cusip, count(*) AS trade_rows FROM trades WHERE ns >= {_HALF} GROUP BY cusip"))
def trade_universe(spark, d):
    t = trades_view(spark, d)
    low, high = t.agg(F.min("ns"), F.max("ns")).first()
    start = None if low is None else low + (high - low) // 2
    return ingest.trade_universe(t, start).groupBy("cusip").agg(F.count("*").alias("trade_rows"))


@register("coverage_trades", sql.query(sql.trades(), *CLEAN_SQL, "cn AS (SELECT cusip, ns, side, count(*) AS n FROM kept GROUP BY ALL)",
  select="SELECT b.cusip, count(*) AS n_trades, count(*) FILTER (WHERE t.ns BETWEEN (SELECT min(ns) FROM grid) AND (SELECT max(ns) FROM grid)) AS window_trades, " + ", ".join(f"round((SELECT count(*) FROM cn WHERE cn.cusip = b.cusip AND cn.side = '{s}' AND n >= {k}) / (SELECT count(*) FROM grid), 6) AS {s}_{m}" for s in ("bid", "ask") for m, k in (("fresh", 1), ("multi", 2))) + " FROM (SELECT DISTINCT cusip FROM quotes) b JOIN trades t USING (cusip) GROUP BY b.cusip"))
def coverage_trades(spark, d):
    q, grid, s = _states(spark, d)
    span = grid.agg(F.min("ns").alias("_low"), F.max("ns").alias("_high"))
    t = trades_view(spark, d).join(F.broadcast(span), F.lit(True))
    shares = ("bid_fresh", "bid_multi", "ask_fresh", "ask_multi")
    return rounded(selection.with_trade_counts(clean.coverage(s, grid, clean.top_bonds(q)), t, F.col("_low"), F.col("_high")), *shares).select("cusip", "n_trades", "window_trades", *shares)


_ANN = [*BASE, sql_more.UNIVERSE, sql_more.ANNOTATED]


def _scope(kind, value):
    def run(spark, d):
        u = population.bond_universe(trades_view(spark, d))
        e, u = selection.scope_selection(history(spark, d), u, kind, value)
        seen = e.agg(F.count("*").alias("events"), F.count_distinct("cusip").alias("event_bonds"))
        return seen.join(F.broadcast(u.agg(F.count("*").alias("universe_bonds"))), F.lit(True))

    return run


for _n, _k, _v, _w, _u in (("sector", "SECTOR", "Energy", "sector = 'Energy'", "sector = 'Energy'"), ("issuer", "Issuer", "I0", "issuer = 'I0'", "issuer = 'I0'"), ("dealer", "Dealer", "D1", "firm = 'D1'", "true")):
    register(f"scope_{_n}", sql.query(*_ANN, select=f"SELECT count(*) AS events, count(DISTINCT cusip) AS event_bonds, (SELECT count(*) FROM universe WHERE {_u}) AS universe_bonds FROM ann WHERE {_w}"))(_scope(_k, _v))


@register("raw_markers", sql.query(sql.quotes(), """mk AS (SELECT cusip, ns, firm, side, spread, quantity, row_number() OVER (PARTITION BY cusip ORDER BY ns, firm, side, spread, quantity) - 1 AS i, count(*) OVER (PARTITION BY cusip) AS n FROM quotes),
pt AS (SELECT DISTINCT cusip, CAST(floor(k * (n - 1) / 99) AS BIGINT) AS i FROM (SELECT DISTINCT cusip, n FROM mk), range(100) r(k))""",
  select="SELECT cusip, ns, firm, side, spread, quantity FROM mk WHERE n <= 100 OR EXISTS (SELECT 1 FROM pt WHERE pt.cusip = mk.cusip AND pt.i = mk.i)"))
def raw_markers(spark, d):
    order = ["ns", "firm", "side", F.asc_nulls_last("spread"), F.asc_nulls_last("quantity")]
    return selection.evenly_spaced(quotes_view(spark, d).select("cusip", "ns", "firm", "side", "spread", "quantity"), order, 100, ["cusip"])


@register("case_page", sql.query(*_ANN, select="SELECT firm, cusip, side, ns, candidate_count, qclass FROM ann WHERE multi AND qclass = 'unknown' ORDER BY candidate_count DESC, ns, firm, cusip, side LIMIT 50 OFFSET 50"))
def case_page(spark, d):
    x = selection.case_events(history(spark, d), "unknown")
    return selection.page(x, [F.desc("candidate_count"), "ns", "firm", "cusip", "side"], 1).select("firm", "cusip", "side", "ns", "candidate_count", "qclass")


_WIDE_ANN = [sql.quotes(bonds=20), sql.trades(bonds=20), sql.EVENTS, sql_more.UNIVERSE]
_SUPPORT = "su AS (SELECT u.issuer, count(*) AS events, count(*) FILTER (WHERE candidate_count > 1) AS multi, coalesce(max(gap), 0) AS gap FROM ev JOIN universe u USING (cusip) GROUP BY ALL)"
_REVIEWED = ["I3", "i5", "none"]


def _support(spark, d):
    u = population.bond_universe(trades_view(spark, d, bonds=20))
    e = events.dealer_events(quotes_view(spark, d, bonds=20))
    return e, u


@register("promoted_issuers", sql.query(*_WIDE_ANN, _SUPPORT, "pr AS (" + " UNION ALL ".join([f"SELECT min(issuer) AS issuer, {i} AS r, 'Reviewed case' AS reason FROM su WHERE starts_with(upper(issuer), '{p.upper()}') HAVING min(issuer) IS NOT NULL" for i, p in enumerate(_REVIEWED)]
  + [f"SELECT issuer, row_number() OVER (ORDER BY {m} DESC, issuer) + {3 + 2 * k}, 'High {m}' FROM su WHERE events >= 20 QUALIFY row_number() OVER (ORDER BY {m} DESC, issuer) <= 2" for k, m in enumerate(("multi", "gap", "events"))]) + ")",
  select="SELECT su.issuer, CAST(coalesce(min(r), 10) AS INTEGER) AS place, arg_min(reason, r) AS reason FROM su LEFT JOIN pr USING (issuer) GROUP BY su.issuer"))
def promoted_issuers(spark, d):
    return selection.promoted_issuers(selection.issuer_support(*_support(spark, d)), _REVIEWED)


@register("dealer_order", sql.query(sql.quotes(), sql.EVENTS, select="SELECT firm, count(*) FILTER (WHERE candidate_count > 1) AS multi, count(*) AS events FROM ev GROUP BY firm"))
def dealer_order(spark, d):
    return selection.dealer_order(events.dealer_events(quotes_view(spark, d)))


@register("traded_issuers", sql.query(*_WIDE_ANN, _SUPPORT, select="SELECT u.issuer, count(*) AS bonds, CAST(sum(u.trade_rows) AS BIGINT) AS trade_rows, coalesce(max(su.events), 0) AS events, coalesce(max(su.multi), 0) AS multi, max(su.gap) AS gap FROM universe u LEFT JOIN su USING (issuer) GROUP BY u.issuer"))
def traded_issuers(spark, d):
    return selection.traded_issuers(*_support(spark, d))


@register("tenor_bands", sql.query(sql.trades(bonds=23), f"""tb AS (SELECT cusip, count(*) AS n_trades, max({DERIVED_BASE['yrs_to_maturity']}) AS tenor FROM trades GROUP BY cusip),
tp AS (SELECT *, row_number() OVER (ORDER BY tenor NULLS LAST, cusip) - 1 AS i, count(*) OVER () AS n FROM tb),
tc AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE CAST(ceil(i * 4 / (n - 1)) AS INTEGER) - 1 END AS band FROM tp),
tl AS (SELECT band, first(cusip ORDER BY n_trades DESC, cusip) AS liquid FROM tc GROUP BY band)""",
  select="SELECT tc.band, count(*) AS n, any_value(liquid) AS liquid, first(cusip ORDER BY n_trades, cusip) FILTER (WHERE cusip <> liquid) AS sparse FROM tc JOIN tl USING (band) GROUP BY tc.band"))
def tenor_bands(spark, d):
    b = base_trades_view(spark, d, bonds=23).groupBy("cusip").agg(F.count("*").alias("n_trades"), F.max("yrs_to_maturity").alias("tenor"))
    return selection.position_bands(b)


@register("movement_coverage", sql.query(*WIDE_BASE, sql_more.moves(), """mm AS (SELECT cusip, ns, bool_or(mean_bps IS NOT NULL) AS ok FROM move GROUP BY ALL),
mc AS (SELECT row_id, count(*) OVER (PARTITION BY issuer) AS k, coalesce(ok, false) AS ok FROM trades LEFT JOIN mm USING (cusip, ns))""",
  select="SELECT CASE WHEN k <= 20 THEN '1-20' WHEN k <= 100 THEN '21-100' WHEN k <= 500 THEN '101-500' ELSE '500+' END AS stratum, count(*) AS n, round(avg(CAST(ok AS INTEGER)), 6) AS direction_share FROM mc GROUP BY ALL"))
def movement_coverage(spark, d):
    e, t = _moves(spark, d)
    per = t.groupBy("issuer").agg(F.count("*").alias("k"))
    strata = t.join(per, t["issuer"].eqNullSafe(per["issuer"])).select("row_id", diagnostics.bins(F.col("k"), *diagnostics.ISSUER_BINS).alias("stratum"))
    return rounded(diagnostics.movement_coverage(movement.movement_features(e, t), strata, "stratum").drop("issuer_share"), "direction_share")
