"""Every query: a callable on (spark, sf_dir), and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, events, features, pairs, side
from ..sources.ingest import DERIVED_BASE, base_trades_view, quotes_view, trades_view
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def history(spark, d, **view) -> DataFrame:
    return events.prepare_events(quotes_view(spark, d, **view))


BASE = [sql.quotes(), sql.trades(), sql.EVENTS, sql.HISTORY]
KEY = "firm, cusip, side, ns, CAST(day AS VARCHAR) AS day"


def day_text(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


EVENT_VALUES = ["lo", "hi", "center", "gap", "center_nearest_gap"]


@register("dealer_events", sql.query(*BASE[:3], select=f"""SELECT {KEY}, "rows", CAST(repeats AS BIGINT) AS repeats, CAST(bad AS BIGINT) AS bad, array_to_string(list_transform(spread_set, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS spread_set, candidate_count, {sql.rounded(*EVENT_VALUES)}, complete FROM ev"""))
def dealer_events(spark, d):
    e = day_text(events.dealer_events(quotes_view(spark, d)))
    text = F.array_join(F.transform("spread_set", lambda x: x.cast("bigint").cast("string")), ",")
    return rounded(e.withColumn("spread_set", text).drop("quantity_set", "pair_set"), *EVENT_VALUES)


HISTORY_VALUES = ["interval_min", "center_delta", "guarded_delta", "lo_delta", "hi_delta", "change_age_min"]
HISTORY_FLAGS = ["history_break", "spread_changed", "pair_refresh", "condition_changed", "observed_aba", "history_start", "change_age_unknown", "changes_30m"]


@register("event_history", sql.query(*BASE, "x AS (SELECT *, (ns - last_change) / 60e9 AS change_age_min, last_change IS NULL AS change_age_unknown FROM hist)", select=f"SELECT {KEY}, {', '.join(HISTORY_FLAGS)}, {sql.rounded(*HISTORY_VALUES)} FROM x"))
def event_history(spark, d):
    return rounded(day_text(history(spark, d)).select("firm", "cusip", "side", "ns", "day", *HISTORY_FLAGS, *HISTORY_VALUES), *HISTORY_VALUES)


@register("quantity_kinds", sql.query(*BASE[:1], select='SELECT firm, qkind, count(*) AS "rows" FROM tagged GROUP BY ALL'))
def quantity_kinds(spark, d):
    return events.quantity_kinds(quotes_view(spark, d))


QCLASS = "CASE WHEN has_unknown THEN 'unknown' WHEN has_zero THEN 'zero' WHEN n_quantity > 1 THEN 'different' ELSE 'same' END AS qclass"


@register("group_quotes", sql.query(*BASE[:1], """g AS (SELECT firm, cusip, side, ns, count(*) AS "rows", count(DISTINCT spread) AS n_spreads, min(spread) AS lo, max(spread) AS hi, count(DISTINCT qtag) AS n_quantity,
  bool_or(qkind = 'Zero') AS has_zero, bool_and(qkind = 'Zero') AS all_zero, bool_or(qkind IN ('Missing', 'Other')) AS has_unknown, CAST(sum(CASE WHEN spread IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM tagged GROUP BY ALL)""",
  select=f'SELECT *, hi - lo AS "range", n_spreads > 1 AS multi, {QCLASS} FROM g'))
def group_quotes(spark, d):
    return events.group_quotes(quotes_view(spark, d))


@register("qclass_events", sql.query(*BASE[:3], """sp AS (SELECT DISTINCT firm, cusip, side, ns FROM (SELECT firm, cusip, side, ns, qtag FROM tagged WHERE qkind = 'Positive' AND spread IS NOT NULL GROUP BY ALL HAVING count(DISTINCT spread) > 1))""",
  f"""a AS (SELECT ev.*, candidate_count > 1 AS multi, sp.firm IS NOT NULL AS same_positive_multi, list_contains(quantity_set, 'Zero') AS has_zero, len(list_filter(quantity_set, lambda t: t <> 'Zero')) = 0 AS all_zero,
  len(list_filter(quantity_set, lambda t: t = 'Missing' OR starts_with(t, 'Other:'))) > 0 AS has_unknown, CAST(len(quantity_set) AS INTEGER) AS n_quantity FROM ev LEFT JOIN sp USING (firm, cusip, side, ns))""",
  select=f"SELECT {KEY}, multi, same_positive_multi, has_zero, all_zero, has_unknown, n_quantity, {QCLASS} FROM a"))
def qclass_events(spark, d):
    e = events.annotated_events(events.dealer_events(quotes_view(spark, d)))
    return day_text(e).select("firm", "cusip", "side", "ns", "day", "multi", "same_positive_multi", "has_zero", "all_zero", "has_unknown", "n_quantity", "qclass")


@register("quantity_evidence", sql.query(*BASE[:1], """c AS (SELECT firm, cusip, side, ns, qtag, CAST(count(DISTINCT spread) AS INTEGER) AS n_spreads, min(spread) AS lo, max(spread) AS hi, list_median(list(DISTINCT spread) FILTER (WHERE spread IS NOT NULL)) AS center,
  sum(CASE WHEN spread IS NULL THEN 1 ELSE 0 END) AS bad FROM tagged GROUP BY ALL)""",
  """e AS (SELECT firm, cusip, side, ns, sum(bad) = 0 AND count(*) >= 2 AND bool_and(starts_with(qtag, 'q=') AND n_spreads = 1) AS ok, median(center) AS m FROM c GROUP BY ALL)""",
  select="SELECT firm, cusip, side, ns, qtag[1:2] AS tag_kind, n_spreads, lo, hi, center, CASE WHEN ok THEN center - m END AS residual FROM c JOIN e USING (firm, cusip, side, ns)"))
def quantity_evidence(spark, d):
    return events.quantity_evidence(quotes_view(spark, d)).withColumn("tag_kind", F.substring("qtag", 1, 2)).drop("qtag")


def _asof(exact: bool):
    def run(spark, d):
        e = events.dealer_events(quotes_view(spark, d))
        return rounded(day_text(asof.asof(e, trades_view(spark, d), ["complete", "center", "candidate_count"], exact=exact)), "age_min", "center")

    return run


for _name, _op in (("asof_side_inclusive", ">="), ("asof_side_strict", ">")):
    register(_name, sql.query(*BASE[:3], sql.slots(_op), select="SELECT cusip, firm, side, CAST(day AS VARCHAR) AS day, ns, event_ns, round(age_min, 6) AS age_min, complete, round(center, 6) AS center, candidate_count FROM slots"))(_asof(_op == ">="))

SIDE_SQL = [*BASE, sql.slots(source="hist"), sql.SIDE]


@register("side_features", sql.query(*SIDE_SQL, select=f"SELECT cusip, ns, CAST(day AS VARCHAR) AS day, side, {sql.rounded(*side.VALUES)}, {', '.join(side.COUNTS)} FROM side"))
def side_features(spark, d):
    return rounded(day_text(side.side_features(side.slots(history(spark, d), trades_view(spark, d)))), *side.VALUES)


PAIR_SQL = [*BASE, sql.slots(source="hist"), sql.PAIRS]
PAIR_VALUES = ["max_age", "time_gap", "gap_low", "gap_high", "gap_center", "mid", "mid_range", "matched_gap_low", "matched_gap_high", "matched_gap", "matched_mid"]
PAIR_OTHER = ["both", "complete", "same_time", "positive_matches", "size_state", "cross", "cross_matched", "fresh_pair", "size_time_pair"]


def _pairs(spark, d):
    return pairs.pair_snapshots(history(spark, d), trades_view(spark, d))


@register("pair_snapshots", sql.query(*PAIR_SQL, select="SELECT cusip, ns, firm, " + sql.rounded(*PAIR_VALUES) + ", " + ", ".join(f'"{c}"' for c in PAIR_OTHER) + " FROM pairs"))
def pair_snapshots(spark, d):
    return rounded(_pairs(spark, d).select("cusip", "ns", "firm", *PAIR_VALUES, *PAIR_OTHER), *PAIR_VALUES)


PAIR_MEANS = pairs.PAIR_FEATURES[2:]


@register("pair_features", sql.query(*PAIR_SQL, select=f"SELECT cusip, ns, n_pair, n_size_time_pair, {sql.rounded(*PAIR_MEANS)} FROM pf"))
def pair_features(spark, d):
    return rounded(pairs.pair_features(_pairs(spark, d)), *PAIR_MEANS)


@register("pair_policy", sql.query(*PAIR_SQL, "x AS (" + " UNION ALL ".join(f"""SELECT '{n}' AS policy, count(*) AS n_slots, count(DISTINCT firm) AS n_dealers, avg({g}) AS gap_mean_bps, avg({m}) AS mid_mean_bps,
  avg(CAST({c} = 'None' AS INTEGER)) AS none_fraction, avg(CAST({c} = 'Some' AS INTEGER)) AS some_fraction, avg(CAST({c} = 'All' AS INTEGER)) AS all_fraction FROM pairs WHERE {w}""" for n, w, c, g, m in (
  ("A fresh / original", "fresh_pair", '"cross"', "gap_center", "mid"), ("B match slots / original", "size_time_pair", '"cross"', "gap_center", "mid"), ("C same slots / matched", "size_time_pair", "cross_matched", "matched_gap", "matched_mid"))) + ")",
  select="SELECT policy, n_slots, n_dealers, " + sql.rounded("gap_mean_bps", "mid_mean_bps", "none_fraction", "some_fraction", "all_fraction") + " FROM x"))
def pair_policy(spark, d):
    return rounded(pairs.policy_comparison(_pairs(spark, d)), "gap_mean_bps", "mid_mean_bps", "none_fraction", "some_fraction", "all_fraction")


def _extreme(label: str, field: str, order: str, b: str, a: str) -> str:
    return f"""SELECT '{label}' AS extreme, x.cusip, x.firm, x.side, x.message_ns, x.ns, x.bound AS gap_bound_bps, q.spread, q.quantity, coalesce(q.spread = x.cand, false) AS boundary_candidate
  FROM (SELECT cusip, firm, ns, {field} AS bound, unnest(['bid', 'ask']) AS side, unnest([event_ns_bid, event_ns_ask]) AS message_ns, unnest([{b}_bid, {a}_ask]) AS cand
        FROM (SELECT *, row_number() OVER (PARTITION BY cusip ORDER BY {field} {order}, ns, firm, event_ns_bid, event_ns_ask) AS r FROM dp) WHERE r <= 2) x
  JOIN quotes q ON q.cusip = x.cusip AND q.firm = x.firm AND q.side = x.side AND q.ns = x.message_ns"""


@register("pair_extremes", sql.query(*PAIR_SQL, "dp AS (SELECT cusip, firm, event_ns_bid, event_ns_ask, min(ns) AS ns, first(gap_low) AS gap_low, first(gap_high) AS gap_high, first(lo_bid) AS lo_bid, first(hi_bid) AS hi_bid, first(lo_ask) AS lo_ask, first(hi_ask) AS hi_ask FROM pairs WHERE fresh_pair GROUP BY cusip, firm, event_ns_bid, event_ns_ask)",
  select=_extreme("Low gap boundary", "gap_low", "ASC", "lo", "hi") + " UNION ALL " + _extreme("High gap boundary", "gap_high", "DESC", "hi", "lo")))
def pair_extremes(spark, d):
    return pairs.extreme_sources(quotes_view(spark, d), _pairs(spark, d)).drop("_r")


def _feature_sql() -> str:
    wide = ", ".join(f"max(CASE WHEN side = '{s}' THEN {c} END) AS bcq_{s}_{c}" for s in ("bid", "ask") for c in side.SIDE_FEATURES)
    out = [f"round(bcq_{s}_{c}, 6) AS bcq_{s}_{c}" for s in ("bid", "ask") for c in side.VALUES]
    out += [f"coalesce(bcq_{s}_{c}, 0) AS bcq_{s}_{c}" for s in ("bid", "ask") for c in side.COUNTS]
    out += [f"coalesce({c}, 0) AS bcq_{c}" for c in features.PAIR_COUNTS] + [f"round({c}, 6) AS bcq_{c}" for c in PAIR_MEANS]
    out.append("CAST(coalesce(bcq_bid_n_dealers, 0) + coalesce(bcq_ask_n_dealers, 0) > 0 AS DOUBLE) AS bcq_is_quoted")
    return sql.query(*SIDE_SQL, sql.PAIRS, f"wide AS (SELECT cusip, ns, {wide} FROM side GROUP BY ALL)", select=f"SELECT row_id, t.cusip, t.ns, {', '.join(out)} FROM trades t LEFT JOIN wide USING (cusip, ns) LEFT JOIN pf USING (cusip, ns)")


@register("query_features", _feature_sql())
def query_features(spark, d):
    f = features.point_features(history(spark, d), trades_view(spark, d).select("row_id", "cusip", "ns", "day")).drop("day")
    return rounded(f, *(f"bcq_{s}_{c}" for s in ("bid", "ask") for c in side.VALUES), *(f"bcq_{c}" for c in PAIR_MEANS))


# Movement, issuer votes, composition.  Six bonds of two issuers.

from ..config import CASE_SEED  # noqa: E402
from ..operators import clean, diagnostics, movement, population  # noqa: E402
from . import experiment, sql_more, store  # noqa: E402

WIDE = dict(bonds=6, dealers=3)
WIDE_BASE = [sql.quotes(6, 3), sql.trades(6), sql.EVENTS]


def _moves(spark, d):
    e, t = events.dealer_events(quotes_view(spark, d, **WIDE)), trades_view(spark, d, bonds=6)
    return e, t


@register("movement_direction", sql.query(*WIDE_BASE, sql_more.moves(), select=f"SELECT cusip, ns, side, {', '.join(movement.MOVE_COUNTS)}, {sql.rounded(*movement.MOVE_VALUES)} FROM move"))
def movement_direction(spark, d):
    e, t = _moves(spark, d)
    return rounded(movement.direction(movement.endpoint_states(e, t)).select("cusip", "ns", "side", *movement.MOVE_COUNTS, *movement.MOVE_VALUES), *movement.MOVE_VALUES)


@register("issuer_mapping", sql.query(*WIDE_BASE[1:2], sql_more.RECORDS, select="SELECT cusip, issuer, first_ns, conflict_ns FROM records"))
def issuer_mapping(spark, d):
    return movement.issuer_records(trades_view(spark, d, bonds=6))


@register("issuer_direction", sql.query(*WIDE_BASE, sql_more.RECORDS, sql_more.ISSUER, select=f"SELECT row_id, side, {', '.join(movement.ISSUER_COUNTS)}, {sql.rounded(*movement.ISSUER_VALUES)} FROM issuer_votes"))
def issuer_direction(spark, d):
    e, t = _moves(spark, d)
    return rounded(movement.issuer_votes(e, t), *movement.ISSUER_VALUES)


def _sidecar_sql() -> str:
    part = lambda s, t, infix, values, counts: [f"round({t}.{c}, 6) AS bcq_{s}_{infix}_{c}" for c in values] + [f"coalesce({t}.{c}, 0) AS bcq_{s}_{infix}_{c}" for c in counts]
    columns = [x for s in ("bid", "ask") for x in part(s, f"m{s}", "move", movement.MOVE_VALUES, movement.MOVE_COUNTS) + part(s, f"v{s}", "issuer_move", movement.ISSUER_VALUES, movement.ISSUER_COUNTS)]
    joins = " ".join(f"LEFT JOIN (SELECT * FROM move WHERE side = '{s}') m{s} ON m{s}.cusip = t.cusip AND m{s}.ns = t.ns LEFT JOIN (SELECT * FROM issuer_votes WHERE side = '{s}') v{s} ON v{s}.row_id = t.row_id" for s in ("bid", "ask"))
    return sql.query(*WIDE_BASE, sql_more.moves(), sql_more.RECORDS, sql_more.ISSUER, select=f"SELECT t.row_id, t.cusip, t.ns, {', '.join(columns)} FROM trades t {joins}")


@register("movement_sidecar", _sidecar_sql())
def movement_sidecar(spark, d):
    e, t = _moves(spark, d)
    f = movement.movement_features(e, t)
    return rounded(f, *(f"bcq_{s}_move_{c}" for s in ("bid", "ask") for c in movement.MOVE_VALUES), *(f"bcq_{s}_issuer_move_{c}" for s in ("bid", "ask") for c in movement.ISSUER_VALUES))


COMPOSITION = ["aggregate_delta_30m", "common_dealer_delta_30m", "center_delta_30m", "common_retention_30m", "past_common_retention_30m", "common_condition_changed_fraction_30m"]


@register("composition_30m", sql.query(*BASE[:3], sql_more.moves(age="1e18"), """comp AS (SELECT cusip, ns, side, count(*) FILTER (WHERE has_now) AS n_now, count(*) FILTER (WHERE has_old) AS n_past, count(delta) AS n_common_dealers_30m,
  count(*) FILTER (WHERE changed) AS ch, avg(c1) - avg(c0) AS aggregate_delta_30m, avg(delta) AS common_dealer_delta_30m FROM ep GROUP BY ALL),
  comp2 AS (SELECT *, CASE WHEN n_now > 0 AND n_past > 0 THEN n_common_dealers_30m <> n_now OR n_common_dealers_30m <> n_past OR ch > 0 END AS composition_changed_30m FROM comp),
  comp3 AS (SELECT * EXCLUDE (ch), CASE WHEN NOT composition_changed_30m THEN aggregate_delta_30m END AS center_delta_30m, CASE WHEN n_now > 0 THEN n_common_dealers_30m / n_now END AS common_retention_30m,
  CASE WHEN n_past > 0 THEN n_common_dealers_30m / n_past END AS past_common_retention_30m, CASE WHEN n_common_dealers_30m > 0 THEN ch / n_common_dealers_30m END AS common_condition_changed_fraction_30m FROM comp2)""",
  select=f"SELECT cusip, ns, side, n_now, n_past, n_common_dealers_30m, composition_changed_30m, {sql.rounded(*COMPOSITION)} FROM comp3"))
def composition_30m(spark, d):
    e = events.dealer_events(quotes_view(spark, d))
    return rounded(movement.composition_30m(e, trades_view(spark, d)).drop("day"), *COMPOSITION)


# The grid cleaner.

CLEAN_SQL = [sql.quotes(), sql_more.CLEAN]


def _states(spark, d, **view):
    q = quotes_view(spark, d, **view)
    grid = clean.session_grid(q)
    return q, grid, clean.clean_states(clean.grid_states(clean.replay(q), grid))


@register("clean_states", sql.query(*CLEAN_SQL, select="SELECT ns, cusip, firm, side, reason, round(spread, 6) AS spread, round(age_min, 6) AS age_min, round(change_age_min, 6) AS change_age_min, eligible, crossed FROM clean"))
def clean_states(spark, d):
    return rounded(_states(spark, d)[2].select("ns", "cusip", "firm", "side", "reason", "spread", "age_min", "change_age_min", "eligible", "crossed"), "spread", "age_min", "change_age_min")


@register("consensus_levels", sql.query(*CLEAN_SQL, select="SELECT ns, cusip, round(bid, 6) AS bid, round(ask, 6) AS ask, bid_n, ask_n FROM levels"))
def consensus_levels(spark, d):
    return rounded(clean.consensus_levels(_states(spark, d)[2]), "bid", "ask")


@register("clean_coverage", sql.query(*CLEAN_SQL, """cn AS (SELECT cusip, ns, side, count(*) AS n FROM kept GROUP BY ALL)""",
  select="SELECT b.cusip, " + ", ".join(f"round(count(*) FILTER (WHERE cn.side = '{s}' AND n >= {k}) / (SELECT count(*) FROM grid), 6) AS {s}_{m}" for s in ("bid", "ask") for m, k in (("fresh", 1), ("multi", 2))) + " FROM (SELECT DISTINCT cusip FROM quotes) b LEFT JOIN cn USING (cusip) GROUP BY b.cusip"))
def clean_coverage(spark, d):
    q, grid, s = _states(spark, d)
    return rounded(clean.coverage(s, grid, clean.top_bonds(q)), "bid_fresh", "bid_multi", "ask_fresh", "ask_multi")


@register("matched_movement", sql.query(*CLEAN_SQL, select="SELECT ns, cusip, side, n, round(delta, 6) AS delta, round(moved_fraction, 6) AS moved_fraction, round(moved_median, 6) AS moved_median, round(nonzero_delta, 6) AS nonzero_delta FROM matched_move"))
def matched_movement(spark, d):
    return rounded(clean.matched_movement(_states(spark, d)[2]), "delta", "moved_fraction", "moved_median", "nonzero_delta")


@register("bond_corr", sql.query(*CLEAN_SQL, "mv AS (SELECT ns, cusip, delta AS v FROM matched_move WHERE side = 'bid' AND delta IS NOT NULL)",
  select="SELECT a.cusip AS bond_a, b.cusip AS bond_b, count(*) AS overlap, round(CASE WHEN count(*) >= 30 THEN corr(a.v, b.v) END, 6) AS correlation FROM mv a JOIN mv b USING (ns) GROUP BY a.cusip, b.cusip"))
def bond_corr(spark, d):
    return rounded(clean.overlap_and_correlation(clean.matched_movement(_states(spark, d)[2])), "correlation")


@register("clean_reasons", sql.query(*CLEAN_SQL, select="SELECT firm, side, reason, count(*) AS n FROM clean GROUP BY ALL"))
def clean_reasons(spark, d):
    return _states(spark, d)[2].groupBy("firm", "side", "reason").agg(F.count("*").alias("n"))


@register("pca_loadings")
def pca_loadings(spark, d):
    # The tables have too few matched changes; the levels at common times stand for them.
    e = events.dealer_events(quotes_view(spark, d, bonds=3)).filter("center is not null")
    return clean.pca(e.groupBy("ns", "cusip", "side").agg(F.avg("center").alias("delta")), least=10)


@register("trend", sql.query(*CLEAN_SQL, """tr0 AS (SELECT cusip, ns, bid AS v, ns // 86400000000000 AS day, coalesce(ns - lag(ns) OVER w > 600000000000, true) AS fresh FROM levels WHERE bid IS NOT NULL WINDOW w AS (PARTITION BY cusip, ns // 86400000000000 ORDER BY ns)),
tr1 AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY cusip, day ORDER BY ns ROWS UNBOUNDED PRECEDING) AS run FROM tr0),
tr2 AS (SELECT *, row_number() OVER (PARTITION BY cusip, day, run ORDER BY ns) - 1 AS i FROM tr1)""",
  select="SELECT a.cusip, a.ns, round(sum(b.v * pow(0.5, a.i - b.i + CASE WHEN b.i = 0 THEN 0 ELSE 1 END)), 6) AS trend FROM tr2 a JOIN tr2 b ON a.cusip = b.cusip AND a.day = b.day AND a.run = b.run AND b.i <= a.i GROUP BY a.cusip, a.ns"))
def trend(spark, d):
    return rounded(clean.ewma(clean.consensus_levels(_states(spark, d)[2]), "bid"), "trend")


# Population and cases.


@register("bond_universe", sql.query(sql.trades(), sql_more.UNIVERSE, select="SELECT * FROM universe"))
def bond_universe(spark, d):
    return population.bond_universe(trades_view(spark, d))


POP_RATES = ["multi_event_rate", "share_of_all_events", "unit_equal_multi_rate", "affected_unit_rate", "issuer_equal_multi_rate", "dealer_equal_multi_rate"]


def _population(scope: str):
    def run(spark, d):
        p = population.event_population(history(spark, d), population.bond_universe(trades_view(spark, d)))
        return rounded(p.filter(F.col("scope") == scope), *POP_RATES)

    return run


for _scope in population.SCOPES:
    register(
        f"population_{_scope.lower()}",
        sql.query(*BASE, sql_more.UNIVERSE, sql_more.ANNOTATED, sql_more.POPULATION, select=f"SELECT * REPLACE ({sql.rounded(*POP_RATES)}) FROM pop JOIN unit USING (scope, entity) JOIN ei USING (scope, entity) JOIN ed USING (scope, entity) WHERE scope = '{_scope}'"),
    )(_population(_scope))

RAW_KINDS = ("Positive", "Zero", "Missing", "Other")


@register("population_raw", sql.query(sql.quotes(), sql.trades(), sql_more.UNIVERSE, "rq AS (SELECT t.*, u.issuer, u.sector FROM tagged t JOIN universe u USING (cusip))", sql_more.by_scope("rq", "sq"),
  select="SELECT scope, entity, count(*) AS raw_rows, count(*) FILTER (WHERE firm IS NULL) AS unkeyed_rows, count(DISTINCT cusip) AS quoted_bonds, " + ", ".join(f"count(*) FILTER (WHERE qkind = '{k}') AS raw_{k.lower()}_rows, round(count(*) FILTER (WHERE qkind = '{k}') / count(*), 6) AS raw_{k.lower()}_share" for k in RAW_KINDS) + " FROM sq GROUP BY scope, entity"))
def population_raw(spark, d):
    return rounded(population.raw_population(quotes_view(spark, d), population.bond_universe(trades_view(spark, d))), *(f"raw_{k.lower()}_share" for k in RAW_KINDS))


@register("trade_day_coverage", sql.query(sql.quotes(), sql.trades(), sql_more.UNIVERSE, """td AS (SELECT DISTINCT cusip, day FROM trades), tq AS (SELECT DISTINCT cusip, day, true AS quoted FROM quotes),
  tc AS (SELECT td.*, u.issuer, u.sector, coalesce(quoted, false) AS quoted, (SELECT min(day) FROM quotes) AS low, (SELECT max(day) FROM quotes) AS high FROM td JOIN universe u USING (cusip) LEFT JOIN tq USING (cusip, day))""", sql_more.by_scope("tc", "sc", dealer=False),
  select="SELECT scope, entity, count(DISTINCT cusip) AS traded_bonds, count(DISTINCT issuer) AS traded_issuers, count(*) AS traded_bond_days, count(*) FILTER (WHERE quoted) AS covered_traded_bond_days, count(DISTINCT cusip) FILTER (WHERE quoted) AS covered_bonds, count(*) FILTER (WHERE day < low OR day > high) AS outside_file_window_trade_days, count(*) FILTER (WHERE low IS NULL) AS unknown_window_trade_days, round(count(*) FILTER (WHERE quoted) / count(*), 6) AS day_coverage FROM sc GROUP BY scope, entity"))
def trade_day_coverage(spark, d):
    t = trades_view(spark, d)
    return rounded(population.trade_day_coverage(t, quotes_view(spark, d), population.bond_universe(t)), "day_coverage")


CASES = """cc AS (SELECT firm, cusip, side, day, issuer, sector, count(*) AS events, avg(CAST(multi AS INTEGER)) AS multi_rate, avg(CAST(has_unknown AS INTEGER)) AS unknown_rate, avg(CAST(pair_refresh AS INTEGER)) AS refresh_rate FROM ann GROUP BY ALL),
cd AS (SELECT firm, cusip, day, count(DISTINCT side) AS sides FROM cc GROUP BY ALL)"""


@register("case_candidates", sql.query(*BASE, sql_more.UNIVERSE, sql_more.ANNOTATED, CASES,
  select=f"SELECT cc.firm, cc.cusip, cc.side, CAST(cc.day AS VARCHAR) AS day, issuer, sector, events, round(multi_rate, 6) AS multi_rate, round(unknown_rate, 6) AS unknown_rate, round(refresh_rate, 6) AS refresh_rate, sides = 1 AS one_sided_day, CASE WHEN events <= 3 THEN '1-3' WHEN events <= 30 THEN '4-30' ELSE '31+' END AS activity, concat_ws('|', cc.firm, cc.cusip, cc.side, CAST(cc.day AS VARCHAR)) AS case_id, sha256('{CASE_SEED}|' || concat_ws('|', cc.firm, cc.cusip, cc.side, CAST(cc.day AS VARCHAR))) AS hash FROM cc JOIN cd USING (firm, cusip, day)"))
def case_candidates(spark, d):
    return rounded(day_text(population.case_candidates(history(spark, d), population.bond_universe(trades_view(spark, d)))), "multi_rate", "unknown_rate", "refresh_rate")


@register("rule_impacts", sql.query(*BASE[:1], *BASE[2:], "et AS (SELECT cusip, side, day, ns, row_number() OVER (PARTITION BY cusip, side, day ORDER BY ns) - 1 AS pos, count(*) OVER (PARTITION BY cusip, side, day) AS n FROM (SELECT DISTINCT cusip, side, day, ns FROM hist)), pick AS (SELECT * FROM et WHERE pos = 0 OR pos = n // 2 OR pos = n - 1)",
  sql.slots(source="hist", queries="pick"), sql.SIDE, "im AS (SELECT s.*, greatest(abs(center_decay - center_equal), abs(center_max_age - center_equal), abs(center_candidate_clip - center_equal), abs(center_dealer_downweight - center_equal)) AS e, CASE WHEN n_dealers > 0 THEN 1 - n_fresh_dealers / n_dealers END AS l FROM side s SEMI JOIN pick USING (cusip, side, day, ns))",
  select="SELECT cusip, side, CAST(day AS VARCHAR) AS day, round(max(e), 6) AS max_center_effect_bps, round(avg(e), 6) AS mean_center_effect_bps, round(avg(l), 6) AS coverage_loss_fraction, count(*) AS impact_queries FROM im GROUP BY cusip, side, im.day"))
def rule_impacts(spark, d):
    return rounded(day_text(population.rule_impacts(history(spark, d))), "max_center_effect_bps", "mean_center_effect_bps", "coverage_loss_fraction")


@register("fixed_cases")
def fixed_cases(spark, d):
    h = history(spark, d)
    return population.case_manifest(population.scored_cases(population.case_candidates(h, population.bond_universe(trades_view(spark, d))), population.rule_impacts(h)))


@register("issuer_choices", sql.query(*WIDE_BASE[:1], sql.trades(6), sql.EVENTS, sql.HISTORY, sql_more.UNIVERSE, sql_more.ANNOTATED, """ig AS (SELECT issuer, count(*) AS events, count(DISTINCT firm) AS dealers, avg(CAST(multi AS INTEGER)) AS multi_rate, avg(CAST(has_unknown AS INTEGER)) AS unknown_rate FROM ann GROUP BY issuer HAVING count(*) >= 100 AND count(DISTINCT day) >= 2 AND count(DISTINCT firm) >= 2 AND count(*) FILTER (WHERE multi) >= 5),
  im AS (SELECT issuer, unnest([0, 1, 2, 3]) AS p, unnest(['events', 'multi_rate', 'unknown_rate', 'dealers']) AS measure, unnest([CAST(events AS DOUBLE), multi_rate, unknown_rate, CAST(dealers AS DOUBLE)]) AS v FROM ig), ir AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY v DESC, issuer) AS r FROM im)""",
  select="SELECT issuer, min_by(measure, p) AS measure FROM ir WHERE r <= 2 GROUP BY issuer"))
def issuer_choices(spark, d):
    return population.issuer_choices(history(spark, d, **WIDE), population.bond_universe(trades_view(spark, d, bonds=6)))


# Experiment and diagnostics.


@register("chronological_split", sql.query(sql.trades(), sql_more.SPLIT, select="SELECT row_id, CAST(day AS VARCHAR) AS day, split, refit FROM split"))
def chronological_split(spark, d):
    return day_text(experiment.chronological_split(trades_view(spark, d)))


def _version_sql(version: str) -> str:
    level, count = experiment.LEVEL.get(version, "center_equal"), "n_fresh_dealers" if version == "Max age" else "n_dealers"
    get = lambda s, c: f"max(CASE WHEN side = '{s}' THEN {c} END)"
    base = [f"{DERIVED_BASE[c]} AS {c}" if c in DERIVED_BASE else f"round({c}, 6) AS {c}" if c == "prev_bm_spread" else c for c in experiment.BASE_FEATURES]
    if version == "Base":
        return sql.query(sql.trades(), select=f"SELECT row_id, {', '.join(base)} FROM trades")
    wide, out = [], []
    for s in ("bid", "ask"):
        wide += [f"{get(s, level)} AS {s}_level", f"{get(s, count)} AS {s}_k"] + [f"{get(s, c)} AS {s}_{c}" for c in experiment.RELIABILITY]
        out += [f"round({s}_level - 100 * prev_bm_spread, 6) AS {s}_anchor_gap", f"coalesce({s}_k, 0) AS {s}_n_dealers"]
        if version != "Price levels":
            out += [f"coalesce({s}_{c}, 0) AS {s}_{c}" if c.startswith("n_") else f"round({s}_{c}, 6) AS {s}_{c}" for c in experiment.RELIABILITY]
    if version == "Paired":
        out += [f"coalesce({c}, 0) AS {c}" if c.startswith("n_") else f"round({c}, 6) AS {c}" for c in experiment.PAIRED]
    pairs = ([sql.PAIRS], " LEFT JOIN pf USING (cusip, ns)") if version == "Paired" else ([], "")
    return sql.query(*SIDE_SQL, *pairs[0], f"wide AS (SELECT cusip, ns, {', '.join(wide)} FROM side GROUP BY ALL)", select=f"SELECT row_id, {', '.join(base)}, CAST(coalesce(bid_k, 0) + coalesce(ask_k, 0) > 0 AS DOUBLE) AS is_quoted, {', '.join(out)} FROM trades t LEFT JOIN wide USING (cusip, ns){pairs[1]}")


def _version(version: str):
    def run(spark, d):
        t = base_trades_view(spark, d)
        f = t if version == "Base" else features.point_features(history(spark, d), t)
        f = experiment.model_frame(f, version)
        return rounded(f, *(c for c in f.columns if c in ("prev_bm_spread", *experiment.PAIRED) and not c.startswith("n_") or c.split("_")[0] in ("bid", "ask") and "_n_" not in c))

    return run


for _v in experiment.VERSIONS:
    register(f"model_version_{_v.lower().replace(' ', '_')}", _version_sql(_v))(_version(_v))


def predictions_view(spark, d) -> DataFrame:
    """Deterministic predictions of three models for all trades."""
    models = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(k).alias("k")) for m, k in (("Base", 7), ("Reliability", 11), ("Age decay", 13))))
    t = trades_view(spark, d).withColumn("x", F.explode(models))
    e = (F.col("row_id") * F.col("x.k")) % 41 - 20
    return t.select("row_id", "ns", "day", "x.model", F.col("bm_spread").alias("truth"), (F.col("bm_spread") + e / 100).alias("pred"), e.cast("double").alias("error_bps"))


@register("model_ranking", sql.query(sql.trades(), sql_more.PREDICTIONS, select="SELECT model, count(*) AS n, round(avg(abs(error_bps)), 6) AS mae, round(quantile_cont(abs(error_bps), 0.95), 6) AS p95, round(avg(CAST(abs(error_bps) > 10 AS INTEGER)), 6) AS gt10 FROM preds GROUP BY model"))
def model_ranking(spark, d):
    return rounded(diagnostics.model_ranking(predictions_view(spark, d)), "mae", "p95", "gt10")


@register("sector_tails", sql.query(sql.trades(), sql_more.PREDICTIONS, select="SELECT coalesce(sector, 'Unknown') AS sector, count(*) AS n, count(DISTINCT day) AS dates, round(avg(sel), 6) AS mae, round(avg(sel - ref), 6) AS delta_mae, round(quantile_cont(sel, 0.95) - quantile_cont(ref, 0.95), 6) AS delta_p95, round(avg(CAST(sel > 10 AS INTEGER)) - avg(CAST(ref > 10 AS INTEGER)), 6) AS delta_gt10 FROM trades t JOIN pe USING (row_id) GROUP BY 1"))
def sector_tails(spark, d):
    return rounded(diagnostics.sector_tails(trades_view(spark, d), predictions_view(spark, d), "Age decay", "Reliability"), "mae", "delta_mae", "delta_p95", "delta_gt10")


DIAG = ["mae", "reference_mae", "delta_mae", "p95", "reference_p95", "gt10", "reference_gt10", "day_equal_delta", "lodo_min", "lodo_max", "contribution"]


def _bins_sql(c: str, cuts: str) -> str:
    edges, last = getattr(diagnostics, cuts)
    return f"CASE WHEN {c} IS NULL OR {c} < 0 THEN 'Unknown' " + " ".join(f"WHEN {c} <= {e} THEN '{n}'" for e, n in edges) + f" ELSE '{last}' END"


def _diagnostics_sql() -> str:
    d = {"support_state": "CASE WHEN bid_n + ask_n = 0 THEN 'Unquoted' WHEN bid_n > 0 AND ask_n > 0 THEN 'Two-sided' ELSE 'One-sided' END", "dealer_support": _bins_sql("(bid_n + ask_n)", "DEALER_BINS"), "peer_support": _bins_sql("(bid_p + ask_p)", "DEALER_BINS"), "paired_support": _bins_sql("n_pair", "DEALER_BINS"),
         "issuer_trade_count": "CASE WHEN per_issuer <= 20 THEN '1-20' WHEN per_issuer <= 100 THEN '21-100' WHEN per_issuer <= 500 THEN '101-500' ELSE '500+' END", "SECTOR": "coalesce(sector, 'Unknown')", "trade_size": _bins_sql("quantity", "SIZE_BINS"), "trade_type": "coalesce(trade_type, 'Unknown')"}
    for s in ("bid", "ask"):
        yes = lambda c: f"CASE WHEN {c} IS NULL THEN 'Unknown' WHEN {c} > 0 THEN 'Some' ELSE 'None' END"
        d |= {f"{s}_message_age": _bins_sql(f"{s}_m", "AGE_BINS"), f"{s}_change_age": _bins_sql(f"{s}_c", "AGE_BINS"), f"{s}_candidate_gap": _bins_sql(f"{s}_g", "GAP_BINS"), f"{s}_dispersion": _bins_sql(f"{s}_d", "GAP_BINS"), f"{s}_zero_quantity": yes(f"{s}_z"), f"{s}_unknown_quantity": yes(f"{s}_u")}
    pick = {"n": "n_dealers", "p": "n_peer_supported", "m": "median_message_age_min", "c": "median_change_age_min", "g": "mean_candidate_gap", "d": "dispersion_bps", "z": "zero_quantity_fraction", "u": "unknown_quantity_fraction"}
    wide = ", ".join(f"max(CASE WHEN side = '{s}' THEN {v} END) AS {s}_{k}" for s in ("bid", "ask") for k, v in pick.items())
    counts = ", ".join(f"coalesce({s}_{k}, 0) AS {s}_{k}" for s in ("bid", "ask") for k in ("n", "p"))
    families = " UNION ALL ".join(f"SELECT row_id, day, sel, ref, '{k}' AS family, {v} AS state FROM df" for k, v in d.items())
    return sql.query(*SIDE_SQL, sql.PAIRS, sql_more.PREDICTIONS, f"wide AS (SELECT cusip, ns, {wide} FROM side GROUP BY ALL)",
        f"df AS (SELECT t.row_id, t.day, t.sector, t.quantity, t.trade_type, count(*) OVER (PARTITION BY t.issuer) AS per_issuer, {counts}, wide.* EXCLUDE (cusip, ns, bid_n, ask_n, bid_p, ask_p), coalesce(pf.n_pair, 0) AS n_pair, pe.sel, pe.ref FROM trades t JOIN pe USING (row_id) LEFT JOIN wide USING (cusip, ns) LEFT JOIN pf USING (cusip, ns))",
        f"fam AS ({families})", "dd AS (SELECT family, state, day, sum(sel - ref) AS s, count(*) AS n FROM fam GROUP BY ALL)",
        "dl AS (SELECT family, state, avg(s / n) AS day_equal_delta, min(l) AS lodo_min, max(l) AS lodo_max FROM (SELECT *, (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) AS l FROM dd WINDOW w AS (PARTITION BY family, state)) GROUP BY ALL)",
        "dg AS (SELECT family, state, count(*) AS n, count(DISTINCT day) AS dates, avg(sel) AS mae, avg(ref) AS reference_mae, avg(sel - ref) AS delta_mae, quantile_cont(sel, 0.95) AS p95, quantile_cont(ref, 0.95) AS reference_p95, avg(CAST(sel > 10 AS INTEGER)) AS gt10, avg(CAST(ref > 10 AS INTEGER)) AS reference_gt10, sum(sel - ref) / (SELECT count(*) FROM df) AS contribution FROM fam GROUP BY ALL)",
        select=f"SELECT family, state, n, dates, {sql.rounded(*DIAG)} FROM dg JOIN dl USING (family, state)")


@register("error_diagnostics", _diagnostics_sql())
def error_diagnostics(spark, d):
    f = features.point_features(history(spark, d), trades_view(spark, d))
    return rounded(diagnostics.state_diagnostics(f, predictions_view(spark, d), "Age decay", "Reliability"), *DIAG)


@register("rule_shifts", sql.query(*SIDE_SQL, "rs AS (" + " UNION ALL ".join(f"SELECT coalesce(t.sector, 'Unknown') AS sector, '{s}' AS side, '{r}' AS rule, " + (f"CASE WHEN coalesce(x.n_peer_supported, 0) > 0 THEN abs(x.{r} - x.center_equal) END" if r in ("center_candidate_clip", "center_dealer_downweight") else f"abs(x.{r} - x.center_equal)") + f" AS shift, CAST(x.center_equal IS NOT NULL AND x.{r} IS NULL AS INTEGER) AS lost FROM trades t LEFT JOIN (SELECT * FROM side WHERE side = '{s}') x USING (cusip, ns)"
  for s in ("bid", "ask") for r in ("center_decay", "center_max_age", "center_candidate_clip", "center_dealer_downweight")) + ")", select="SELECT side, rule, sector, count(shift) AS n, round(median(shift), 6) AS median_shift, round(quantile_cont(shift, 0.95), 6) AS p95_shift, round(avg(lost), 6) AS coverage_loss FROM rs GROUP BY ALL"))
def rule_shifts(spark, d):
    f = features.point_features(history(spark, d), trades_view(spark, d))
    return rounded(diagnostics.rule_shifts(f), "median_shift", "p95_shift", "coverage_loss")


#: Damage by row and model, so that every kind of problem occurs.
_DAMAGED = """bad0 AS (SELECT * FROM preds WHERE NOT (model = 'Base' AND row_id % 97 = 5) UNION ALL SELECT * FROM preds WHERE row_id % 89 = 3),
bad AS (SELECT CASE WHEN row_id % 83 = 7 THEN -row_id - 1 ELSE row_id END AS row_id, CASE WHEN row_id % 79 = 2 THEN ns + 1 ELSE ns END AS ns, model, CASE WHEN row_id % 73 = 4 THEN NULL ELSE pred END AS pred, CASE WHEN row_id % 71 = 6 THEN error_bps + 1 ELSE error_bps END AS error_bps FROM bad0),
known AS (SELECT b.*, t.ns AS t_ns, t.bm_spread AS t_truth FROM bad b LEFT JOIN trades t USING (row_id)),
problems AS (
  SELECT 'repeated' AS problem FROM bad GROUP BY row_id, model HAVING count(*) > 1
  UNION ALL SELECT 'outside the cohort' FROM known WHERE t_ns IS NULL
  UNION ALL SELECT 'not finite' FROM known WHERE pred IS NULL
  UNION ALL SELECT 'other time' FROM known WHERE t_ns IS NOT NULL AND ns <> t_ns
  UNION ALL SELECT 'other error' FROM known WHERE NOT abs(error_bps - (pred - t_truth) * 100) <= 1e-7 + 1e-9 * abs(error_bps)
  UNION ALL SELECT 'missing' FROM trades t, (SELECT DISTINCT model FROM bad) m WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.row_id = t.row_id AND b.model = m.model)
)"""


@register("prediction_problems", sql.query(sql.trades(), sql_more.PREDICTIONS, _DAMAGED, select="SELECT problem, count(*) AS \"rows\" FROM problems GROUP BY problem"))
def prediction_problems(spark, d):
    t = trades_view(spark, d).withColumn("truth", F.col("bm_spread"))
    p = predictions_view(spark, d)
    p = p.filter("not (model = 'Base' and row_id % 97 = 5)").unionByName(p.filter("row_id % 89 = 3"))
    damage = {"row_id": "row_id % 83 = 7", "ns": "row_id % 79 = 2", "pred": "row_id % 73 = 4", "error_bps": "row_id % 71 = 6"}
    to = {"row_id": "-row_id - 1", "ns": "ns + 1", "pred": "null", "error_bps": "error_bps + 1"}
    return diagnostics.prediction_problems(t, p.withColumns({c: F.expr(f"case when {w} then {to[c]} else {c} end") for c, w in damage.items()}))


@register("event_gap_histogram", sql.query(*BASE[:1], sql.EVENTS, select="SELECT CAST(floor(gap / 2) AS BIGINT) AS bin, count(*) AS n FROM ev WHERE gap IS NOT NULL GROUP BY 1"))
def event_gap_histogram(spark, d):
    return diagnostics.histogram(events.dealer_events(quotes_view(spark, d)), "gap", 2.0)


@register("event_gap_cdf", sql.query(*BASE[:1], sql.EVENTS, "g AS (SELECT gap AS value, count(*) AS n FROM ev WHERE gap IS NOT NULL GROUP BY 1)", select="SELECT value, n, round(sum(n) OVER (ORDER BY value) / (SELECT sum(n) FROM g), 6) AS share FROM g"))
def event_gap_cdf(spark, d):
    return rounded(diagnostics.cdf(events.dealer_events(quotes_view(spark, d)), "gap"), "share")


@register("content_key")
def content_key(spark, d):
    return store.content_key(quotes_view(spark, d))


def without_plan(df: DataFrame) -> DataFrame:
    """The same rows as a scan of their RDD: what is built on it does not carry the plan of ``df`` along on the driver."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


@register("model_fit")
def model_fit(spark, d):
    t = experiment.with_split(base_trades_view(spark, d))
    categories = experiment.learn_categories(t)
    # Features of a trade need no other trade, so those of Train and Validation are enough.
    frame = features.point_features(history(spark, d), t.filter("split in ('Train', 'Validation')"))
    x = without_plan(experiment.model_rows(frame, experiment.VERSIONS, categories=categories)).cache()
    try:  # the ranking has a row for each version
        n = experiment.check_comparison(x, "Validation")
        few = x.coalesce(-(-n // experiment.ROWS_A_TASK))  # a fit is many passes, each a task for every partition
        r = diagnostics.model_ranking(experiment.compare(few, experiment.VERSIONS, trees=5, depth=3))
        return spark.createDataFrame(r.collect(), r.schema)
    finally:
        x.unpersist()
