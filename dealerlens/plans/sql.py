"""The queries as DuckDB SQL, built from named steps.  They state the semantics a second
time, with lists, lateral joins and ASOF joins, and serve as the oracle."""

from __future__ import annotations


def quotes(bonds: int = 2, dealers: int = 4) -> str:
    return f"""quotes AS (
  SELECT 'B' || (user_id % {bonds}) AS cusip, 'D' || ((user_id // {bonds}) % {dealers}) AS firm,
         CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
         CAST((epoch_us(ts) // 1200000000) * 1200000000 * 1000 AS BIGINT) AS ns,
         CAST(ts AS DATE) AS day,
         CASE WHEN k % 17 <> 0 THEN round(value / 10, 0) END AS spread,
         CAST(CASE WHEN k < 10 THEN 0 WHEN k < 20 THEN NULL WHEN k < 25 THEN -1 ELSE k % 3 + 1 END AS DOUBLE) AS quantity
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type <> 'purchase')
), tagged AS (
  SELECT *, CASE WHEN quantity IS NULL THEN 'Missing' WHEN quantity = 0 THEN 'Zero' WHEN quantity > 0 THEN 'Positive' ELSE 'Other' END AS qkind,
         CASE WHEN quantity IS NULL THEN 'Missing' WHEN quantity = 0 THEN 'Zero' WHEN quantity > 0 THEN 'q=' || quantity ELSE 'Other:' || quantity END AS qtag
  FROM quotes
)"""


def trades(bonds: int = 2) -> str:
    return f"""trades AS (
  SELECT event_id AS row_id, 'B' || (user_id % {bonds}) AS cusip, CAST(epoch_us(ts) * 1000 AS BIGINT) AS ns, CAST(ts AS DATE) AS day,
         value / 1000 AS bm_spread, value / 1000 - (event_id % 7 - 3) / 100 AS prev_bm_spread,
         CAST((event_id % 5 + 1) * 50000 AS DOUBLE) AS quantity,
         CASE event_id % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'B' ELSE 'D' END AS trade_type,
         CASE WHEN user_id % {bonds} = 1 AND event_id % 40 = 0 THEN 'Unknown' ELSE 'I' || ((user_id % {bonds}) // 3) END AS issuer,
         CASE WHEN event_id % 10 = 0 THEN NULL WHEN user_id % {bonds} = 1 AND event_id % 4 = 1 THEN 'Bank'
              WHEN (user_id % {bonds}) % 2 = 0 THEN 'Energy' ELSE 'Financial' END AS sector
  FROM events WHERE event_type = 'purchase'
)"""


EVENTS = """ev0 AS (
  SELECT firm, cusip, side, ns, day, count(*) AS "rows", count(*) - count(DISTINCT (spread, quantity)) AS repeats,
         sum(CASE WHEN spread IS NULL THEN 1 ELSE 0 END) AS bad,
         list_sort(coalesce(list(DISTINCT spread) FILTER (WHERE spread IS NOT NULL), [])) AS spread_set,
         list_sort(list(DISTINCT qtag)) AS quantity_set,
         list_sort(list(DISTINCT coalesce(CAST(spread AS VARCHAR), '?') || '|' || qtag)) AS pair_set,
         list(DISTINCT {s: spread, qtag: qtag}) AS pairs
  FROM tagged GROUP BY ALL
), ev AS (
  SELECT *, CAST(len(spread_set) AS INTEGER) AS candidate_count, list_min(spread_set) AS lo, list_max(spread_set) AS hi, list_median(spread_set) AS center,
         list_max(spread_set) - list_min(spread_set) AS gap,
         list_min(list_transform(spread_set, lambda x: abs(x - list_median(spread_set)))) AS center_nearest_gap,
         bad = 0 AND len(spread_set) > 0 AS complete
  FROM ev0
)"""

HISTORY = """h0 AS (
  SELECT *, lag(ns) OVER w AS p_ns, lag(spread_set) OVER w AS p_s, lag(quantity_set) OVER w AS p_q, lag(pair_set) OVER w AS p_p, lag(complete) OVER w AS p_c,
         lag(candidate_count) OVER w AS p_n, lag(center) OVER w AS p_center, lag(lo) OVER w AS p_lo, lag(hi) OVER w AS p_hi, lag(pair_set, 2) OVER w AS p_p2
  FROM ev WINDOW w AS (PARTITION BY firm, cusip, side, day ORDER BY ns)
), h1 AS (
  SELECT *, (ns - p_ns) / 60e9 AS interval_min, NOT coalesce((ns - p_ns) / 60e9 <= 60 AND complete AND p_c, false) AS history_break FROM h0
), h2 AS (
  SELECT *, NOT history_break AND spread_set IS DISTINCT FROM p_s AS spread_changed, NOT history_break AND pair_set IS NOT DISTINCT FROM p_p AS pair_refresh,
         NOT history_break AND (quantity_set IS DISTINCT FROM p_q OR candidate_count <> p_n) AS condition_changed FROM h1
), h3 AS (
  SELECT *, CASE WHEN NOT history_break THEN center - p_center END AS center_delta,
         CASE WHEN NOT history_break AND NOT condition_changed THEN center - p_center END AS guarded_delta,
         CASE WHEN NOT history_break AND NOT condition_changed THEN lo - p_lo END AS lo_delta,
         CASE WHEN NOT history_break AND NOT condition_changed THEN hi - p_hi END AS hi_delta,
         NOT history_break AND coalesce(NOT lag(history_break) OVER w, false) AND pair_set IS NOT DISTINCT FROM p_p2 AND pair_set IS DISTINCT FROM p_p AS observed_aba,
         sum(CAST(history_break AS INTEGER)) OVER (w ROWS UNBOUNDED PRECEDING) AS seg
  FROM h2 WINDOW w AS (PARTITION BY firm, cusip, side, day ORDER BY ns)
), hist AS (
  SELECT *, min(ns) OVER s AS history_start, max(CASE WHEN spread_changed THEN ns END) OVER (s ROWS UNBOUNDED PRECEDING) AS last_change,
         CAST(coalesce(sum(CAST(spread_changed AS BIGINT)) OVER (s RANGE BETWEEN 1799999999999 PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS changes_30m
  FROM h3 WINDOW s AS (PARTITION BY firm, cusip, side, day, seg ORDER BY ns)
)"""


def slots(op: str = ">=", source: str = "ev", name: str = "slots", queries: str = "trades", at: str = "ns") -> str:
    """Latest event per query time, dealer and side, same day."""
    return f"""{name} AS (
  SELECT g.cusip, g.firm, g.side, g.day, g.ns, e.ns AS event_ns, (g.ns - e.ns) / 60e9 AS age_min, e.* EXCLUDE (cusip, firm, side, day, ns)
  FROM (SELECT DISTINCT q.cusip, q.{at} AS ns, q.day, d.firm, d.side FROM {queries} q JOIN (SELECT DISTINCT cusip, firm, side, day FROM {source}) d USING (cusip, day)) g
  ASOF JOIN {source} e ON g.cusip = e.cusip AND g.firm = e.firm AND g.side = e.side AND g.day = e.day AND g.ns {op} e.ns
)"""


SIDE = """sf0 AS (
  SELECT *, complete AND age_min <= 30 AS fresh, min(CASE WHEN complete THEN age_min END) OVER (PARTITION BY cusip, ns, side) AS least,
         CASE WHEN last_change IS NOT NULL THEN (ns - last_change) / 60e9 END AS change_age,
         list_contains(quantity_set, 'Zero') AS zero, len(list_filter(quantity_set, lambda t: t = 'Missing' OR starts_with(t, 'Other:'))) > 0 AS unknown,
         spread_set[(len(spread_set) + 1) // 2] AS mid_low, spread_set[len(spread_set) // 2 + 1] AS mid_high
  FROM slots
), sf1 AS (
  SELECT *, CASE WHEN complete THEN pow(2, -(age_min - least) / 30) END AS w FROM sf0
), peers AS (
  SELECT a.cusip, a.ns, a.side, a.firm, count(*) AS n, median(b.center) AS ref FROM sf1 a JOIN sf1 b USING (cusip, ns, side) WHERE a.complete AND b.fresh AND a.firm <> b.firm GROUP BY ALL
), rads AS (
  SELECT p.cusip, p.ns, p.side, p.firm, p.ref, greatest(10, 4 * 1.4826 * median(abs(b.center - p.ref))) AS radius
  FROM peers p JOIN sf1 b USING (cusip, ns, side) WHERE b.fresh AND p.firm <> b.firm AND p.n >= 3 GROUP BY ALL
), judged AS (
  SELECT s.*, r.ref, r.radius, r.ref IS NOT NULL AS supported,
         CASE WHEN r.ref IS NULL THEN s.center ELSE (least(greatest(mid_low, ref - radius), ref + radius) + least(greatest(mid_high, ref - radius), ref + radius)) / 2 END AS clipped,
         CASE WHEN r.ref IS NULL OR s.center = ref THEN 1 ELSE least(1, radius / abs(s.center - ref)) END AS dw
  FROM sf1 s LEFT JOIN rads r USING (cusip, ns, side, firm)
), side AS (
  SELECT cusip, ns, day, side,
    avg(center) FILTER (WHERE complete) AS center_equal,
    sum(center * w) / sum(w) AS center_decay,
    avg(center) FILTER (WHERE fresh) AS center_max_age,
    stddev_pop(center) FILTER (WHERE complete) AS dispersion_bps,
    avg(gap) FILTER (WHERE complete) AS mean_candidate_gap,
    avg(CAST(candidate_count > 1 AS INTEGER)) FILTER (WHERE complete) AS multi_fraction,
    avg(CAST(zero AS INTEGER)) FILTER (WHERE complete) AS zero_quantity_fraction,
    avg(CAST(unknown AS INTEGER)) FILTER (WHERE complete) AS unknown_quantity_fraction,
    median(age_min) FILTER (WHERE complete) AS median_message_age_min,
    median(change_age) FILTER (WHERE complete) AS median_change_age_min,
    avg(CAST(change_age IS NULL AS INTEGER)) FILTER (WHERE complete) AS unknown_change_age_fraction,
    avg(lo) FILTER (WHERE complete) AS center_lower,
    avg(hi) FILTER (WHERE complete) AS center_upper,
    max(w) / sum(w) AS max_decay_weight_share,
    sum(w) * sum(w) / sum(w * w) AS decay_effective_dealers,
    avg(clipped) FILTER (WHERE complete) AS center_candidate_clip,
    sum(center * dw) FILTER (WHERE complete) / sum(dw) FILTER (WHERE complete) AS center_dealer_downweight,
    count(*) FILTER (WHERE complete) AS n_dealers,
    count(*) FILTER (WHERE fresh) AS n_fresh_dealers,
    count(*) FILTER (WHERE NOT complete) AS n_incomplete,
    count(*) FILTER (WHERE complete AND supported) AS n_peer_supported,
    count(*) FILTER (WHERE complete AND supported AND (lo < ref - radius OR hi > ref + radius)) AS n_clipped_dealers,
    count(*) FILTER (WHERE complete AND supported AND abs(clipped - center) > 1e-9) AS n_changed_centers
  FROM judged GROUP BY ALL
)"""

PAIRS = """pb AS (SELECT * FROM slots WHERE side = 'bid'), pa AS (SELECT * FROM slots WHERE side = 'ask'), p0 AS (
  SELECT coalesce(b.cusip, a.cusip) AS cusip, coalesce(b.ns, a.ns) AS ns, coalesce(b.day, a.day) AS day, coalesce(b.firm, a.firm) AS firm,
         b.event_ns IS NOT NULL AND a.event_ns IS NOT NULL AS "both", coalesce(b.complete AND a.complete, false) AS complete,
         b.event_ns AS event_ns_bid, a.event_ns AS event_ns_ask, b.age_min AS age_min_bid, a.age_min AS age_min_ask,
         b.lo AS lo_bid, b.hi AS hi_bid, b.center AS center_bid, a.lo AS lo_ask, a.hi AS hi_ask, a.center AS center_ask,
         b.pairs AS pairs_bid, a.pairs AS pairs_ask, b.quantity_set AS tags_bid, a.quantity_set AS tags_ask
  FROM pb b FULL JOIN pa a USING (cusip, ns, firm)
), sized AS (
  SELECT x.cusip, x.ns, x.firm, 'bid' AS side, u.qtag, min(u.s) AS lo, max(u.s) AS hi, median(u.s) AS mid FROM p0 x, unnest(x.pairs_bid) AS t(u) WHERE x.complete AND starts_with(u.qtag, 'q=') GROUP BY ALL
  UNION ALL
  SELECT x.cusip, x.ns, x.firm, 'ask', u.qtag, min(u.s), max(u.s), median(u.s) FROM p0 x, unnest(x.pairs_ask) AS t(u) WHERE x.complete AND starts_with(u.qtag, 'q=') GROUP BY ALL
), matched AS (
  SELECT cusip, ns, firm, count(*) AS n, min(b.lo - a.hi) AS matched_gap_low, max(b.hi - a.lo) AS matched_gap_high, avg(b.mid - a.mid) AS matched_gap, avg((b.mid + a.mid) / 2) AS matched_mid
  FROM (SELECT * FROM sized WHERE side = 'bid') b JOIN (SELECT * FROM sized WHERE side = 'ask') a USING (cusip, ns, firm, qtag) GROUP BY ALL
), p1 AS (
  SELECT p.*, CASE WHEN "both" THEN greatest(age_min_bid, age_min_ask) END AS max_age, abs(event_ns_bid - event_ns_ask) / 60e9 AS time_gap,
         coalesce(event_ns_bid = event_ns_ask, false) AS same_time,
         CASE WHEN complete THEN lo_bid - hi_ask END AS gap_low, CASE WHEN complete THEN hi_bid - lo_ask END AS gap_high, CASE WHEN complete THEN center_bid - center_ask END AS gap_center,
         CASE WHEN complete THEN (center_bid + center_ask) / 2 END AS mid, CASE WHEN complete THEN (hi_bid - lo_bid + hi_ask - lo_ask) / 2 END AS mid_range,
         CAST(coalesce(m.n, 0) AS INTEGER) AS positive_matches,
         CASE WHEN NOT complete THEN 'Unassessed' WHEN m.n > 0 THEN 'Shared positive'
              WHEN len(list_filter(list_concat(tags_bid, tags_ask), lambda t: NOT starts_with(t, 'q='))) = 0 THEN 'Positive unmatched' ELSE 'Unknown / mixed' END AS size_state,
         matched_gap_low, matched_gap_high, matched_gap, matched_mid
  FROM p0 p LEFT JOIN matched m USING (cusip, ns, firm)
), pairs AS (
  SELECT *, CASE WHEN NOT complete THEN 'Unassessed' WHEN gap_low >= 0 THEN 'None' WHEN gap_high < 0 THEN 'All' ELSE 'Some' END AS "cross",
         CASE WHEN positive_matches = 0 THEN 'Unassessed' WHEN matched_gap_low >= 0 THEN 'None' WHEN matched_gap_high < 0 THEN 'All' ELSE 'Some' END AS cross_matched,
         coalesce(complete AND max_age <= 30, false) AS fresh_pair, coalesce(complete AND max_age <= 30 AND time_gap <= 1 AND positive_matches > 0, false) AS size_time_pair
  FROM p1
), pf AS (
  SELECT cusip, ns, count(*) FILTER (WHERE fresh_pair) AS n_pair, count(*) FILTER (WHERE size_time_pair) AS n_size_time_pair,
    avg(gap_center) FILTER (WHERE fresh_pair) AS pair_gap, avg(gap_low) FILTER (WHERE fresh_pair) AS pair_gap_low, avg(gap_high) FILTER (WHERE fresh_pair) AS pair_gap_high,
    avg(mid) FILTER (WHERE fresh_pair) AS pair_mid, avg(mid_range) FILTER (WHERE fresh_pair) AS pair_mid_range,
    avg(CAST("cross" = 'Some' AS INTEGER)) FILTER (WHERE fresh_pair) AS pair_cross_some, avg(CAST("cross" = 'All' AS INTEGER)) FILTER (WHERE fresh_pair) AS pair_cross_all,
    median(time_gap) FILTER (WHERE fresh_pair) AS pair_time_gap, avg(CAST(positive_matches = 0 AS INTEGER)) FILTER (WHERE fresh_pair) AS pair_unknown_size,
    avg(matched_gap) FILTER (WHERE size_time_pair) AS size_time_gap, avg(matched_mid) FILTER (WHERE size_time_pair) AS size_time_mid,
    avg(CAST(cross_matched = 'Some' AS INTEGER)) FILTER (WHERE size_time_pair) AS size_time_cross_some, avg(CAST(cross_matched = 'All' AS INTEGER)) FILTER (WHERE size_time_pair) AS size_time_cross_all
  FROM pairs GROUP BY ALL
)"""


def query(*steps: str, select: str) -> str:
    return "WITH " + ",\n".join(steps) + "\n" + select


def rounded(*names: str) -> str:
    return ", ".join(f'round({n}, 6) AS {n}' for n in names)
