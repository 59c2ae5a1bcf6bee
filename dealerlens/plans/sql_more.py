"""Further SQL steps: movement, the grid cleaner, population, diagnostics."""

from __future__ import annotations

from .sql import slots

BACK = 30 * 60 * 10**9


def movement(asked: str = "trades", p: str = "") -> str:
    """``{p}move``: direction statistics per (cusip, ns, day, side) of ``asked``."""
    return ",\n".join(
        [
            f"{p}asked AS (SELECT DISTINCT cusip, ns, day FROM {asked})",
            f"{p}ends AS (SELECT * FROM {p}asked UNION SELECT cusip, ns - {BACK}, day FROM {p}asked WHERE DATE '1970-01-01' + CAST((ns - {BACK}) // 86400000000000 AS INTEGER) = day)",
            slots(source="ev", name=f"{p}mslots", queries=f"{p}ends"),
            f"{p}fresh AS (SELECT cusip, ns, day, side, firm, center, quantity_set, candidate_count, age_min FROM {p}mslots WHERE complete AND age_min <= {{age}})",
            f"{p}nowt AS (SELECT f.* FROM {p}fresh f SEMI JOIN {p}asked USING (cusip, ns))",
            f"{p}oldt AS (SELECT f.* REPLACE (f.ns + {BACK} AS ns) FROM {p}fresh f WHERE EXISTS (SELECT 1 FROM {p}asked a WHERE a.cusip = f.cusip AND a.ns = f.ns + {BACK} AND a.day = f.day))",
            f"""{p}ep AS (SELECT cusip, ns, coalesce(n.day, o.day) AS day, side, firm, n.center IS NOT NULL AS has_now, o.center IS NOT NULL AS has_old, n.center AS c1, o.center AS c0,
  CASE WHEN n.center IS NOT NULL AND o.center IS NOT NULL THEN n.center - o.center END AS delta,
  CASE WHEN n.center IS NOT NULL AND o.center IS NOT NULL THEN n.quantity_set <> o.quantity_set OR n.candidate_count <> o.candidate_count END AS changed, greatest(n.age_min, o.age_min) AS age
  FROM {p}nowt n FULL JOIN {p}oldt o USING (cusip, ns, side, firm))""",
            f"""{p}move AS (SELECT cusip, ns, day, side, avg(delta) AS mean_bps, median(delta) AS median_bps, avg(delta) FILTER (WHERE NOT changed) AS guarded_mean_bps,
  avg(CAST(delta > 0 AS INTEGER)) AS up_fraction, avg(CAST(delta < 0 AS INTEGER)) AS down_fraction, avg(CAST(delta = 0 AS INTEGER)) AS flat_fraction,
  count(delta) AS common_n, count(*) FILTER (WHERE has_now) AS current_n, count(*) FILTER (WHERE has_old) AS lookback_n, count(*) FILTER (WHERE NOT changed) AS guarded_common_n,
  CASE WHEN count(delta) > 0 THEN count(delta) / greatest(count(*) FILTER (WHERE has_now), count(*) FILTER (WHERE has_old)) END AS retention,
  avg(CAST(changed AS INTEGER)) AS condition_changed_fraction, avg(age) FILTER (WHERE delta IS NOT NULL) AS mean_support_age_min, max(age) FILTER (WHERE delta IS NOT NULL) AS max_support_age_min,
  avg(age) FILTER (WHERE NOT changed) AS guarded_mean_age, max(age) FILTER (WHERE NOT changed) AS guarded_max_age FROM {p}ep GROUP BY ALL)""",
        ]
    )


def moves(asked: str = "trades", p: str = "", age: str = "30") -> str:
    return movement(asked, p).replace("{age}", age)


RECORDS = """lab AS (SELECT cusip, ns, CASE WHEN lower(trim(issuer)) NOT IN ('', 'unknown', 'none', 'nan', '<na>') THEN trim(issuer) END AS label FROM trades),
f1 AS (SELECT cusip, min(ns) FILTER (WHERE label IS NOT NULL) AS first_ns FROM lab GROUP BY ALL),
f2 AS (SELECT cusip, first_ns, min(label) AS issuer FROM lab JOIN f1 USING (cusip) WHERE ns = first_ns GROUP BY ALL HAVING count(DISTINCT label) = 1 AND count(*) = count(label)),
records AS (SELECT f2.cusip, f2.issuer, f2.first_ns, coalesce(min(lab.ns) FILTER (WHERE lab.label IS DISTINCT FROM f2.issuer), 9223372036854775807) AS conflict_ns FROM f2 JOIN lab USING (cusip) WHERE lab.ns >= f2.first_ns GROUP BY ALL)"""

ISSUER = f"""ask AS (SELECT t.row_id, t.cusip, t.ns, t.day, r.issuer FROM trades t JOIN records r USING (cusip) WHERE t.ns >= r.first_ns AND t.ns < r.conflict_ns),
dt AS (SELECT DISTINCT r.cusip, a.ns, a.day, r.issuer FROM ask a JOIN records r ON a.issuer = r.issuer AND r.first_ns <= a.ns - {BACK} AND r.conflict_ns > a.ns),
{moves("dt", "i")},
votes AS (SELECT a.row_id, m.side, m.guarded_mean_bps AS v, m.guarded_common_n AS n, m.guarded_mean_age AS a1, m.guarded_max_age AS a2
  FROM ask a JOIN dt d ON d.issuer = a.issuer AND d.ns = a.ns AND d.cusip <> a.cusip JOIN imove m ON m.cusip = d.cusip AND m.ns = d.ns WHERE m.guarded_mean_bps IS NOT NULL),
issuer_votes AS (SELECT row_id, side, count(*) AS other_bond_n, CAST(sum(n) AS BIGINT) AS common_dealer_n, CASE WHEN count(*) >= 2 THEN avg(v) END AS mean_bps, CASE WHEN count(*) >= 2 THEN median(v) END AS median_bps,
  CASE WHEN count(*) >= 2 THEN avg(CAST(v > 0 AS INTEGER)) END AS up_fraction, CASE WHEN count(*) >= 2 THEN avg(CAST(v < 0 AS INTEGER)) END AS down_fraction, CASE WHEN count(*) >= 2 THEN avg(CAST(v = 0 AS INTEGER)) END AS flat_fraction,
  CASE WHEN count(*) >= 2 THEN stddev_pop(v) END AS dispersion_bps, CASE WHEN count(*) >= 2 THEN avg(a1) END AS mean_support_age_min, CASE WHEN count(*) >= 2 THEN max(a2) END AS max_support_age_min FROM votes GROUP BY ALL)"""

CLEAN = """rp0 AS (SELECT DISTINCT cusip, firm, side, ns, spread, quantity AS raw_size, CASE WHEN quantity > 0 THEN quantity END AS size FROM quotes),
rp1 AS (SELECT cusip, firm, side, ns, median(spread) AS med, CASE WHEN count(DISTINCT size) + max(CAST(size IS NULL AS INTEGER)) = 1 THEN max(size) END AS quantity,
  count(*) > 1 AND (coalesce(max(spread) - min(spread) > 2, false) OR count(spread) <> count(*)) AS tie_conflict FROM rp0 GROUP BY ALL),
rp2 AS (SELECT * EXCLUDE (med), CASE WHEN NOT tie_conflict THEN med END AS spread FROM rp1),
rp3 AS (SELECT *, row_number() OVER w = 1 OR spread IS DISTINCT FROM lag(spread) OVER w AS chg FROM rp2 WINDOW w AS (PARTITION BY cusip, firm, side ORDER BY ns)),
replay AS (SELECT * EXCLUDE (chg), max(CASE WHEN chg THEN ns END) OVER (PARTITION BY cusip, firm, side ORDER BY ns ROWS UNBOUNDED PRECEDING) AS last_change FROM rp3),
span AS (SELECT min(ns) // 300000000000 AS a, CAST(ceil(max(ns) / 300000000000) AS BIGINT) + 1 AS b FROM quotes),
grid AS (SELECT ns FROM (SELECT CAST(unnest(range(a, b + 1)) * 300000000000 AS BIGINT) AS ns FROM span)
  WHERE isodow(DATE '1970-01-01' + CAST(ns // 86400000000000 AS INTEGER)) <= 5 AND (ns % 86400000000000) / 6e10 BETWEEN 480 AND 1020),
cs0 AS (SELECT g.ns, g.cusip, g.firm, g.side, r.ns AS event_ns, (g.ns - r.ns) / 60e9 AS age_min, (g.ns - r.last_change) / 60e9 AS change_age_min, r.spread, r.quantity, r.tie_conflict
  FROM (SELECT * FROM grid, (SELECT DISTINCT cusip, firm, side FROM replay)) g ASOF JOIN replay r ON g.cusip = r.cusip AND g.firm = r.firm AND g.side = r.side AND g.ns > r.ns),
cs1 AS (SELECT *, CASE WHEN age_min > 30 THEN 'expired' WHEN tie_conflict THEN 'timestamp conflict' WHEN spread IS NULL THEN 'nonfinite' ELSE 'kept' END AS r0 FROM cs0),
pr AS (SELECT b.ns, b.cusip, b.firm, abs(b.event_ns - a.event_ns) <= 300000000000 AND (coalesce(b.quantity = a.quantity, false) OR b.quantity IS NULL OR a.quantity IS NULL) AS eligible, b.spread AS sb, a.spread AS sa
  FROM (SELECT * FROM cs1 WHERE r0 = 'kept' AND side = 'bid') b JOIN (SELECT * FROM cs1 WHERE r0 = 'kept' AND side = 'ask') a USING (ns, cusip, firm)),
pf2 AS (SELECT *, eligible AND sb < sa AS crossed, eligible AND sb = 0 AND abs(sa) >= 10 AS zb, eligible AND sa = 0 AND abs(sb) >= 10 AS za FROM pr),
cs2 AS (SELECT c.*, coalesce(p.eligible, false) AS eligible, coalesce(p.crossed, false) AS crossed,
  CASE WHEN r0 <> 'kept' THEN r0 WHEN (side = 'bid' AND p.zb) OR (side = 'ask' AND p.za) THEN 'contextual zero' WHEN p.crossed AND NOT p.zb AND NOT p.za THEN 'crossed dealer pair' ELSE r0 END AS r1 FROM cs1 c LEFT JOIN pf2 p USING (ns, cusip, firm)),
ctr AS (SELECT ns, cusip, side, median(spread) AS m, count(*) AS peers FROM cs2 WHERE r1 = 'kept' GROUP BY ALL),
mad AS (SELECT c.ns, c.cusip, c.side, any_value(m) AS m, any_value(peers) AS peers, median(abs(c.spread - m)) AS mad FROM cs2 c JOIN ctr USING (ns, cusip, side) WHERE r1 = 'kept' GROUP BY ALL),
clean AS (SELECT c.*, CASE WHEN r1 = 'kept' AND peers >= 3 AND abs(c.spread - m) > 4 * greatest(1.4826 * mad, 2) THEN 'peer outlier' ELSE r1 END AS reason FROM cs2 c LEFT JOIN mad USING (ns, cusip, side)),
kept AS (SELECT *, eligible AND NOT crossed AND count(*) OVER (PARTITION BY ns, cusip, firm) = 2 AS pair FROM clean WHERE reason = 'kept'),
lv0 AS (SELECT ns, cusip, coalesce(median(spread) FILTER (WHERE side = 'bid' AND pair), median(spread) FILTER (WHERE side = 'bid')) AS b, coalesce(median(spread) FILTER (WHERE side = 'ask' AND pair), median(spread) FILTER (WHERE side = 'ask')) AS a,
  count(*) FILTER (WHERE side = 'bid') AS bid_n, count(*) FILTER (WHERE side = 'ask') AS ask_n FROM kept GROUP BY ALL),
levels AS (SELECT ns, cusip, CASE WHEN NOT coalesce(b < a, false) THEN b END AS bid, CASE WHEN NOT coalesce(b < a, false) THEN a END AS ask, bid_n, ask_n FROM lv0),
mm AS (SELECT n.ns, n.cusip, n.side, n.spread, o.spread AS old, n.spread - o.spread AS delta FROM kept n JOIN kept o ON n.cusip = o.cusip AND n.firm = o.firm AND n.side = o.side AND n.ns = o.ns + 1800000000000
  WHERE n.ns // 86400000000000 = (n.ns - 1800000000000) // 86400000000000),
matched_move AS (SELECT ns, cusip, side, CASE WHEN count(*) >= 2 THEN median(delta) END AS delta, count(*) AS n, avg(CAST(abs(delta) > 1e-10 AS INTEGER)) AS moved_fraction, CASE WHEN count(*) >= 2 THEN median(delta) FILTER (WHERE abs(delta) > 1e-10) END AS moved_median,
  CASE WHEN count(*) FILTER (WHERE spread <> 0 AND old <> 0) >= 2 THEN median(delta) FILTER (WHERE spread <> 0 AND old <> 0) END AS nonzero_delta FROM mm GROUP BY ALL)"""

UNIVERSE = """universe AS (SELECT trim(cusip) AS cusip, CASE count(DISTINCT trim(issuer)) WHEN 0 THEN 'Unknown' WHEN 1 THEN min(trim(issuer)) ELSE 'Conflicting' END AS issuer,
  CASE count(DISTINCT trim(sector)) WHEN 0 THEN 'Unknown' WHEN 1 THEN min(trim(sector)) ELSE 'Conflicting' END AS sector, count(*) AS trade_rows FROM trades GROUP BY 1)"""

ANNOTATED = """sp AS (SELECT DISTINCT firm, cusip, side, ns FROM (SELECT firm, cusip, side, ns, qtag FROM tagged WHERE qkind = 'Positive' AND spread IS NOT NULL GROUP BY ALL HAVING count(DISTINCT spread) > 1)),
ann0 AS (SELECT h.*, candidate_count > 1 AS multi, sp.firm IS NOT NULL AS same_positive_multi, list_contains(quantity_set, 'Zero') AS has_zero, len(list_filter(quantity_set, lambda t: t = 'Missing' OR starts_with(t, 'Other:'))) > 0 AS has_unknown, u.issuer, u.sector
  FROM hist h LEFT JOIN sp USING (firm, cusip, side, ns) JOIN universe u USING (cusip)),
ann AS (SELECT *, CASE WHEN has_unknown THEN 'unknown' WHEN has_zero THEN 'zero' WHEN len(quantity_set) > 1 THEN 'different' ELSE 'same' END AS qclass FROM ann0)"""


def by_scope(source: str, name: str, dealer: bool = True) -> str:
    return f"{name} AS (SELECT *, 'Global' AS scope, 'All' AS entity FROM {source} UNION ALL SELECT *, 'SECTOR', sector FROM {source} UNION ALL SELECT *, 'Issuer', issuer FROM {source}" + (f" UNION ALL SELECT *, 'Dealer', firm FROM {source}" if dealer else "") + ")"


POPULATION = f"""{by_scope("ann", "sa")},
pop AS (SELECT scope, entity, count(*) AS events, count(*) FILTER (WHERE multi) AS multi_events, count(DISTINCT issuer) AS observed_issuers, count(DISTINCT firm) AS observed_dealers, count(DISTINCT cusip) AS keyed_bonds,
  count(DISTINCT (cusip, day)) AS observed_bond_days, count(DISTINCT (cusip, day)) FILTER (WHERE multi) AS affected_bond_days, count(*) FILTER (WHERE same_positive_multi) AS same_positive_multi_events,
  count(*) FILTER (WHERE has_unknown) AS unknown_quantity_events, count(*) FILTER (WHERE has_zero) AS zero_quantity_events, count(*) FILTER (WHERE NOT complete) AS incomplete_events, CAST(sum(repeats) AS BIGINT) AS repeats,
  count(*) FILTER (WHERE history_break) AS history_breaks, count(*) FILTER (WHERE pair_refresh) AS pair_refreshes, count(*) FILTER (WHERE spread_changed) AS spread_changes, count(*) FILTER (WHERE observed_aba) AS aba_events,
  {", ".join(f"count(*) FILTER (WHERE qclass = '{q}') AS quantity_event_{q}" for q in ("same", "different", "zero", "unknown"))},
  count(*) FILTER (WHERE multi) / count(*) AS multi_event_rate, count(*) / (SELECT count(*) FROM ann) AS share_of_all_events FROM sa GROUP BY ALL),
unit AS (SELECT scope, entity, count(*) AS dealer_bond_side_days, count(*) FILTER (WHERE r > 0) AS affected_dealer_bond_side_days, avg(r) AS unit_equal_multi_rate, count(*) FILTER (WHERE r > 0) / count(*) AS affected_unit_rate
  FROM (SELECT scope, entity, cusip, firm, side, day, avg(CAST(multi AS INTEGER)) AS r FROM sa GROUP BY ALL) GROUP BY ALL),
ei AS (SELECT scope, entity, avg(r) AS issuer_equal_multi_rate FROM (SELECT scope, entity, issuer, avg(CAST(multi AS INTEGER)) AS r FROM sa GROUP BY ALL) GROUP BY ALL),
ed AS (SELECT scope, entity, avg(r) AS dealer_equal_multi_rate FROM (SELECT scope, entity, firm, avg(CAST(multi AS INTEGER)) AS r FROM sa GROUP BY ALL) GROUP BY ALL)"""

SPLIT = """sd AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS r FROM (SELECT DISTINCT day FROM trades)),
split AS (SELECT row_id, t.day, t.ns, CASE WHEN r <= 5 THEN 'Test' WHEN r <= 10 THEN 'Validation' WHEN r <= 12 THEN 'Embargo' ELSE 'Train' END AS split, r > 7 AS refit FROM trades t JOIN sd USING (day))"""

PREDICTIONS = """preds AS (SELECT row_id, t.ns, t.day, m.model, bm_spread AS truth, bm_spread + (((row_id * m.k) % 41) - 20) / 100 AS pred, CAST(((row_id * m.k) % 41) - 20 AS DOUBLE) AS error_bps
  FROM trades t, (VALUES ('Base', 7), ('Reliability', 11), ('Age decay', 13)) m(model, k)),
pe AS (SELECT row_id, max(abs(error_bps)) FILTER (WHERE model = 'Age decay') AS sel, max(abs(error_bps)) FILTER (WHERE model = 'Reliability') AS ref FROM preds GROUP BY ALL)"""
