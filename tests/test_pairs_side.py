import random
from statistics import median

import pytest

from dealerlens.operators import events as E
from dealerlens.operators import features, movement, pairs, side

from .helpers import at, queries, quotes, rows_of


def events_of(spark, rows):
    return E.prepare_events(quotes(spark, rows))


def pairs_of(spark, rows, minutes, **options):
    return rows_of(pairs.pair_snapshots(events_of(spark, rows), queries(spark, minutes), **options), "ns", "firm")


def test_crossing_classes(spark):
    p = pairs_of(spark, [(0, "A", "bid", 100, 0), (0, "A", "bid", 120, 0), (0, "A", "ask", 110, 0), (0, "B", "bid", 100, 2), (0, "B", "ask", 100, 2), (0, "C", "bid", -10, 2), (0, "C", "ask", -5, 2)], [0])
    assert [x["cross"] for x in p] == ["Some", "None", "All"]
    assert (p[0]["gap_low"], p[0]["gap_high"], p[1]["gap_center"], p[2]["gap_center"]) == (-10, 10, 0, -5)


def test_size_matching(spark):
    rows = [(0, "A", "bid", 1, 0), (0, "A", "ask", 1, 0), (0, "B", "bid", 90, 2), (0, "B", "bid", 110, 2), (0, "B", "ask", 100, 2), (0, "B", "ask", 200, 5), (0, "C", "bid", 1, 2), (0, "C", "ask", 1, 5)]
    a, b, c = pairs_of(spark, rows, [0])
    assert [x["size_time_pair"] for x in (a, b, c)] == [False, True, False]
    assert (b["matched_gap_high"], b["matched_mid"], b["cross_matched"]) == (10, 100, "Some")
    assert (a["size_state"], c["size_state"]) == ("Unknown / mixed", "Positive unmatched")


def test_async_and_overnight(spark):
    rows, minutes = [(0, "A", "bid", 2, 1), (3, "A", "ask", 1, 1)], [-1, 0, 3, 31, 34, 1440]
    p = pairs_of(spark, rows, minutes)
    assert len(p) == 4 and [x["fresh_pair"] for x in p] == [False, True, False, False]
    assert not any(x["both"] for x in pairs_of(spark, rows, [3], exact=False))


def test_latest_incomplete_blocks(spark):
    p = pairs_of(spark, [(0, "A", "bid", 105, 1), (0, "A", "ask", 100, 1), (1, "A", "bid", None, 1)], [2])[0]
    assert p["both"] and not p["complete"] and p["cross"] == "Unassessed"


def test_side_features_against_plain_python(spark):
    r = random.Random(3)
    rows = [(m, f"D{d}", "bid", 100 + r.gauss(0, 8) + (60 if d == 5 else 0), r.choice((0, 1, None))) for d in range(6) for m in r.sample(range(50), 4)]
    got = rows_of(side.side_features(side.slots(events_of(spark, rows), queries(spark, [20, 50]))), "ns")
    for g, minute in zip(got, (20, 50), strict=True):
        latest = {}
        for m, f, _, v, _q in sorted(rows):
            if m <= minute:
                latest[f] = (m, v)
        fresh = {f: v for f, (m, v) in latest.items() if minute - m <= 30}
        least = min(minute - m for m, _ in latest.values())
        weights = {f: 2.0 ** (-(minute - m - least) / 30) for f, (m, _) in latest.items()}
        clipped, supported = [], 0
        for f, (_, v) in latest.items():
            others = [x for k, x in fresh.items() if k != f]
            if len(others) < 3:
                clipped.append(v)
                continue
            supported += 1
            ref = median(others)
            radius = max(10, 4 * 1.4826 * median(abs(x - ref) for x in others))
            clipped.append(min(max(v, ref - radius), ref + radius))
        assert g["n_dealers"] == len(latest) and g["n_fresh_dealers"] == len(fresh) and g["n_peer_supported"] == supported
        assert g["center_decay"] == pytest.approx(sum(v * weights[f] for f, (_, v) in latest.items()) / sum(weights.values()))
        assert g["center_candidate_clip"] == pytest.approx(sum(clipped) / len(clipped))


def test_features_keep_unsupported_values_null(spark):
    f = features.point_features(events_of(spark, [(0, "A", "bid", None, 1)]), queries(spark, [-5, 1]))
    a, b = rows_of(f, "ns")
    assert a["bcq_bid_n_dealers"] == 0 and a["bcq_bid_center_equal"] is None and a["bcq_is_quoted"] == 0
    assert b["bcq_bid_n_incomplete"] == 1 and b["bcq_is_quoted"] == 0 and len(f.columns) == 62 + 4


def test_queries_are_checked(spark):
    with pytest.raises(ValueError):
        features.check_queries(queries(spark, [0]).union(queries(spark, [1])))


def test_movement_common_dealer_and_condition(spark):
    rows = [(0, "A", "bid", 100, 2), (30, "A", "bid", 104, 2), (-5, "B", "bid", 50, 2), (30, "C", "bid", 70, 2)]
    m = movement.direction(movement.endpoint_states(events_of(spark, rows), queries(spark, [30]))).first()
    assert (m["mean_bps"], m["common_n"], m["current_n"], m["lookback_n"], m["retention"]) == (4, 1, 2, 2, 0.5)
    rows = [(0, "A", "bid", 100, 2), (30, "A", "bid", 104, 3)]
    m = movement.direction(movement.endpoint_states(events_of(spark, rows), queries(spark, [30]))).first()
    assert m["mean_bps"] == 4 and m["guarded_mean_bps"] is None and m["condition_changed_fraction"] == 1


def test_movement_age_boundary(spark):
    e = events_of(spark, [(0, "A", "bid", 100, 2)])
    q = queries(spark, [30])
    assert movement.endpoint_states(e, q).count() == 1
    from pyspark.sql import functions as F

    assert movement.endpoint_states(e, q.withColumn("ns", F.col("ns") + 1)).filter("now is not null").count() == 0


def test_issuer_mapping_has_no_backfill(spark):
    t = spark.createDataFrame([("A", at(0), None), ("A", at(1), "I"), ("A", at(2), "I"), ("A", at(3), "J"), ("B", at(0), "Unknown"), ("C", at(0), "K"), ("C", at(0), "L")], "cusip string, ns bigint, issuer string")
    assert [(r["cusip"], r["issuer"], r["first_ns"], r["conflict_ns"]) for r in movement.issuer_records(t).collect()] == [("A", "I", at(1), at(3))]
