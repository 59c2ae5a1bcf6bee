import pytest

from dealerlens.operators import events as E

from .helpers import at, day, queries, quotes, rows_of


def history(spark, rows):
    return rows_of(E.prepare_events(quotes(spark, rows)), "firm", "side", "ns")


def test_candidate_set_and_repeats(spark):
    e = history(spark, [(0, "A", "bid", v, 2) for v in (-1, 0, 100, 100)])[0]
    assert e["spread_set"] == [-1.0, 0.0, 100.0] and e["center"] == 0.0 and e["repeats"] == 1 and e["rows"] == 4 and e["gap"] == 101.0


def test_aba_and_guard(spark):
    e = history(spark, [(0, "A", "bid", 10, 2), (1, "A", "bid", 20, 2), (2, "A", "bid", 10, 2), (3, "A", "bid", 12, 5)])
    assert [x["observed_aba"] for x in e] == [False, False, True, False]
    assert e[1]["guarded_delta"] == 10.0 and e[3]["guarded_delta"] is None and e[3]["center_delta"] == 2.0


def test_change_age(spark):
    e = history(spark, [(m, "A", "bid", v, 2) for m, v in ((0, 10), (10, 10), (20, 12), (30, 12), (120, 13), (121, 14), (1440, 14))])
    assert [x["change_age_min"] for x in e] == [None, None, 0.0, 10.0, None, 0.0, None]


def test_thirty_minute_count(spark):
    e = history(spark, [(m, "A", "bid", 100 + i, 2) for i, m in enumerate((0, 5, 35, 65, 125, 186))])
    assert [x["changes_30m"] for x in e] == [0, 1, 1, 1, 1, 0]
    assert [x["history_break"] for x in e] == [True, False, False, False, False, True]


def test_incomplete_event_breaks_history(spark):
    e = history(spark, [(0, "A", "bid", 1, 2), (1, "A", "bid", None, 2), (2, "A", "bid", 1, 2)])
    assert [x["complete"] for x in e] == [True, False, True] and all(x["history_break"] for x in e)


def test_quantity_kinds_of_text(spark):
    values = ["1", "2", "0", "-0.0", None, "-1", "inf", "bad", "", "4", " 4 "]
    q = spark.createDataFrame([("X", "A", "bid", at(0), day(0), 1.0, v) for v in values], "cusip string, firm string, side string, ns bigint, day date, spread double, quantity string")
    got = {r["qkind"]: r["rows"] for r in E.quantity_kinds(q).collect()}
    assert got == {"Positive": 4, "Zero": 2, "Missing": 1, "Other": 4}


def test_large_sizes_collapse_as_doubles(spark):
    e = E.annotated_events(E.dealer_events(quotes(spark, [(0, "A", "bid", 1, 2**54), (0, "A", "bid", 2, 2**54 + 1)]))).first()
    assert e["same_positive_multi"] and e["n_quantity"] == 1


def test_unkeyed_rows_do_not_make_events(spark):
    q = quotes(spark, [(0, "A", "bid", 1, 2), (0, " ", "bid", 1, 2), (0, None, "bid", 1, 2)])
    assert E.dealer_events(q).count() == 1 and E.unkeyed_count(q).first()["unkeyed_rows"] == 2


def test_extra_columns_count_for_repeats(spark):
    from pyspark.sql import functions as F

    q = quotes(spark, [(0, "A", "bid", 1, 2), (0, "A", "bid", 1, 2)])
    assert E.dealer_events(q).first()["repeats"] == 1
    assert E.dealer_events(q.withColumn("source", F.monotonically_increasing_id())).first()["repeats"] == 0


def test_future_rows_change_nothing_before(spark):
    rows = [(m, "A", "bid", m % 3, 2) for m in range(0, 60, 7)]
    before = history(spark, rows)
    after = history(spark, [*rows, (61, "A", "bid", 9, 2), (62, "A", "bid", None, 3)])
    assert after[: len(before)] == before


def test_empty(spark):
    assert E.prepare_events(quotes(spark, [])).count() == 0


@pytest.mark.parametrize("strict", [False, True])
def test_asof_takes_latest_first(spark, strict):
    from dealerlens.operators.asof import asof

    e = E.dealer_events(quotes(spark, [(0, "A", "bid", 105, 1), (1, "A", "bid", None, 1), (5, "A", "bid", 7, 1)]))
    got = rows_of(asof(e, queries(spark, [0, 2, 5]), ["complete", "center"], exact=not strict), "ns")
    assert [(r["complete"], r["age_min"]) for r in got] == ([(False, 1.0), (False, 4.0)] if strict else [(True, 0.0), (False, 1.0), (True, 0.0)])
