import pytest

from dealerlens.operators import clean, population
from dealerlens.operators import events as E
from dealerlens.plans import experiment, store
from dealerlens.sources import demo, ingest

from .helpers import at, day, queries, quotes, rows_of


def reasons(spark, rows, minutes):
    from pyspark.sql import functions as F

    grid = queries(spark, minutes).select("ns")
    s = clean.clean_states(clean.grid_states(clean.replay(quotes(spark, rows)), grid))
    return {(r["firm"], r["side"]): r["reason"] for r in s.filter(F.col("ns") == at(minutes[-1])).collect()}


def test_conflict_zero_cross_and_outlier(spark):
    steady = [(0, f, "bid", 50, 1) for f in ("B", "C", "D", "E")] + [(0, f, "ask", 40, 1) for f in ("B", "C", "D", "E")]
    assert reasons(spark, [*steady, (0, "A", "bid", 50, 1), (0, "A", "bid", 60, 2)], [5])["A", "bid"] == "timestamp conflict"
    got = reasons(spark, [*steady, (0, "A", "bid", 0, 1), (0, "A", "ask", 40, 1)], [5])
    assert got["A", "bid"] == "contextual zero" and got["A", "ask"] == "kept"
    assert reasons(spark, [*steady, (0, "A", "bid", 30, 1), (0, "A", "ask", 40, 1)], [5])["A", "ask"] == "crossed dealer pair"
    assert reasons(spark, [*steady, (0, "A", "bid", 100, 1)], [5])["A", "bid"] == "peer outlier"
    assert reasons(spark, steady, [5, 35])["B", "bid"] == "expired"
    assert reasons(spark, [(0, "A", "bid", None, 1)], [5])["A", "bid"] == "nonfinite"


def test_batches_and_sequences(spark):
    from pyspark.sql import functions as F

    q = quotes(spark, [(0, "A", "bid", 10, 1), (0, "A", "bid", 11, 2), (0, "A", "bid", 11, 2)])
    r = clean.replay(q).first()
    assert r["spread"] == 10.5 and r["quantity"] is None and not r["tie_conflict"]
    r = clean.replay(q.withColumn("seq", F.when(F.col("spread") == 11, 2).otherwise(1)), "seq").first()
    assert r["spread"] == 11 and r["quantity"] == 2


def test_sector_resolution(spark):
    t = spark.createDataFrame([("A", "I", "Energy"), ("A", "I", None), ("B", "I", "Bank"), ("B", "I", "Financial"), ("C", "I", None), (" D", "I", "Utility"), ("D", "I", "Utility")], "cusip string, issuer string, sector string")
    assert {r["cusip"]: r["sector"] for r in population.bond_universe(t).collect()} == {"A": "Energy", "B": "Conflicting", "C": "Unknown", "D": "Utility"}


def test_split(spark):
    from datetime import date, timedelta

    days = [date(2026, 1, 1) + timedelta(days=i) for i in range(35)]
    t = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "row_id bigint, day date")
    got = {r["split"]: r["count"] for r in experiment.chronological_split(t).groupBy("split").count().collect()}
    assert got == {"Train": 23, "Embargo": 2, "Validation": 5, "Test": 5}
    with pytest.raises(ValueError):
        experiment.chronological_split(t.limit(20))


def test_content_key_ignores_order_but_not_repeats(spark):
    a = quotes(spark, [(0, "A", "bid", 1, 2), (1, "A", "bid", None, 2)])
    b = quotes(spark, [(1, "A", "bid", None, 2), (0, "A", "bid", 1, 2)])
    assert store.digest(a) == store.digest(b) != store.digest(a.union(a))


def test_snapshot_cache_and_ledger(spark, tmp_path):
    root = f"file://{tmp_path}"
    q = quotes(spark, [(0, "A", "bid", 1, 2)])
    name = store.save_snapshot(spark, root, {"quotes": q})
    assert store.load_table(spark, root, name, "quotes").count() == 1
    with pytest.raises(ValueError):
        store.load_table(spark, root, "../x", "quotes")
    q.union(q).write.mode("overwrite").parquet(f"{root}/{name}/quotes")
    with pytest.raises(ValueError):
        store.load_table(spark, root, name, "quotes")
    built = []
    build = lambda d: built.append(1) or E.dealer_events(d)
    for _ in range(2):
        assert store.cached(spark, root, q, build).count() == 1
    assert len(built) == 1
    ledger = store.Ledger(spark, f"{root}/ledger")
    assert ledger.run({"block": 1}, lambda: q).count() == ledger.run({"block": 1}, lambda: 1 / 0).count() == 1
    with pytest.raises(ZeroDivisionError):
        ledger.run({"block": 2}, lambda: 1 / 0)
    with pytest.raises(RuntimeError):
        ledger.run({"block": 2}, lambda: q)


def test_zones(spark):
    df = spark.createDataFrame([("2026-03-02 15:00:00", "2026-03-08 02:30:00"), ("bad", "2026-03-02 10:00:00")], "utc string, local string")
    got = df.select(ingest.utc_text_to_et(df.utc).cast("string").alias("u"), ingest.local_to_et(df.local).cast("string").alias("l")).collect()
    assert [tuple(r) for r in got] == [("2026-03-02 10:00:00", None), (None, "2026-03-02 10:00:00")]


def test_demo_is_seeded_and_usable(spark):
    q, t, meta = demo.make_demo(spark)
    assert meta.count() == 16 and t.count() == 160
    e = E.prepare_events(ingest.with_clock(q, "message_time"))
    assert e.count() > 1000 and e.filter("repeats > 0").count() > 0


def test_cases_are_deterministic(spark):
    rows = [(m, f, s, 50 + m % 7 + i, 1) for i, f in enumerate(("A", "B", "C", "D")) for s in ("bid", "ask") for m in range(0, 60, 9)]
    e = E.prepare_events(quotes(spark, rows))
    u = spark.createDataFrame([("X", "I", "S")], "cusip string, issuer string, sector string")
    make = lambda d: rows_of(population.case_manifest(population.scored_cases(population.case_candidates(d, u), population.rule_impacts(d)), 2), "kind", "place")
    assert make(e) == make(e.repartition(3)) and len({r["case_id"] for r in make(e)}) == len(make(e))


def test_cases_equal_the_pick_from_all_rows(spark):
    import random

    r = random.Random(3)
    rows = []
    for i in range(2500):  # a hot dealer and a hot issuer stand first in every order
        hot = i % 25 > 0
        firm, issuer = (("HOT", f"I{r.randrange(40)}") if i % 2 else (f"D{r.randrange(40)}", "HOT")) if hot else (f"D{r.randrange(40)}", f"I{r.randrange(40)}")
        rows.append((f"c{i}", firm, f"b{i}", "bid", "2026-03-02", issuer, "S", "4-30", 9, i == 2450, float(i == 2475), f"{0 if hot else 1}{r.randrange(10**9):09d}{i}", 0.0 if hot else 1.0, 2.0 if hot else 1.0, 1.0, 0.0))
    names = "case_id firm cusip side day issuer sector activity events one_sided_day unknown_rate hash typical impact max_center_effect_bps coverage_loss_fraction".split()
    want = [(k, i, x["case_id"]) for k, i, x in population.picked_cases([dict(zip(names, row, strict=True)) for row in rows], 3)]
    got = population.case_manifest(spark.createDataFrame(rows, names), 3).collect()
    assert [(x["kind"], x["place"], x["case_id"]) for x in got] == want
    assert {"c2450", "c2475"} <= {x["case_id"] for x in got}


def test_stream_of_events_matches_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from dealerlens.streaming.events import read_quotes, stream_events

    q = quotes(spark, [(0, "A", "bid", 1, 2), (0, "A", "bid", 3, 2), (200, "A", "bid", 5, 2)]).withColumn("event_time", F.timestamp_micros((F.col("ns") / 1000).cast("bigint")))
    q.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = stream_events(read_quotes(spark, f"{tmp_path}/in", q.schema)).writeStream.format("memory").queryName("streamed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    s.awaitTermination()
    assert [r["spread_set"] for r in spark.table("streamed").collect()][:1] == [[1.0, 3.0]]
    assert day(0) is not None
