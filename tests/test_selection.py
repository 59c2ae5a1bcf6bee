"""Local times, selection, trade cases and PCA against plain versions."""

import datetime as dt
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealerlens.operators import clean, population, selection
from dealerlens.sources import ingest


def test_local_times_that_are_skipped_or_twice(spark):
    texts = ["2026-03-08 01:59:59", "2026-03-08 02:30:00", "2026-03-08 03:00:00", "2026-11-01 00:59:59", "2026-11-01 01:00:00", "2026-11-01 01:30:00", "2026-11-01 02:00:00", "2026-07-01 12:00:00", "never", None]
    zone, want = ZoneInfo("America/New_York"), []
    for t in texts:
        try:
            local = dt.datetime.fromisoformat(t)
        except (TypeError, ValueError):
            want.append(None)
            continue
        instants = {local.replace(tzinfo=zone, fold=f).astimezone(dt.UTC) for f in (0, 1)}
        real = [x for x in instants if x.astimezone(zone).replace(tzinfo=None) == local]
        want.append(local if len(real) == 1 else None)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.select("i", ingest.local_to_et(F.col("t")).alias("x")).orderBy("i").select("x").collect()] == want
    assert want.count(None) == 5
    for bad in ("2026-03-08 02:30:00", "2026-11-01 01:30:00"):
        with pytest.raises(Exception, match="no single instant"):
            df.filter(F.col("t") == bad).select(ingest.local_to_et(F.col("t"), strict=True)).collect()
    assert df.filter("t = 'never'").select(ingest.local_to_et(F.col("t"), strict=True)).first()[0] is None


@pytest.mark.parametrize("n,most", [(1, 5), (5, 5), (6, 5), (100, 7), (1000, 300), (301, 300)])
def test_evenly_spaced(spark, n, most):
    got = [r[0] for r in selection.evenly_spaced(spark.range(n).withColumn("g", F.lit(1)), ["id"], most, ["g"]).orderBy("id").select("id").collect()]
    assert got == (list(range(n)) if n <= most else sorted({int(i * (n - 1) / (most - 1)) for i in range(most)}))


def test_metadata_and_universe(spark):
    make = lambda rows: spark.createDataFrame(rows, "cusip string, issuer string, tenor string")
    got = ingest.combined_metadata(make([(" A ", "t", "1"), ("B", "t", "2"), ("C", None, "3")]), make([("A", "q", None), (None, "q", "1")]), make([("B", " m ", "x")]).withColumn("tenor", F.lit(None)))
    assert sorted(map(tuple, got.collect())) == [("A", "q", None), ("B", "m", None)]
    t = spark.createDataFrame([("A", 1), ("A", 5), ("B", 9), (None, 5), ("C", None)], "cusip string, ns long")
    assert sorted(map(tuple, ingest.trade_universe(t, 1, 5).collect())) == [("A", 1), ("A", 5)]
    assert ingest.trade_universe(t, end=4).count() == 1


def test_trade_cases_are_those_of_a_pick_over_all_rows(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(300):
        quoted = float(r.choice([0, 0.5, 1]))
        rows.append((f"c{i}", ["bid", "ask"][i % 2], "2026-03-02", f"I{int(r.integers(3)) if i % 10 else i}", ["Energy", "Bank"][i % 2], ["Sparse", "Active"][i % 3 % 2], f"c{i}", f"{int(r.integers(10**9)):09d}", int(r.integers(1, 50)), quoted,
                     float(r.choice([0, 0.2])), float(r.random()), None if i % 7 == 0 else float(r.integers(4)), None if i % 11 == 0 else float(r.choice([0, 0.5]))))
    df = spark.createDataFrame(rows, "cusip string, side string, day string, issuer string, sector string, activity string, case_id string, hash string, trade_queries int, quoted_fraction double, unknown_quantity_fraction double, typical double, max_center_effect_bps double, coverage_loss_fraction double")
    got = [(x.selection, x.case_id, x.issuer_cap_relaxed) for x in selection.trade_case_manifest(df, 4).orderBy("case_number").collect()]
    plain = [x.asDict() | {"firm": None, "impact": None} for x in df.collect()]
    high = [x for x in plain if selection._SHIFTED[1](x)]

    def rank(rows, c):
        have = sorted(x[c] for x in rows if x[c] is not None)
        return {x["case_id"]: (have.index(x[c]) + 1 + (have.count(x[c]) - 1) / 2) / len(have) for x in rows if x[c] is not None}

    a, b = rank(high, "max_center_effect_bps"), rank(high, "coverage_loss_fraction")
    for x in plain:
        if x["case_id"] in a and x["case_id"] in b:
            x["impact"] = a[x["case_id"]] + b[x["case_id"]]
    want = population.picked_cases(plain, 4, needs=selection._NEEDS, shifted=selection._SHIFTED, caps=("issuer",), relax_needs=False)
    counts = [x["issuer"] for _, _, x in want]
    assert got == [(k, x["case_id"], counts.count(x["issuer"]) > 2) for k, _, x in want] and len(got) == 12


def test_pca_equals_numpy(spark):
    r = np.random.default_rng(8)
    common = r.normal(size=60)
    wide = {f"B{j}": common * (j + 1) + r.normal(size=60) for j in range(4)}
    rows = [(t, b, "bid", float(v[t])) for b, v in wide.items() for t in range(60) if not (b == "B3" and t < 5)]
    got = {x.bond: (x.loading, x.variance_share) for x in clean.pca(spark.createDataFrame(rows, "ns long, cusip string, side string, delta double")).collect()}
    m = np.stack([v[5:] for v in wide.values()], 1)
    z = (m - m.mean(0)) / m.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    first = vt[0] * np.sign(vt[0].sum())
    for b, v in zip(wide, first, strict=True):
        assert got[b] == pytest.approx((v, s[0] ** 2 / (s**2).sum()))
