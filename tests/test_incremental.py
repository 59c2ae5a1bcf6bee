"""Incremental validation on a small experiment: 40 Train, 10 Validation and 10 Test rows."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from dealerlens.plans import incremental as I
from dealerlens.plans import store
from dealerlens.plans.experiment import BASE_CATEGORIES, BASE_FEATURES, RELIABILITY

VERSIONS = ["Base", "Age decay"]


def experiment_frame(spark, rows):
    """Rows with the base columns and those of the version "Age decay"."""
    x = spark.createDataFrame(rows, "row_id bigint, cusip string, ns bigint, day date, split string, bm_spread double, prev_bm_spread double").withColumn("refit", F.col("split") == "Train")
    base = {c: F.lit("B") if c in BASE_CATEGORIES else F.col("row_id") % 5 / 2 for c in BASE_FEATURES if c != "prev_bm_spread"}
    quote = {f"bcq_{s}_{c}": F.col("row_id") % 3 + 0.5 for s in ("bid", "ask") for c in ("center_decay", "n_dealers", *RELIABILITY)}
    return x.withColumns(base | quote | {"bcq_is_quoted": F.lit(1.0)})


@pytest.fixture(scope="module")
def case(spark):
    rows = [(i, "X" if i % 2 else "Y", i * 10**9, date(2026, 3, 1) + timedelta(i // 5), "Train" if i < 40 else "Validation" if i < 50 else "Test", 0.6 + i % 7 / 100, 0.6) for i in range(60)]
    frame = experiment_frame(spark, rows)
    settings = I.experiment_settings(trees=2, depth=2, event_key="events-1", versions=VERSIONS)
    values = [F.lit(1.0 if c.endswith("mean_bps") else 2.0).alias(c) for c in I.block_columns("Direction")]
    sidecar = I.allowed_rows(frame).select(*I.KEY, *values)
    cohort = frame.filter("split = 'Validation'")
    one = lambda m: cohort.select("row_id", "ns", F.lit(m).alias("model"), F.col("prev_bm_spread").alias("pred"), ((F.col("prev_bm_spread") - F.col("bm_spread")) * 100).alias("error_bps"))
    return frame, settings, sidecar, I.movement_config(settings, include_issuer=False), one("Base").unionByName(one("Age decay"))


def test_identity_and_locks(spark):
    good = I.experiment_settings(trees=2, depth=2, event_key="e")
    assert "locked_choice" not in I.identity(good)
    I.check_unlocked(good)
    for change in ({"anchor": "x"}, {"error_multiplier": 1}, {"budget": {"trees": 2}}, {"budget": {**good["budget"], "trees": 0}}, {"origin": "after"}, {"model_columns": {}}):
        with pytest.raises(ValueError):
            I.identity(good | change)
    for change in ({"locked_choice": "Base"}, {"test_available": True}, {"saved_lock_guard": True}, {"test_exposed": True}):
        with pytest.raises(ValueError):
            I.check_unlocked(good | change)
    with pytest.raises(ValueError):
        I.check_unlocked({k: v for k, v in good.items() if k != "test_available"})


def test_guard_of_a_saved_experiment(spark, tmp_path):
    root = f"file://{tmp_path}/saved"
    assert not I.restored_guard(spark, root).get("saved_lock_guard")
    store.publish(spark, root, {"locked_choice": None, "test_available": False})
    assert not I.restored_guard(spark, root)["saved_lock_guard"]
    store.publish(spark, root, {"locked_choice": "Age decay", "test_available": False})
    assert I.restored_guard(spark, root)["locked_choice"] == "Age decay" and I.restored_guard(spark, root)["saved_lock_guard"]
    store.publish(spark, root, {"other": 1})
    assert I.restored_guard(spark, root)["saved_lock_guard"]


def test_context(case):
    frame, settings, *_ = case
    assert I.same_context(frame, frame.repartition(3), settings, settings | {"locked_choice": "Base"})
    assert not I.same_context(frame, frame.withColumn("coupon", F.when(F.col("row_id") == 7, 6.0).otherwise(F.col("coupon"))), settings, settings)
    assert not I.same_context(frame, frame, settings, settings | {"age_min": 31.0})


def test_source_key(case):
    frame, *_ = case
    later = frame.withColumn("bm_spread", F.when(F.col("split") == "Test", 9.0).otherwise(F.col("bm_spread")))
    assert I.source_key(frame) == I.source_key(later.repartition(2)) != I.source_key(frame.filter("row_id <> 3"))
    for odd in (frame.unionByName(frame.filter("row_id = 55")), frame.filter("split = 'Test'"), frame.withColumn("row_id", F.when(F.col("row_id") != 3, F.col("row_id")))):
        with pytest.raises(ValueError):
            I.source_key(odd)


def test_sidecar_is_checked_saved_and_found(spark, case, tmp_path):
    frame, settings, sidecar, config, _ = case
    root = f"file://{tmp_path}"
    with pytest.raises(FileNotFoundError):
        I.load_sidecar(spark, root, frame, settings)
    value = I.block_columns("Direction")[0]
    wrong = [
        sidecar.filter("row_id <> 3"), sidecar.unionByName(sidecar.filter("row_id = 3")), sidecar.withColumn("ns", F.col("ns") + 1), sidecar.drop(value), sidecar.withColumn("more", F.lit(1)),
        sidecar.withColumn(value, F.lit(float("inf"))), sidecar.withColumn(value, F.lit("x")),
    ]
    for x in wrong:
        with pytest.raises(ValueError):
            I.save_sidecar(spark, root, frame, x, config, settings)
    with pytest.raises(ValueError):
        I.save_sidecar(spark, root, frame, sidecar, config | {"lookback_min": 20}, settings)
    first = I.save_sidecar(spark, root, frame, sidecar, config, settings)
    second = I.save_sidecar(spark, root, frame, sidecar.withColumn(value, F.lit(None).cast("double")), config, settings)
    got, bound = I.load_sidecar(spark, root, frame, settings)
    assert first != second and got.filter(F.col(value).isNotNull()).count() == 0 and bound["config"] == config
    with pytest.raises(FileNotFoundError):  # another budget is another experiment
        I.load_sidecar(spark, root, frame, I.experiment_settings(trees=3, depth=2, event_key="events-1", versions=VERSIONS))
    place = next(p for p in tmp_path.glob("sidecars/*") if (p / second).exists())
    sidecar.write.mode("overwrite").parquet(f"file://{place}/{second}/movement")
    with pytest.raises(ValueError):
        I.load_sidecar(spark, root, frame, settings)


def test_a_block_is_fitted_once(spark, case, tmp_path):
    frame, settings, sidecar, config, predictions = case
    root, told = f"file://{tmp_path}", []
    run = lambda **o: I.validate_block(spark, root, *(o.get(k, v) for k, v in zip(("frame", "sidecar", "config", "predictions", "settings", "block"), (frame, sidecar, config, predictions, settings, "Direction"), strict=True)), progress=lambda *a: told.append(a))
    empty = sidecar.withColumns({c: F.lit(None).cast("double") for c in I.block_columns("Direction") if c.endswith("mean_bps")})
    refused = [
        {"block": "Test"}, {"block": "Issuer"}, {"settings": settings | {"locked_choice": "Base"}}, {"sidecar": empty}, {"predictions": predictions.filter("row_id <> 45")},
        {"predictions": predictions.filter("model = 'Base'")}, {"frame": frame.withColumn("bm_spread", F.when(F.col("row_id") != 3, F.col("bm_spread")))},
    ]
    for x in refused:
        with pytest.raises(ValueError):
            run(**x)
    out, info = run()
    assert sorted(r["row_id"] for r in out.collect()) == list(range(40, 50)) and not info["reused"]
    assert {(r["model"], r["stage"], r["train_n"]) for r in out.collect()} == {("Age decay + Direction", "Validation", 40)}
    assert info["support"] == {"Train": 40, "Validation": 10} and info["warnings"] == []
    again, info = run()
    assert info["reused"] and sorted(again.collect()) == sorted(out.collect())
    assert [a[:3] for a in told] == [("models", 0, 1), ("models", 1, 1), ("models", 1, 1)]
    with pytest.raises(ValueError):  # altered predictions do not buy another fit
        run(predictions=predictions.withColumn("error_bps", F.col("error_bps") + 1e-9))
