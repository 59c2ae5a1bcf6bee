"""Fits of several versions on one prepared table."""

import __spark_entry__ as entry
from dealerlens.operators import features
from dealerlens.plans import experiment, queries
from dealerlens.sources.ingest import base_trades_view


def test_model_fit_spends_one_task_a_pass_on_few_rows(spark, sf_dir):
    spark.sparkContext.setJobGroup("model_fit", "")
    try:
        rows = entry.queries()["model_fit"](spark, sf_dir).collect()
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(key, None)
    assert {r["model"] for r in rows} == set(experiment.VERSIONS) and len({r["n"] for r in rows}) == 1
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("model_fit") for s in tracker.getJobInfo(j).stageIds]
    passes = [s.numTasks for s in stages if s and "mapPartitions at RandomForest" in s.name]
    assert passes and set(passes) == {1}


def test_shared_rows_give_the_predictions_of_single_fits(spark, sf_dir):
    t = experiment.with_split(base_trades_view(spark, sf_dir))
    frame = features.point_features(queries.history(spark, sf_dir), t).cache()
    versions = ["Base", "Max age"]
    shared = experiment.compare(experiment.model_rows(frame, versions), versions, trees=2, depth=2)
    got = {(r["model"], r["row_id"]): r["pred"] for r in shared.collect()}
    want = {(r["model"], r["row_id"]): r["pred"] for v in versions for r in experiment.fit_predict(frame, v, trees=2, depth=2).collect()}
    frame.unpersist()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
