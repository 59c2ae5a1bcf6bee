"""Incremental validation: one block of movement columns beside a finished experiment, fitted at most once.

An experiment's settings are a dict that was made before its fit (``experiment_settings``).  Its Train and
Validation rows are bound by their content, Test rows never are: their values decide nothing here.
What is saved (the sidecar of movement columns, a block's predictions) is found again by that
content and the settings, and is checked anew on every read.  Rows are counted and compared by Spark; the driver
holds digests, counts and the settings.

``progress(stage, done, total, detail)`` is called, if given, as a block goes on.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AGE_MIN, LOOKBACK_MIN, SYNC_MIN
from ..operators.diagnostics import prediction_problems
from ..operators.movement import ISSUER_COUNTS, ISSUER_VALUES, MOVE_COUNTS, MOVE_VALUES
from . import store
from .experiment import BASE_FEATURES, VERSIONS, check_comparison, fit_predict, version_columns

# The prediction task that may not change, what a budget names, and the origins of settings.
TASK = {"target": "d_bm_spread", "anchor": "prev_bm_spread", "error_multiplier": 100, "base_features": BASE_FEATURES}
BUDGET = ("loss", "trees", "depth", "seed")
BEFORE_FIT = "captured_before_fitting"
REFERENCE = "Age decay"
BLOCKS = {"Direction": "Age decay + Direction", "Issuer": "Age decay + Issuer"}
LEAST_SUPPORT = 0.01
KEY = ["row_id", "cusip", "ns"]

#: What tells one experiment from another; the state of its locks does not.
STATE = ("locked_choice", "test_available", "saved_lock_guard", "test_exposed")

Progress = Callable[[str, int, int, str], None]


def experiment_settings(*, trees: int, depth: int, event_key: str, seed: int = 2026, age_min: float = AGE_MIN, sync_min: float = SYNC_MIN, exact: bool = True, versions: list[str] | None = None) -> dict:
    """The settings of an experiment about to be fitted; needs a running session."""
    return {
        **TASK, "budget": {"loss": "absolute", "trees": trees, "depth": depth, "seed": seed}, "age_min": age_min, "sync_min": sync_min, "exact": exact, "event_key": event_key,
        "versions": versions or VERSIONS, "model_columns": {v: list(version_columns(v)) for v in versions or VERSIONS}, "origin": BEFORE_FIT, "locked_choice": None, "test_available": False,
    }


def identity(settings: dict) -> dict:
    """The settings without their locks; raises ValueError unless they are of the fixed task, with a whole
    budget that was recorded before the fit."""
    changed = [k for k, v in TASK.items() if settings.get(k) != v]
    if changed:
        raise ValueError(f"another task: {changed}")
    budget = settings.get("budget") or {}
    if set(BUDGET) - set(budget) or budget["loss"] != "absolute" or not isinstance(budget["trees"], int) or budget["trees"] < 1:
        raise ValueError("the budget of the fit is not known")
    if settings.get("origin") != BEFORE_FIT:
        raise ValueError("settings that were not recorded before the fit prove nothing about it")
    if REFERENCE not in (settings.get("model_columns") or {}):
        raise ValueError(f"the columns of {REFERENCE!r} are not known")
    return {k: v for k, v in settings.items() if k not in STATE}


def check_unlocked(settings: dict) -> None:
    """Raises ValueError once a choice is locked, or the test was or may have been seen."""
    if "locked_choice" not in settings or "test_available" not in settings:
        raise ValueError("it is not known whether a choice is locked or the test was seen")
    if settings["locked_choice"] is not None or any(settings.get(k) for k in STATE[1:]):
        raise ValueError("a choice is locked or the test was seen: no further fit")


def restored_guard(spark: SparkSession, root: str) -> dict:
    """The locks of the experiment last saved under ``root``; a save that cannot be read counts as
    seen, for it does not show that the test stayed closed."""
    if not store.exists(spark, root):
        return {"locked_choice": None, "test_available": False}
    try:
        saved = store.latest(spark, root)
        return {"locked_choice": saved["locked_choice"], "test_available": saved["test_available"], "saved_lock_guard": saved["locked_choice"] is not None or bool(saved["test_available"])}
    except (FileNotFoundError, KeyError, ValueError):
        return {"locked_choice": None, "test_available": False, "saved_lock_guard": True}


def same_context(saved: DataFrame, now: DataFrame, saved_settings: dict, settings: dict) -> bool:
    """Whether a saved experiment is that of today's frame (keys, targets, split and base columns of all
    rows, in any order) and settings."""
    columns = [*dict.fromkeys([*KEY, "bm_spread", "prev_bm_spread", "split", "refit", *BASE_FEATURES])]
    strip = lambda s: {k: v for k, v in s.items() if k not in STATE}
    return strip(saved_settings) == strip(settings) and store.digest(saved.select(*columns)) == store.digest(now.select(*columns))


def allowed_rows(frame: DataFrame) -> DataFrame:
    return frame.filter(F.col("split").isin("Train", "Validation"))


def source_key(frame: DataFrame) -> str:
    """The content of the Train and Validation rows; raises ValueError if the frame repeats an id, or such a row
    has none, or there is none."""
    ids = frame.groupBy("row_id").agg(F.count("*").alias("n"), F.count_if(F.col("split").isin("Train", "Validation")).alias("used"))
    r = ids.agg(F.max("n").alias("most"), F.sum("used").alias("used"), F.sum(F.when(F.col("row_id").isNull(), F.col("used"))).alias("nameless")).first()
    if not r["used"] or r["most"] > 1 or r["nameless"]:
        raise ValueError("Train and Validation rows need a unique row_id each")
    return store.digest(allowed_rows(frame))


def block_columns(block: str) -> list[str]:
    infix, names = ("move", MOVE_VALUES + MOVE_COUNTS) if block == "Direction" else ("issuer_move", ISSUER_VALUES + ISSUER_COUNTS)
    return [f"bcq_{side}_{infix}_{c}" for side in ("bid", "ask") for c in names]


def movement_config(settings: dict, *, include_issuer: bool = True) -> dict:
    return {"lookback_min": LOOKBACK_MIN, "same_day": True, "age_min": settings["age_min"], "exact": settings["exact"], "include_issuer": include_issuer, "event_key": settings["event_key"]}


def check_sidecar(frame: DataFrame, sidecar: DataFrame, config: dict, settings: dict) -> dict:
    """What binds a sidecar to its experiment; raises ValueError unless it was built by the
    experiment's rules from its events and holds just the Train and Validation rows, each with numbers or nulls."""
    known = identity(settings)
    if config != movement_config(settings, include_issuer=bool(config.get("include_issuer"))) or not config["event_key"]:
        raise ValueError("the sidecar was built by other rules or from other events")
    values = block_columns("Direction") + (block_columns("Issuer") if config["include_issuer"] else [])
    if sorted(sidecar.columns) != sorted(KEY + values):
        raise ValueError("the sidecar's columns are not those of its blocks")
    source = source_key(frame)
    types = dict(sidecar.dtypes)
    texts = [c for c in values if types[c] not in ("double", "float", "bigint", "int")]
    if texts:
        raise ValueError(f"not numbers: {texts}")
    endless = F.lit(False)
    for c in values:
        endless = endless | F.coalesce(F.abs(F.col(c).cast("double")) == float("inf"), F.lit(False))
    mine = sidecar.select(*KEY, F.lit(1).alias("_side"), F.lit(0).alias("_frame"), endless.alias("_endless"))
    both = mine.unionByName(allowed_rows(frame).select(*KEY, F.lit(0).alias("_side"), F.lit(1).alias("_frame"), F.lit(False).alias("_endless")))
    per = both.groupBy(*KEY).agg(F.sum("_side").alias("s"), F.sum("_frame").alias("f"), F.max("_endless").alias("e"))
    missing = F.col("row_id").isNull() | F.col("cusip").isNull() | F.col("ns").isNull()
    r = per.agg(F.count_if((F.col("s") != 1) | (F.col("f") != 1) | missing).alias("odd"), F.count_if("e").alias("endless")).first()
    if r["odd"]:
        raise ValueError(f"{r['odd']} rows are not once in the sidecar and once in Train and Validation")
    if r["endless"]:
        raise ValueError(f"{r['endless']} rows hold an infinite value")
    return {"source": source, "settings": known, "config": config, "sidecar": store.digest(sidecar)}


def _name(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def _place(root: str, source: str, known: dict) -> str:
    return f"{root}/sidecars/{_name([source, known])}"


def save_sidecar(spark: SparkSession, root: str, frame: DataFrame, sidecar: DataFrame, config: dict, settings: dict) -> str:
    """Writes a checked sidecar to a new folder and makes it the latest of its experiment."""
    bound = check_sidecar(frame, sidecar, config, settings)
    place = _place(root, bound["source"], bound["settings"])
    name = store.save_snapshot(spark, place, {"movement": sidecar}, bound)
    store.publish(spark, f"{place}/latest", {"snapshot": name})
    return name


def load_sidecar(spark: SparkSession, root: str, frame: DataFrame, settings: dict) -> tuple[DataFrame, dict]:
    """The latest sidecar of this frame and these settings with what binds it, checked once more."""
    known = identity(settings)
    place = _place(root, source_key(frame), known)
    name = store.safe_name(store.latest(spark, f"{place}/latest")["snapshot"])
    bound = store.read_manifest(spark, f"{place}/{name}/manifest")["meta"]
    sidecar = store.load_table(spark, place, name, "movement")
    if bound["settings"] != json.loads(json.dumps(known)) or check_sidecar(frame, sidecar, bound["config"], settings)["sidecar"] != bound["sidecar"]:
        raise ValueError("the sidecar is of another experiment")
    return sidecar, bound


def check_reference(frame: DataFrame, predictions: DataFrame, settings: dict) -> str:
    """The content of the saved validation predictions; raises ValueError unless they are whole and of the
    experiment's versions."""
    models = {r["model"] for r in predictions.select("model").distinct().limit(len(settings["versions"]) + 1).collect()}
    if models != set(settings["versions"]) or REFERENCE not in models:
        raise ValueError("predictions are not of the experiment's versions")
    cohort = frame.filter("split = 'Validation'").withColumn("truth", F.col("bm_spread"))
    problems = {r["problem"]: r["rows"] for r in prediction_problems(cohort, predictions).collect()}
    if problems:
        raise ValueError(f"predictions are damaged: {problems}")
    return store.digest(predictions)


def _finite(c: str):
    x = F.col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def validate_block(
    spark: SparkSession, root: str, frame: DataFrame, sidecar: DataFrame, config: dict, predictions: DataFrame, settings: dict, block: str, progress: Progress | None = None
) -> tuple[DataFrame, dict]:
    """A block's validation predictions and what is known of the run.

    A block is fitted once for its rows and events: the same request gives its predictions back, an
    altered one or one after an attempt that did not end is refused.  The reference is not fitted again."""
    tell = progress or (lambda *_: None)
    if block not in BLOCKS:
        raise ValueError(f"blocks are {sorted(BLOCKS)}")
    check_unlocked(settings)
    bound = check_sidecar(frame, sidecar, config, settings)
    against = check_reference(frame, predictions, settings)
    added, rows = block_columns(block), allowed_rows(frame)
    if not set(added) <= set(sidecar.columns):
        raise ValueError(f"the sidecar holds no {block} columns")
    if settings["model_columns"][REFERENCE] != list(version_columns(REFERENCE)):
        raise ValueError(f"the columns of {REFERENCE!r} have changed")
    if rows.filter(~(_finite("bm_spread") & _finite("prev_bm_spread"))).limit(1).count():
        raise ValueError("a target is missing: rows are never dropped here")
    check_comparison(rows, "Validation")
    x = rows.join(sidecar.select("row_id", *added), "row_id")
    # Counts alone show no movement; a mean that is zero does.
    seen = F.lit(False)
    for c in added:
        if c.endswith("mean_bps"):
            seen = seen | _finite(c)
    support = {r["split"]: (r["seen"], r["n"]) for r in x.groupBy("split").agg(F.count_if(seen).alias("seen"), F.count("*").alias("n")).collect()}
    if not all(s for s, _ in support.values()):
        raise ValueError("no movement is known in Train or in Validation")
    name = BLOCKS[block]
    info = {
        "model": name, "reference": REFERENCE, "train_n": support["Train"][1], "validation_n": support["Validation"][1], "support": {k: s for k, (s, _) in support.items()},
        "warnings": [f"{k}: movement is known for less than {LEAST_SUPPORT:.0%} of rows" for k, (s, n) in sorted(support.items()) if s / n < LEAST_SUPPORT],
    }
    request = json.loads(json.dumps({**bound, "block": block, "predictions": against, "columns": settings["model_columns"][REFERENCE] + added}))
    ledger = store.Ledger(spark, f"{root}/runs")
    fitted = []

    def fit() -> DataFrame:
        fitted.append(name)
        budget = settings["budget"]
        tell("models", 0, 1, f"{name}: {budget['trees']} trees")
        return fit_predict(x, REFERENCE, trees=budget["trees"], depth=budget["depth"], seed=budget["seed"], added=added, name=name).withColumn("train_n", F.lit(info["train_n"]))

    out = ledger.run(request, fit, key=_name([bound["source"], config["event_key"], block]))
    tell("models", 1, 1, f"{name}: {'fitted and saved' if fitted else 'found again, not fitted'}")
    return out, info | {"reused": not fitted}
