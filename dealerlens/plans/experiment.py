"""The experiment: chronological split, feature versions, guards, fit and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EMBARGO_DAYS, MIN_TRAIN_DAYS, TEST_DAYS, VALIDATION_DAYS
from ..operators.pairs import PAIR_FEATURES

VERSIONS = ["Base", "Price levels", "Reliability", "Age decay", "Max age", "Candidate clip", "Dealer downweight", "Paired"]
# The base model's columns, its categories, and what each version adds.
BASE_FEATURES = [
    "d_cpp_bm_spread", "coupon", "d_cdx_trade", "mean_issuer_spread_dev", "num_of_issuer_trades_since_prev", "prev_bm_spread", "prev_quantity",
    "prev_trade_type", "quantity", "trade_type", "yrs_to_maturity", "bm_yield_std", "d_short_to_bm_spread", "prev_bm_spread_std_group_by_type",
]
BASE_CATEGORIES = ["prev_trade_type", "trade_type"]
RELIABILITY = ["mean_candidate_gap", "dispersion_bps", "median_message_age_min", "median_change_age_min", "unknown_change_age_fraction", "zero_quantity_fraction", "unknown_quantity_fraction", "decay_effective_dealers", "n_peer_supported"]
PAIRED = [c for c in PAIR_FEATURES if c not in ("pair_mid", "size_time_mid")]
#: What a version takes in place of the equal center.
LEVEL = {"Age decay": "center_decay", "Max age": "center_max_age", "Candidate clip": "center_candidate_clip", "Dealer downweight": "center_dealer_downweight"}
#: Fits at a time: each is many short jobs that leave most cores idle.
FITS = 4
#: Rows for each task of a fit, at least where there are as many.
ROWS_A_TASK = 25_000


def with_split(trades: DataFrame, *, validation: int = VALIDATION_DAYS, test: int = TEST_DAYS, embargo: int = EMBARGO_DAYS, least_train: int = MIN_TRAIN_DAYS) -> DataFrame:
    """``trades`` with split and refit: last days test, those before validation, and embargo days, counted in
    observed trade dates, between train and validation.  ``refit`` marks rows that a final
    fit may use: all outside the embargo before the test days."""
    # One row per trade date comes to the driver; the split is a comparison of days, so no join follows.
    days = sorted((r["day"] for r in trades.select("day").filter("day is not null").distinct().collect()), reverse=True)
    if len(days) < validation + test + embargo + least_train:
        raise ValueError(f"{len(days)} trade dates are too few for the split")
    day = F.col("day")
    last = lambda n: day >= F.lit(days[n - 1]) if n else F.lit(False)
    split = F.when(last(test), "Test").when(last(validation + test), "Validation").when(last(validation + test + embargo), "Embargo").when(day.isNotNull(), "Train").otherwise("Outside experiment")
    return trades.withColumns({"split": split, "refit": day.isNotNull() & ~F.coalesce(last(test + embargo), F.lit(False))})


def chronological_split(trades: DataFrame, **days: int) -> DataFrame:
    """(row_id, day, split, refit) of ``with_split``."""
    return with_split(trades, **days).select("row_id", "day", "split", "refit")


def version_columns(version: str) -> dict[str, Column]:
    """Name -> column of a feature version, on a frame of query features with ``BASE_FEATURES``:
    14 columns for Base, 19 with price levels, 37 with reliability (the cleaning rules replace
    levels only), 50 with pairs."""
    if version not in VERSIONS:
        raise ValueError(f"unknown version {version!r}")
    out = {c: F.col(c) for c in BASE_FEATURES}
    if version == "Base":
        return out
    count = "n_fresh_dealers" if version == "Max age" else "n_dealers"
    for s in ("bid", "ask"):
        out[f"{s}_anchor_gap"] = F.col(f"bcq_{s}_{LEVEL.get(version, 'center_equal')}") - 100 * F.col("prev_bm_spread")
        out[f"{s}_n_dealers"] = F.col(f"bcq_{s}_{count}")
    out["is_quoted"] = (F.col(f"bcq_bid_{count}") + F.col(f"bcq_ask_{count}") > 0).cast("double")
    if version != "Price levels":
        out |= {f"{s}_{c}": F.col(f"bcq_{s}_{c}") for s in ("bid", "ask") for c in RELIABILITY}
    if version == "Paired":
        out |= {c: F.col(f"bcq_{c}") for c in PAIRED}
    return out


def model_frame(features: DataFrame, version: str) -> DataFrame:
    return features.select("row_id", *(c.alias(n) for n, c in version_columns(version).items()))


def reference_of(version: str) -> str:
    """The version against which a version is judged."""
    return {"Base": "Base", "Price levels": "Base", "Reliability": "Price levels", "Age decay + Direction": "Age decay", "Age decay + Issuer": "Age decay"}.get(version, "Reliability")


def check_comparison(frame: DataFrame, stage: str, least_train: int = 20) -> int:
    """Raises ValueError unless train rows are enough and earlier than what is evaluated; the number of both."""
    if stage not in ("Validation", "Test"):
        raise ValueError("stage is Validation or Test")
    r = frame.agg(
        F.count_if(F.col("split") == "Train").alias("train"), F.count_if(F.col("split") == stage).alias("n"), F.max(F.when(F.col("split") == "Train", F.col("ns"))).alias("last"),
        F.min(F.when(F.col("split") == stage, F.col("ns"))).alias("first"), F.max(F.when(F.col("split") == "Train", F.col("bcq_is_quoted"))).alias("a"), F.max(F.when(F.col("split") == stage, F.col("bcq_is_quoted"))).alias("b"),
    ).first()
    if r["train"] < least_train or not r["n"]:
        raise ValueError("too few rows to train or to evaluate")
    if r["last"] >= r["first"]:
        raise ValueError("training reaches into the evaluated time")
    if not r["a"] or not r["b"]:
        raise ValueError("quotes are missing in training or evaluation")
    return r["train"] + r["n"]


def _number(value: Column) -> Column:
    x = value.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), -1e9).otherwise(F.coalesce(x, F.lit(-1e9)))


def learn_categories(frame: DataFrame):
    """The indexer of the base model's categories, learned from Train rows with a target alone; others
    count as missing.  ``frame`` needs split, bm_spread, prev_bm_spread and ``BASE_CATEGORIES``."""
    from pyspark.ml.feature import StringIndexer

    x = frame.filter("split = 'Train' and bm_spread - prev_bm_spread is not null").select(*(F.coalesce(n, F.lit("?")).alias(f"x_{n}") for n in BASE_CATEGORIES))
    return StringIndexer(inputCols=[f"x_{n}" for n in BASE_CATEGORIES], outputCols=[f"c_{n}" for n in BASE_CATEGORIES], handleInvalid="keep", stringOrderType="alphabetAsc").fit(x)


def _inputs(version: str, added: list[str] | tuple[str, ...] = ()) -> dict[str, Column]:
    """Key -> column of a version's numbers.  Versions whose columns are the same share the key."""
    columns = version_columns(version) | {c: F.col(c) for c in added}
    return {f"{n}: {c}": c for n, c in columns.items() if n not in BASE_CATEGORIES}


def model_rows(frame: DataFrame, versions: list[str], *, stage: str = "Validation", added: list[str] | tuple[str, ...] = (), categories=None) -> DataFrame:
    """The rows of Train and ``stage`` with one vector ``all`` of every distinct column of ``versions`` and ``added``,
    categories last; cached, it is what all fits read.  Missing and endless numbers are -1e9."""
    from pyspark.ml.feature import VectorAssembler

    columns: dict[str, Column] = {}
    for version in versions:
        columns |= _inputs(version, added)
    x = frame.filter(F.col("split").isin("Train", stage)).select(
        "row_id", "ns", "day", "split", "bcq_is_quoted", F.col("bm_spread").alias("truth"), "prev_bm_spread", (F.col("bm_spread") - F.col("prev_bm_spread")).alias("target"),
        *(_number(c).alias(f"x_{i}") for i, c in enumerate(columns.values())), *(F.coalesce(n, F.lit("?")).alias(f"x_{n}") for n in BASE_CATEGORIES),
    )
    x = (categories or learn_categories(frame)).transform(x)
    x = VectorAssembler(inputCols=[f"x_{i}" for i in range(len(columns))] + [f"c_{n}" for n in BASE_CATEGORIES], outputCol="all").transform(x)
    return x.select("row_id", "ns", "day", "split", "bcq_is_quoted", "truth", "prev_bm_spread", "target", "all")


def _fit(rows: DataFrame, at: list[int], *, trees: int, depth: int, seed: int):
    """A model on the places ``at`` of the vector."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorSlicer
    from pyspark.ml.regression import GBTRegressor

    x = rows.filter("split = 'Train' and target is not null").select("target", "all")
    boosted = GBTRegressor(featuresCol="features", labelCol="target", lossType="absolute", maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorSlicer(inputCol="all", outputCol="features", indices=at), boosted]).fit(x)


def compare(rows: DataFrame, versions: list[str], *, stage: str = "Validation", trees: int = 40, depth: int = 5, seed: int = 2026, added: list[str] | tuple[str, ...] = (), names: list[str] | None = None) -> DataFrame:
    """Predictions of one fit for each version on ``model_rows`` of the same versions and ``added``; up to ``FITS`` at a time."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    keys = list(dict.fromkeys(k for version in versions for k in _inputs(version, added)))
    ends = range(len(keys), len(keys) + len(BASE_CATEGORIES))
    at = [[*(keys.index(k) for k in _inputs(version, added)), *ends] for version in versions]
    with ThreadPool(min(FITS, len(versions))) as pool:
        models = pool.map(inheritable_thread_target(rows.sparkSession)(lambda a: _fit(rows, a, trees=trees, depth=depth, seed=seed)), at, chunksize=1)
    # All models answer in one pass over the rows.
    x = rows.filter((F.col("split") == stage) & F.col("target").isNotNull())
    for i, (slicer, boosted) in enumerate(model.stages for model in models):
        x = boosted.setPredictionCol(f"p_{i}").transform(slicer.transform(x)).drop("features")
    each = F.array(*(F.struct(F.lit(name).alias("model"), (F.col("prev_bm_spread") + F.col(f"p_{i}")).alias("pred")) for i, name in enumerate(names or versions)))
    x = x.select("row_id", "ns", "day", F.explode(each).alias("m"), "truth")
    return x.select("row_id", "ns", "day", "m.model", F.lit(stage).alias("stage"), "m.pred", "truth", ((F.col("m.pred") - F.col("truth")) * 100).alias("error_bps"))


def fit_predict(frame: DataFrame, version: str, *, stage: str = "Validation", trees: int = 40, depth: int = 5, seed: int = 2026, added: list[str] | tuple[str, ...] = (), name: str | None = None) -> DataFrame:
    """Gradient-boosted trees on the change from the previous spread, absolute loss;
    (row_id, ns, day, model, stage, pred, truth, error_bps).  Categories are learned from
    Train alone; others count as missing, as missing and endless numbers do at -1e9.  Columns ``added``
    come beside the version's, under the model ``name``."""
    rows = model_rows(frame, [version], stage=stage, added=added)
    return compare(rows, [version], stage=stage, trees=trees, depth=depth, seed=seed, added=added, names=[name or version])


def run_comparison(frame: DataFrame, versions: list[str], *, stage: str = "Validation", **options) -> DataFrame:
    """``compare`` on a frame.  Who has the frame only once caches ``model_rows`` and calls ``compare``."""
    check_comparison(frame, stage)
    return compare(model_rows(frame, versions, stage=stage), versions, stage=stage, **options)
