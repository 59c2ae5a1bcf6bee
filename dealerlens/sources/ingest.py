"""Sources: Parquet scans, zone-aware ingest, and the views of quotes and trades of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import day_of

NEW_YORK = "America/New_York"


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A scan of the wanted columns; filters on it reach the files."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def wall_ns(ts: Column) -> Column:
    """Nanoseconds of a zone-less timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz")) * 1000


def utc_text_to_et(text: Column) -> Column:
    """Text or timestamp in UTC -> New York wall time, zone-less; unparseable is NULL."""
    return F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), F.expr("cast(null as timestamp_ntz)") if text is None else text.try_cast("timestamp_ntz"))


def local_to_et(text: Column, zone: str = NEW_YORK, *, strict: bool = False) -> Column:
    """Wall time in ``zone`` -> New York wall time.  A time that the zone skips (the way to UTC and
    back does not return to it) or has twice (an instant shortly before or after reads the same) is
    NULL, or with ``strict`` an error; unparseable text is NULL."""
    local = text.try_cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    reads = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    shifted = [F.timestamp_add("MINUTE", F.lit(m), utc) for m in (-120, -60, -30, 30, 60, 120)]
    once = reads(utc) == local
    for t in shifted:
        once = once & (reads(t) != local)
    found = F.when(once, F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), utc))
    if strict:
        return F.when(local.isNotNull() & ~once, F.raise_error(F.concat(F.lit("no single instant has the local time "), local.cast("string"))).cast("timestamp_ntz")).otherwise(found)
    return found


def trade_universe(trades: DataFrame, start=None, end=None) -> DataFrame:
    """The trades between two instants of ``ns``, both included; None leaves a side open."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col("ns") >= start)
    if end is not None:
        keep = keep & (F.col("ns") <= end)
    return trades.filter(F.col("cusip").isNotNull() & F.col("ns").isNotNull() & keep)


def combined_metadata(*sources: DataFrame) -> DataFrame:
    """(cusip, issuer, tenor): of each bond, the row of the last source that names its issuer; of
    several rows there, the greatest.  Sources have cusip, issuer and tenor."""
    every = None
    for i, s in enumerate(sources):
        part = s.select(F.lit(i).alias("p"), F.trim("cusip").alias("cusip"), F.trim("issuer").alias("issuer"), F.col("tenor").cast("double").alias("tenor"))
        every = part if every is None else every.unionByName(part)
    best = every.filter("cusip is not null and issuer is not null").groupBy("cusip").agg(F.max(F.struct("p", "issuer", "tenor")).alias("m"))
    return best.select("cusip", "m.issuer", "m.tenor")


#: The columns of the base model that the derived trades lack, as SQL on row_id.
DERIVED_BASE = {
    "d_cpp_bm_spread": "CAST(row_id % 11 - 5 AS DOUBLE) / 100",
    "coupon": "CAST(row_id % 9 AS DOUBLE) / 2 + 2",
    "d_cdx_trade": "CAST(row_id % 5 - 2 AS DOUBLE) / 10",
    "mean_issuer_spread_dev": "CAST(row_id % 13 - 6 AS DOUBLE) / 20",
    "num_of_issuer_trades_since_prev": "CAST(row_id % 6 AS DOUBLE)",
    "prev_quantity": "CAST((row_id + 2) % 5 + 1 AS DOUBLE) * 50000",
    "prev_trade_type": "CASE (row_id + 1) % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'B' ELSE 'D' END",
    "yrs_to_maturity": "CAST(row_id % 29 + 1 AS DOUBLE)",
    "bm_yield_std": "CAST(row_id % 17 AS DOUBLE) / 100",
    "d_short_to_bm_spread": "CAST(row_id % 7 AS DOUBLE) / 50",
    "prev_bm_spread_std_group_by_type": "CAST(row_id % 19 AS DOUBLE) / 100",
}


def base_trades_view(spark: SparkSession, sf_dir: str, bonds: int = 2) -> DataFrame:
    """``trades_view`` with all columns of the base model."""
    return trades_view(spark, sf_dir, bonds).withColumns({c: F.expr(e) for c, e in DERIVED_BASE.items()})


def with_clock(df: DataFrame, ts_col: str) -> DataFrame:
    """Adds ``ns`` (ordering column) and ``day`` (the wall-clock date)."""
    return df.withColumn("ns", wall_ns(F.col(ts_col))).withColumn("day", day_of(F.col("ns")))


def quotes_view(spark: SparkSession, sf_dir: str, bonds: int = 2, dealers: int = 4) -> DataFrame:
    """Quotes derived from ``events``: cusip, firm, side, ns, day, spread, quantity."""
    e = read_parquet(spark, f"{sf_dir}/events.parquet").filter("event_type <> 'purchase'")
    k = F.get_json_object("props", "$.k").cast("int")
    slot = 20 * 60 * 10**9
    return (
        e.withColumn("k", k)
        .withColumn("ns", F.floor(wall_ns(F.col("ts")) / slot).cast("bigint") * slot)
        .select(
            F.concat(F.lit("B"), (F.col("user_id") % bonds).cast("string")).alias("cusip"),
            F.concat(F.lit("D"), (F.floor(F.col("user_id") / bonds) % dealers).cast("string")).alias("firm"),
            F.when(F.col("event_id") % 2 == 0, "bid").otherwise("ask").alias("side"),
            "ns",
            day_of(F.col("ns")).alias("day"),
            F.when(F.col("k") % 17 != 0, F.round(F.col("value") / 10, 0)).alias("spread"),
            F.when(F.col("k") < 10, 0).when(F.col("k") < 20, None).when(F.col("k") < 25, -1).otherwise(F.col("k") % 3 + 1).cast("double").alias("quantity"),
        )
    )


def trades_view(spark: SparkSession, sf_dir: str, bonds: int = 2) -> DataFrame:
    """Trades derived from ``events``: row_id, cusip, ns, day, bm_spread, prev_bm_spread,
    quantity, trade_type, issuer, sector (labels with gaps and conflicts)."""
    e = read_parquet(spark, f"{sf_dir}/events.parquet").filter("event_type = 'purchase'")
    bond, row = F.col("user_id") % bonds, F.col("event_id")
    return e.withColumn("ns", wall_ns(F.col("ts"))).select(
        row.alias("row_id"),
        F.concat(F.lit("B"), bond.cast("string")).alias("cusip"),
        "ns",
        day_of(F.col("ns")).alias("day"),
        (F.col("value") / 1000).alias("bm_spread"),
        (F.col("value") / 1000 - (row % 7 - 3) / 100).alias("prev_bm_spread"),
        ((row % 5 + 1) * 50000).cast("double").alias("quantity"),
        F.when(row % 3 == 0, "S").when(row % 3 == 1, "B").otherwise("D").alias("trade_type"),
        F.when((bond == 1) & (row % 40 == 0), "Unknown").otherwise(F.concat(F.lit("I"), F.floor(bond / 3).cast("string"))).alias("issuer"),
        F.when(row % 10 == 0, None).when((bond == 1) & (row % 4 == 1), "Bank").otherwise(F.when(bond % 2 == 0, "Energy").otherwise("Financial")).alias("sector"),
    )
