"""Structured Streaming variants; an extension of the batch operators.

Late messages are dropped once the watermark has passed their time, as an event that was
emitted is never revised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SERIES
from ..functions.scalar import coerce
from ..operators.events import keyed, normalized, with_candidate_stats


def read_quotes(spark, path: str, schema, **options) -> DataFrame:
    """A stream of Parquet files of quotes."""
    reader = spark.readStream.schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.parquet(path)


def stream_events(quotes: DataFrame, *, time_col: str = "event_time", delay: str = "10 minutes") -> DataFrame:
    """Set-valued events of a stream: rows of one key and time become one event when the
    watermark passes it.  ``quotes`` has firm, cusip, side, ns, day, spread, quantity and ``time_col``.

    A stream allows one aggregation, so full-row repeats are counted against the distinct
    pairs of spread and quantity, not against other columns."""
    rows = normalized(keyed(quotes)).withWatermark(time_col, delay)
    pair = F.struct("s", "qtag")
    events = rows.groupBy(time_col, *SERIES, "ns", "day").agg(
        F.count("*").alias("rows"),
        F.array_sort(F.collect_set("s")).alias("spread_set"),
        F.array_sort(F.collect_set("qtag")).alias("quantity_set"),
        F.array_sort(F.collect_set(pair)).alias("pair_set"),
        F.sum(F.col("s").isNull().cast("bigint")).alias("bad"),
    )
    events = events.withColumn("repeats", F.col("rows") - F.size("pair_set"))
    return with_candidate_stats(events)


def stream_coverage(quotes: DataFrame, *, time_col: str = "event_time", delay: str = "10 minutes", width: str = "30 minutes") -> DataFrame:
    """Messages, dealers (approximate) and mean spread per bond and side in tumbling windows."""
    types = dict(quotes.dtypes)
    q = keyed(quotes).withColumn("s", coerce(F.col("spread"), types["spread"])).withWatermark(time_col, delay)
    return q.groupBy(F.window(time_col, width), "cusip", "side").agg(F.count("*").alias("messages"), F.approx_count_distinct("firm").alias("dealers"), F.avg("s").alias("mean_spread"))


def without_repeats(quotes: DataFrame, columns: list[str], *, time_col: str = "event_time", delay: str = "10 minutes") -> DataFrame:
    return quotes.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(columns)
