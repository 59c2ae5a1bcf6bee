"""Backward as-of joins as one sorted pass: events and queries are united, ordered by time,
and the last event is carried forward.  The latest event is taken first and judged after,
so an incomplete latest message hides older complete ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import minutes


def asof(events: DataFrame, queries: DataFrame, fields: list[str], *, on: tuple[str, ...] = ("cusip",), by: tuple[str, ...] = ("firm", "side"), same_day: bool = True, exact: bool = True) -> DataFrame:
    """For each distinct query (``on``, ns[, day]) and each ``by`` seen with it (on the same
    day, if ``same_day``): the fields of the latest event at or (``exact=False``) before it.

    Returns on, by, ns, [day,] ``event_ns``, ``age_min`` and ``fields``; queries without an
    event get no row.  One shuffle, by (on, by[, day])."""
    day = ("day",) if same_day else ()
    keys = [*on, *by, *day]
    grid = queries.select(*on, "ns", *day).distinct().join(events.select(*keys).distinct(), [*on, *day])
    state = F.struct(F.col("ns").alias("event_ns"), *fields)
    first, second = (0, 1) if exact else (1, 0)
    both = events.select(*keys, "ns", F.lit(first).alias("_kind"), state.alias("_state")).unionByName(
        grid.select(*keys, "ns", F.lit(second).alias("_kind"), F.lit(None).cast(events.select(state.alias("s")).schema["s"].dataType).alias("_state"))
    )
    w = Window.partitionBy(*keys).orderBy("ns", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_state", F.last("_state", ignorenulls=True).over(w)).filter((F.col("_kind") == second) & F.col("_state").isNotNull())
    return out.select(*keys, "ns", "_state.*").withColumn("age_min", minutes(F.col("ns") - F.col("event_ns")))
