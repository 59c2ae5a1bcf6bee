"""Mixing sources to target weights by Poisson replication.

Every document is repeated a Poisson number of times whose mean is its source's target
repetition rate: target share of the source times all documents, divided by the
documents it has.  The draw inverts the Poisson distribution at a uniform number made
from a seeded hash of the document's id, so it depends on the document alone: any
partitioning and any rerun give the same copies.  The copies are then shuffled over all
partitions by a hash of id, copy and seed.

Target shares: ``weights`` by source, where given; a source that it does not name gets its
own number of documents to the power ``temperature`` as its weight, scaled so that all
such sources together have the share that they have in the input.

Defined results: a null source is a source of its own; null texts, empty texts and null
ids (hashed as the empty text, so all of them draw alike) are documents like others; very long texts
and ties need nothing of their own; repeated rows draw the same count each; an empty table gives
no rows; extra columns are kept, whatever their names, except that columns named as the added ones
are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import BROADCAST_ROWS, every_column, free_name, table

SEED = 2026
TEMPERATURE = 0.5
#: Hash steps of the uniform number: 13 hex digits, exact in a double.
STEPS = 16.0**13
#: Run of terms for rates to TERMS / 3; beyond it the remaining probability is below 1e-13.
TERMS = 96
#: Copies that one array numbers.
COPIES = 10_000
#: Rates to this are summed from 0; for higher ones, exp(-rate) nears the end of doubles.
FROM_ZERO = 512
ADDED = ("repetition_rate", "copy", "shuffle_key")


def source_rates(docs: DataFrame, *, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float = 1.0, source_col: str = "source") -> DataFrame:
    """(source, n_docs, repetition_rate), one row per source."""
    counted = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"))
    named = F.lit(None).cast("double")
    for source, weight in (weights or {}).items():
        named = F.when(F.col("source") == source, F.lit(float(weight))).otherwise(named)
    counted = counted.withColumn("named", named)
    sums = counted.agg(
        F.sum("n_docs").cast("double").alias("all_docs"),
        F.sum(F.when(F.col("named").isNull(), F.col("n_docs"))).cast("double").alias("other_docs"),
        F.sum(F.when(F.col("named").isNull(), F.pow(F.col("n_docs").cast("double"), F.lit(temperature)))).alias("other_weight"),
        F.sum("named").alias("named_weight"),
    )
    other_share = F.coalesce(F.col("other_docs"), F.lit(0.0)) / F.col("all_docs")
    share = F.when(F.col("named").isNull(), other_share * F.pow(F.col("n_docs").cast("double"), F.lit(temperature)) / F.col("other_weight")).otherwise((1 - other_share) * F.col("named") / F.col("named_weight"))
    # ``sums`` is one row: the join adds it to every source.
    return counted.join(F.broadcast(sums), F.lit(True)).select("source", "n_docs", (F.lit(total) * share * F.col("all_docs") / F.col("n_docs")).alias("repetition_rate"))


def uniform(key, seed: int):
    """A number in [0, 1) from a hash of the key as text."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(STEPS)


def poisson_inverse(u, rate):
    """The least n whose cumulative Poisson probability exceeds u.

    Terms are summed from 0, or, for rates beyond ``FROM_ZERO``, from 10 standard deviations below
    the rate, where what lies below is under 1e-20; they end 10 standard deviations above."""
    wide = 10 * F.sqrt(rate)
    low = F.when(rate > FROM_ZERO, F.floor(rate - wide)).otherwise(F.lit(0)).cast("bigint")
    high = F.when(rate > TERMS / 3, F.ceil(rate + wide + 40)).otherwise(F.lit(TERMS)).cast("bigint")
    # The logarithm of the first term, with Stirling's series for the factorial.
    k = low.cast("double")
    log_p = k * F.log1p((rate - k) / k) - (rate - k) - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k)
    first = F.when(rate > FROM_ZERO, F.exp(log_p)).otherwise(F.exp(-rate))
    start = F.struct(first.alias("p"), first.alias("c"), low.cast("int").alias("n"))
    step = lambda a, i: F.when(u < a["c"], a).otherwise(
        F.struct((a["p"] * rate / i).alias("p"), (a["c"] + a["p"] * rate / i).alias("c"), i.cast("int").alias("n"))
    )
    drawn = F.aggregate(F.sequence(low + 1, high), start, step, lambda a: a["n"])
    return F.when(u <= 0, F.lit(0)).otherwise(drawn).cast("int")


def mix(docs: DataFrame, *, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float = 1.0, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The copies, globally shuffled: the columns of ``docs``, ``repetition_rate``, ``copy``
    (from 0) and ``shuffle_key``, by which every partition is in order."""
    rates = source_rates(docs, weights=weights, temperature=temperature, total=total, source_col=source_col)
    of_source, rate, count, block = (free_name(docs, x) for x in ("_source", "_rate", "_n", "_block"))
    rates = rates.select(F.col("source").alias(of_source), F.col("repetition_rate").alias(rate))
    if rates.count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    kept = [x for x, c in zip(every_column(docs), docs.columns, strict=True) if c.lower() not in ADDED]
    drawn = docs.select(kept).join(rates, F.col(source_col).eqNullSafe(F.col(of_source)), "left").withColumn(count, poisson_inverse(uniform(F.col(id_col), seed), F.col(rate)))
    # In blocks, so that no array is longer than COPIES, however often a document is repeated.
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / COPIES).cast("int")))
    numbers = F.explode(F.sequence(F.col(block) * COPIES, F.least(F.col(count), (F.col(block) + 1) * COPIES) - 1))
    copies = drawn.filter(F.col(count) > 0).withColumn(block, blocks).withColumn("copy", numbers)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy").cast("string")))
    out = copies.select(*kept, F.col(rate).alias("repetition_rate"), "copy", key.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumn("repetition_rate", F.round("repetition_rate", 9))


def oracle() -> str:
    return f"""
WITH RECURSIVE c AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), r AS (
  SELECT source, sqrt(CAST(n AS DOUBLE)) / (SELECT sum(sqrt(CAST(n AS DOUBLE))) FROM c) * (SELECT sum(n) FROM c) / n AS rate FROM c
), t(source, i, p, cum) AS (
  SELECT source, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL
  SELECT t.source, t.i + 1, t.p * r.rate / (t.i + 1), t.cum + t.p * r.rate / (t.i + 1)
  FROM t JOIN r ON t.source IS NOT DISTINCT FROM r.source WHERE t.i < {TERMS} AND t.cum < 1 - 1e-15
), d AS (
  SELECT doc.*, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / {STEPS} AS u FROM documents doc
), n AS (
  SELECT d.*, r.rate, (SELECT count(*) FROM t WHERE t.source IS NOT DISTINCT FROM d.source AND t.cum <= d.u) AS copies
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), e AS (
  SELECT n.*, CAST(unnest(range(copies)) AS INTEGER) AS copy FROM n
)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS repetition_rate, copy,
       md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM e
"""
