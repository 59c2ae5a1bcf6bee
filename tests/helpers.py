"""Small frames of quotes: rows (minute, firm, side, spread, quantity) of one bond."""

from datetime import date

MINUTE = 60 * 10**9
START = 1_772_445_600 * 10**9  # 2026-03-02 10:00 wall time
QUOTES = "cusip string, firm string, side string, ns bigint, day date, spread double, quantity double"


def at(minute):
    return START + int(minute * MINUTE)


def day(minute):
    return date.fromordinal(719_163 + at(minute) // (1440 * MINUTE))


def quotes(spark, rows, cusip="X"):
    return spark.createDataFrame([(cusip, f, s, at(m), day(m), None if v is None else float(v), None if q is None else float(q)) for m, f, s, v, q in rows], QUOTES)


def queries(spark, minutes, cusip="X"):
    return spark.createDataFrame([(i, cusip, at(m), day(m)) for i, m in enumerate(minutes)], "row_id bigint, cusip string, ns bigint, day date")


def rows_of(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]
