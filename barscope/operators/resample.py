"""Week and month bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscope.functions.series import W
from barscope.functions.values import col

BASE = ("o", "h", "l", "c", "v", "amount")


def period_end(d, freq: str) -> Column:
    """Label of a day's period: the Friday on or after it, or the calendar month end."""
    d = col(d)
    if freq == "W":
        return F.next_day(F.date_sub(d, 1), "FRI")
    if freq == "M":
        return F.last_day(d)
    raise ValueError(f"unknown timeframe {freq!r}")


def last_finished(d, freq: str) -> Column:
    """Label of the newest period that has ended by the day."""
    d, end = col(d), period_end(d, freq)
    before = F.date_sub(end, 7) if freq == "W" else F.last_day(F.add_months(F.trunc(d, "MM"), -1))
    return F.when(end == d, end).otherwise(before)


def resample(df: DataFrame, freq: str, keep_gaps: bool = True) -> DataFrame:
    """Bars per code and period, with the label as ``d``.

    A period without bars between the first and the last one stays, with missing prices and zero
    volume.
    """
    def present(c):
        return F.when(F.col(c).isNotNull(), F.col("d"))

    aggs = {"o": F.min_by("o", present("o")), "h": F.max("h"), "l": F.min("l")}
    aggs |= {"c": F.max_by("c", present("c"))}
    aggs |= {n: F.coalesce(F.sum(n), F.lit(0.0)) for n in ("v", "amount")}
    for n in df.columns:
        if n not in ("code", "d", *BASE):
            aggs[n] = F.max_by(n, present(n))
    aggs = {n: e for n, e in aggs.items() if n in df.columns}
    names = list(aggs)
    if keep_gaps:
        # The next bar of the series; windowing by code first leaves the rows where the aggregation
        # and later windows need them, so one shuffle serves all.
        after = period_end(F.lead("d").over(W()), freq)
        df = df.withColumn("_next", F.when(after != period_end("d", freq), after))
        aggs["_next"] = F.max("_next")
    out = df.groupBy("code", period_end("d", freq).alias("_pe")).agg(
        *[e.alias(n) for n, e in aggs.items()]
    )
    if not keep_gaps:
        return out.select("code", F.col("_pe").alias("d"), *names)
    if freq == "W":
        bins = F.sequence("_pe", F.coalesce(F.date_sub("_next", 7), F.col("_pe")), F.expr("interval 7 days"))
    else:
        first = F.trunc("_pe", "MM")
        stop = F.coalesce(F.add_months(F.trunc("_next", "MM"), -1), first)
        bins = F.transform(F.sequence(first, stop, F.expr("interval 1 month")), F.last_day)
    out = out.select("code", F.posexplode(bins).alias("_k", "_d"), *names)
    real = F.col("_k") == 0
    cols = [
        F.when(real, F.col(n)).otherwise(F.lit(0.0)).alias(n) if n in ("v", "amount")
        else F.when(real, F.col(n)).alias(n)
        for n in names
    ]
    return out.select("code", F.col("_d").alias("d"), *cols)
