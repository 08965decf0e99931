"""The trading calendar: distinct bar dates with their place.

It has one row per date, so it is small at any data size; the only windows without partitioning
and the only unconditional broadcasts of the library are over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscope.functions.values import col


def trade_dates(df: DataFrame) -> DataFrame:
    """Distinct dates, ascending, with their 1-based index."""
    days = df.select("d").distinct()
    return days.withColumn("idx", F.row_number().over(Window.orderBy("d")))


def latest_date(df: DataFrame) -> DataFrame:
    return df.agg(F.max("d").alias("d"))


def recent_dates(df: DataFrame, n: int) -> DataFrame:
    return df.select("d").distinct().orderBy(F.col("d").desc()).limit(n)


def merge_calendar(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("d").union(b.select("d")).distinct()


def pick_ref_date(df: DataFrame, configured=None) -> DataFrame:
    """The configured date if it has data, else the newest one."""
    newest = F.max("d")
    if configured is None:
        return df.agg(newest.alias("d"))
    cfg = F.lit(configured).cast("date")
    return df.agg(F.coalesce(F.max(F.when(F.col("d") == cfg, F.col("d"))), newest).alias("d"))


def prev_trade_date(calendar: DataFrame, refs: DataFrame) -> DataFrame:
    """For each reference date the greatest calendar date before it."""
    return _latest_at(calendar, refs, strict=True).withColumnRenamed("found", "prev_d")


def _latest_at(calendar: DataFrame, refs: DataFrame, strict: bool) -> DataFrame:
    # One pass over the union of both date lists instead of a comparison of all pairs.
    days = calendar.select(F.col("d"), F.col("d").alias("day"))
    marks = refs.select("d").distinct().select("d", F.lit(None).cast("date").alias("day"))
    every = days.unionByName(marks).groupBy("d").agg(
        F.max("day").alias("day"), F.max(F.col("day").isNull()).alias("asked")
    )
    frame = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    found = every.withColumn("found", F.last("day", ignorenulls=True).over(frame))
    return found.where("asked").select("d", "found")


def start_for(calendar: DataFrame, refs: DataFrame, n: int) -> DataFrame:
    """The date ``n`` trading days back, counted from the nearest date on or before the reference."""
    at = _latest_at(calendar, refs, strict=False)
    idx = calendar.select(F.col("d").alias("found"), "idx")
    at = at.join(idx, "found").withColumn("idx", F.greatest(F.col("idx") - n, F.lit(1)))
    return at.select("d", "idx").join(calendar.select(F.col("d").alias("start"), "idx"), "idx").drop("idx")


def trade_span(calendar: DataFrame, start=None, end=None, n: int | None = None) -> DataFrame:
    """Dates in [start, end], or the last ``n`` dates up to ``end``."""
    days = calendar.select("d")
    if end is not None:
        days = days.where(F.col("d") <= F.lit(end).cast("date"))
    if start is not None:
        return days.where(F.col("d") >= F.lit(start).cast("date"))
    return days.orderBy(F.col("d").desc()).limit(n) if n else days


def window_dates(calendar: DataFrame, n: int) -> DataFrame:
    """Each end date with every date of its trailing n-day window and the place in the window."""
    place = F.explode(F.sequence(F.greatest(F.col("idx") - n + 1, F.lit(1)), F.col("idx")))
    spans = calendar.select(F.col("d").alias("end_d"), F.col("idx").alias("end_idx"), place.alias("idx"))
    return spans.join(calendar, "idx").select("end_d", "end_idx", "d", "idx")


def missing_dates(calendar: DataFrame, ranks: DataFrame) -> DataFrame:
    """Calendar dates without ranks."""
    return calendar.select("d").join(ranks.select("d").distinct(), "d", "left_anti")


def date_gaps(days: DataFrame, limit: int = 21) -> DataFrame:
    """Neighbouring dates more than ``limit`` days apart."""
    after = F.lead("d").over(Window.orderBy("d"))
    out = days.select("d").distinct().withColumn("next_d", after)
    out = out.withColumn("days", F.datediff("next_d", "d"))
    return out.where(F.col("days") > limit)


def add_index(df: DataFrame, calendar: DataFrame) -> DataFrame:
    return df.join(F.broadcast(calendar), "d")


def as_date(x) -> Column:
    return col(x).cast("date")
