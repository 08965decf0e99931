"""Checks of bar tables: row rules, continuity, completeness, health."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscope.functions.series import W
from barscope.operators.clean import code_diff, codes_on, prev_day_pairs

TOLERANCE = 1e-6


@dataclass(frozen=True)
class TableRules:
    """Required columns, types by column, and constraints: a regex or a predicate text."""

    required: Sequence[str] = ()
    types: dict[str, tuple[str, ...]] = field(default_factory=dict)
    constraints: dict[str, str] = field(default_factory=dict)


NUMBER = ("double", "float", "int", "bigint", "decimal")
# What each kind of import must satisfy.
DEFAULT_RULES = {
    "bars": TableRules(
        ("code", "d", "o", "h", "l", "c", "v"),
        {"code": ("string",), **{n: NUMBER for n in "ohlcv"}},
        {"code": r"^\d{6}\.(SH|SZ|BJ)$", "o": "> 0", "h": "> 0", "l": "> 0", "c": "> 0", "v": ">= 0"},
    ),
    "indicators": TableRules(
        ("code", "d", "indicator_name", "value"),
        {"code": ("string",), "indicator_name": ("string",), "value": NUMBER},
    ),
    "scores": TableRules(
        ("code", "d", "score", "rank"),
        {"code": ("string",), "score": NUMBER, "rank": ("int", "bigint")},
    ),
}


def validate(df: DataFrame, rules: TableRules) -> DataFrame:
    """Violations (check, column, rows), from one pass over the table.

    A missing column or a wrong type counts as one; a constraint counts the rows that break it.
    """
    spark, have = df.sparkSession, dict(df.dtypes)
    fixed = [("missing_column", c, 1) for c in rules.required if c not in have]
    fixed += [
        ("wrong_type", c, 1)
        for c, kinds in rules.types.items()
        if c in have and have[c].split("(")[0] not in kinds
    ]
    out = spark.createDataFrame(fixed, "check string, column string, rows long")
    checks = [(c, _broken(c, rule)) for c, rule in rules.constraints.items() if c in have]
    if not checks:
        return out
    counts = df.agg(*[F.sum(bad.cast("long")).alias(f"n{i}") for i, (_, bad) in enumerate(checks)])
    rows = [
        F.struct(F.lit("constraint").alias("check"), F.lit(c).alias("column"),
                 F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("rows"))
        for i, (c, _) in enumerate(checks)
    ]
    return out.unionByName(counts.select(F.inline(F.array(*rows))).where(F.col("rows") > 0))


def _broken(name: str, rule: str) -> Column:
    if rule[0] in "<>=!":
        return ~F.coalesce(F.expr(f"`{name}` {rule}"), F.lit(False))
    return ~F.coalesce(F.col(name).cast("string").rlike(rule), F.lit(False))


def preclose_mismatch(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars whose pre_close differs from the close of the previous trading date."""
    pairs = prev_day_pairs(bars, calendar)
    bad = F.abs(F.col("pre_close") - F.col("prev_c")) > TOLERANCE
    return pairs.where(bad).select("code", "d", "pre_close", "prev_c")


def preclose_boundary(history: DataFrame, new: DataFrame) -> DataFrame:
    """Codes whose first new pre_close differs from the last stored close."""
    first = new.groupBy("code").agg(F.min("d").alias("d"), F.min_by("pre_close", "d").alias("pre_close"))
    last = history.groupBy("code").agg(F.max_by("c", "d").alias("prev_c"))
    bad = F.abs(F.col("pre_close") - F.col("prev_c")) > TOLERANCE
    return first.join(last, "code").where(bad).select("code", "d", "pre_close", "prev_c")


def without_mismatches(new: DataFrame, mismatches: DataFrame) -> DataFrame:
    """New bars of the codes that continue their history."""
    return new.join(mismatches.select("code"), "code", "left_anti")


def completeness(expected: DataFrame, bars: DataFrame, day) -> DataFrame:
    """Counts of expected, present and missing codes on a date."""
    present = codes_on(bars, day).withColumn("here", F.lit(1))
    both = expected.select("code").distinct().join(present, "code", "left")
    return both.agg(
        F.count(F.lit(1)).alias("expected"), F.count("here").alias("present"),
        (F.count(F.lit(1)) - F.count("here")).alias("missing"),
    )


def latest_counts(bars: DataFrame, k: int) -> DataFrame:
    """Rows per date, for the newest ``k`` dates."""
    counts = bars.groupBy("d").agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.col("d").desc()).limit(k)


def _alignment(indicators) -> tuple[Column, Column]:
    """Over rows per date with ``_has_<indicator>``: days from the newest bar back to the newest date that has all
    indicators' values (0 or less), and whether all indicators have any."""
    last = [F.max(F.when(F.col(f"_has_{x}") > 0, F.col("d"))) for x in indicators]
    if not last:
        return F.lit(0), F.lit(True)
    return F.datediff(F.array_min(F.array(*last)), F.max("d")), F.forall(F.array(*last), lambda x: x.isNotNull())


def _status(least_rows: float) -> Column:
    low = F.col("latest_rows") < F.greatest(F.lit(float(least_rows)), F.col("expected_rows") * 0.6)
    return (
        F.when(F.col("days") == 0, F.lit("EMPTY"))
        .when(F.col("gap_cnt") > 0, F.lit("WARN"))
        .when((F.col("latest_rows") > 0) & low, F.lit("CRIT"))
        .when(~F.col("ind_exists") | (F.col("ind_lag") < 0), F.lit("WARN"))
        .otherwise(F.lit("OK"))
    )


def health(bars: DataFrame, expected: DataFrame, gap_days: int = 21, indicators=(), least_rows: float = 100, by: str | None = None) -> DataFrame:
    """Range, gaps, newest row count against the expected one, alignment of the indicators, and a status.

    One row, or with ``by`` one for each of its values, such as adjustments; an adjustment without bars has none.
    ``ind_lag`` says how many days the newest values of the indicator that is farthest behind lie before the newest bar; an
    indicator without any value gives ``ind_exists`` false. Bars are counted by date first, so all that follows is bounded by the calendar.
    """
    key = [by] if by else []
    per_day = bars.groupBy(*key, "d").agg(F.count(F.lit(1)).alias("rows"), *[F.count(x).alias(f"_has_{x}") for x in indicators])
    gap = F.datediff(F.lead("d").over(Window.partitionBy(*key).orderBy("d")), "d") > gap_days
    lag, exists = _alignment(indicators)
    span = per_day.withColumn("_gap", gap).groupBy(*key).agg(
        F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("days"), F.count_if("_gap").alias("gap_cnt"),
        F.max_by("rows", "d").alias("latest_rows"), lag.alias("ind_lag"), exists.alias("ind_exists"), F.lit(1).alias("_one"),
    )
    size = expected.agg(F.countDistinct("code").alias("expected_rows"), F.lit(1).alias("_one"))
    return span.join(F.broadcast(size), "_one").drop("_one").withColumn("status", _status(least_rows))


def next_range(bars: DataFrame, expected: DataFrame, end) -> DataFrame:
    """Where an incremental load starts: the day after the newest bar, or the newest day again if
    codes are missing on it and nothing newer is due."""
    end = F.lit(end).cast("date")
    newest = bars.agg(F.max("d").alias("latest"))
    have = bars.join(F.broadcast(newest), bars["d"] == newest["latest"], "left_semi")
    missing = code_diff(expected, have).agg(F.count(F.lit(1)).alias("missing"), F.lit(1).alias("_one"))
    out = newest.withColumn("_one", F.lit(1)).join(F.broadcast(missing), "_one").drop("_one")
    start = F.date_add("latest", 1)
    due = start <= end
    return out.select(
        "latest", "missing",
        F.when(due, start).when(F.col("missing") > 0, F.col("latest")).alias("start"),
        F.when(due, F.lit("append")).when(F.col("missing") > 0, F.lit("refill")).otherwise(F.lit("skip")).alias("action"),
    )


def series_breaks(bars: DataFrame, days: int = 21) -> DataFrame:
    """Gaps inside single series."""
    out = bars.withColumn("next_d", F.lead("d").over(W()))
    out = out.withColumn("days", F.datediff("next_d", "d"))
    return out.where(F.col("days") > days).select("code", "d", "next_d", "days")
