"""Status of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars_status(bars: DataFrame) -> DataFrame:
    """Per adjustment type: date range, rows and codes; the row without type is the total.

    Distinct codes are counted from (type, code) pairs, which combine before the shuffle.
    """
    pairs = bars.groupBy("adj_type", "code").agg(
        F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    def summed(df, *keys):
        return df.groupBy(*keys).agg(
            F.min("lo").alias("min_d"), F.max("hi").alias("max_d"), F.sum("n").alias("rows"),
            F.countDistinct("code").alias("codes"),
        )

    total = summed(pairs).withColumn("adj_type", F.lit("total"))
    return summed(pairs, "adj_type").unionByName(total)


def details_status(details: DataFrame) -> DataFrame:
    """Rows, codes, dates and range; each count combines map-side over one narrow column."""
    one = F.lit(1).alias("_one")
    codes = details.groupBy("code").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("codes"), one
    )
    dates = details.select("d").distinct().agg(
        F.count(F.lit(1)).alias("dates"), F.min("d").alias("first"), F.max("d").alias("last"), one
    )
    return codes.join(F.broadcast(dates), "_one").drop("_one")


def stock_summary(details: DataFrame) -> DataFrame:
    """Per code: days scored, range and mean of scores and ranks."""
    return details.groupBy("code").agg(
        F.count(F.lit(1)).alias("total_days"), F.min("d").alias("first_date"), F.max("d").alias("last_date"),
        F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        F.avg("rank").alias("avg_rank"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"),
    )


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).distinct()


def describe_schema(df: DataFrame) -> DataFrame:
    """Columns, types and the row count."""
    rows = df.sparkSession.createDataFrame(
        [(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "pos int, column string, type string"
    )
    n = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("_one", F.lit(1))
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one").drop("_one")


def status_diff(saved: DataFrame, current: DataFrame, key: str = "adj_type") -> DataFrame:
    """Fields that differ between two status tables, with both values as text."""
    def long(df: DataFrame, side: str) -> DataFrame:
        names = [c for c in df.columns if c != key]
        pairs = [F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias(side)) for n in names]
        return df.select(key, F.inline(F.array(*pairs)))

    both = long(saved, "saved").join(long(current, "current"), [key, "field"], "full_outer")
    return both.where(~F.col("saved").eqNullSafe(F.col("current")))


def details_by_stock(details: DataFrame, code: str, n: int | None = None) -> DataFrame:
    """Newest records of one code."""
    out = details.where(F.col("code") == code).orderBy(F.col("d").desc())
    return out.limit(n) if n else out


def details_by_date(details: DataFrame, day, n: int | None = None) -> DataFrame:
    """Records of one date by score; all, or the best ``n``."""
    out = details.where(F.col("d") == F.lit(day).cast("date")).orderBy(F.col("score").desc(), F.col("rank"))
    return out.limit(n) if n else out


def details_score_range(details: DataFrame, day, lo: float, hi: float) -> DataFrame:
    return details_by_date(details, day).where(F.col("score").between(lo, hi))


def details_top(details: DataFrame, day, k: int) -> DataFrame:
    return details_by_date(details, day, k)


def latest_codes(df: DataFrame) -> DataFrame:
    newest = df.agg(F.max("d").alias("d"))
    return df.join(F.broadcast(newest), "d", "left_semi").select("code").distinct()
