"""Scans, loads and writes.

Filters and column lists go to the file scan; tables partitioned by ``adj_type`` or ``d`` are pruned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barscope.operators.clean import head_tail, pick
from barscope.session import written_once


def adj_filter(adj: str | None, asset: str = "stock") -> Column:
    """Adjustment rows to read: index series are stored as 'ind'; an unknown kind means qfq or raw."""
    if asset == "index":
        return F.col("adj_type") == "ind"
    if adj in ("raw", "qfq", "hfq", "ind"):
        return F.col("adj_type") == adj
    return F.col("adj_type").isin("qfq", "raw")


def select_bars(df: DataFrame, codes=None, start=None, end=None, columns: Sequence[str] | None = None,
                adj: str | None = None, asset: str = "stock") -> DataFrame:
    """Bars by codes, date range, adjustment and columns.

    A list of codes becomes part of the scan's filter; codes of a table are joined.
    """
    if adj is not None or asset == "index":
        df = df.where(adj_filter(adj, asset))
    if start is not None:
        df = df.where(F.col("d") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("d") <= F.lit(end).cast("date"))
    if isinstance(codes, DataFrame):
        df = df.join(codes.select("code"), "code", "left_semi")
    elif codes is not None:
        df = df.where(F.col("code").isin(list(codes)))
    return df.select(*columns) if columns else df


def read_bars(spark: SparkSession, path: str, codes=None, start=None, end=None, columns=None, adj=None,
              asset: str = "stock", limit: int | None = None, order: str = "asc") -> DataFrame:
    """Scan of a bar table; with a limit the oldest or newest rows."""
    df = select_bars(spark.read.parquet(path), codes, start, end, columns, adj, asset)
    if limit is None:
        return df
    keys = [F.col("d"), F.col("code")]
    return df.orderBy(*[k.desc() if order == "desc" else k for k in keys]).limit(limit)


def count_bars(df: DataFrame, **filters) -> DataFrame:
    return select_bars(df, **filters).agg(F.count(F.lit(1)).alias("n"))


def read_day(df: DataFrame, day) -> DataFrame:
    return df.where(F.col("d") == F.lit(day).cast("date")).orderBy("code")


def read_range(df: DataFrame, code: str, start=None, end=None, limit: int | None = None) -> DataFrame:
    """One code's range; the first rows for a positive limit, the last for a negative one."""
    out = select_bars(df, [code], start, end)
    return out.orderBy("d") if limit is None else head_tail(out, limit)


def read_parquet_subset(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                        limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df if limit is None else head_tail(df, limit)


def load_table(spark: SparkSession, source, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table from rows, or from JSON, CSV or Parquet files; text formats need a schema."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, (list, tuple)):
        return spark.createDataFrame(source, schema)
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(source)


def parquet_to_csv(spark: SparkSession, src: str, dst: str) -> None:
    spark.read.parquet(src).write.mode("overwrite").option("header", True).csv(dst)


def export_range(df: DataFrame, code: str, dst: str, start=None, end=None) -> None:
    """One code's bars to CSV."""
    select_bars(df, [code], start, end).write.mode("overwrite").option("header", True).csv(dst)


def write(df: DataFrame, path: str, mode: str = "replace", partition_by: Sequence[str] = ()) -> None:
    """Write a table: 'replace' it, or 'append' the columns it already has."""
    spark = df.sparkSession
    if mode == "append":
        have = spark.read.parquet(path).columns
        df = df.select(*[c for c in have if c in df.columns])
    elif mode != "replace":
        raise ValueError(f"unknown mode {mode!r}")
    if partition_by:
        # Rows of a folder come together, and a large folder is still split over several tasks.
        df = df.hint("rebalance", *partition_by)
    df.write.mode("append" if mode == "append" else "overwrite").partitionBy(*partition_by).parquet(path)


def write_folder(df: DataFrame, root: str, name: str, value: str) -> str:
    """Write rows that share one partition value straight into its folder; returns the folder.

    Nothing is shuffled or sorted to bring the folder's rows together.
    """
    path = f"{root.rstrip('/')}/{name}={value}"
    write(df.drop(name), path)
    return path


def save(df: DataFrame, root: str, name: str, partition_by: Sequence[str] = ()) -> str:
    """Write a result table below a root folder; returns its path."""
    path = f"{root.rstrip('/')}/{name}"
    write(df, path, "replace", partition_by)
    return path


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Update the supplied columns where keys match (a supplied null counts), insert the rest.

    With key columns only, existing rows stay as they are.
    """
    names = [c for c in updates.columns if c in target.columns and c not in keys]
    u = updates.select(*keys, F.struct(F.lit(1).alias("_"), *names).alias("_u"))
    both = target.join(u, list(keys), "full_outer")
    given = F.col("_u").isNotNull()
    return both.select(*[
        F.when(given, F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
        for c in target.columns
    ])


def lowest_rank(updates: DataFrame, keys: Sequence[str] = ("code", "d")) -> DataFrame:
    """Rank updates with one row per key, the lowest rank winning."""
    return pick(updates, keys, "rank", F.min_by)


LISTS = ("white", "black")


def write_lists(lists: DataFrame, path: str, days: Sequence | None = None) -> None:
    """White and black lists, one partition per date and list; other dates stay as they are.

    ``days`` are the dates written, by default those with rows. A date's lists are replaced as a whole, also by an empty
    one: each has a row without code, which readers leave out.
    """
    spark = lists.sparkSession
    out = lists.select("code", "period", "reason", F.col("d").cast("date").alias("d"), "list")
    dated = out.select("d").distinct()
    if days is not None:
        dated = spark.createDataFrame([(str(x),) for x in days], "d string").select(F.col("d").cast("date"))
    empty = dated.select(
        *[F.lit(None).cast("string").alias(c) for c in ("code", "period", "reason")], "d", F.explode(F.array(*map(F.lit, LISTS))).alias("list")
    )
    out.join(F.broadcast(dated), "d", "left_semi").unionByName(empty).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("d", "list").parquet(path)


def read_list(spark: SparkSession, path: str, day=None, name: str | None = None) -> DataFrame:
    df = spark.read.schema("code string, period string, reason string, d date, list string").parquet(path)
    if day is not None:
        df = df.where(F.col("d") == F.lit(day).cast("date"))
    if name is not None:
        df = df.where(F.col("list") == name)
    return df.where(F.col("code").isNotNull())


def month_of(d) -> Column:
    """Partition value of a date, YYYYMM."""
    d = F.lit(d).cast("date") if isinstance(d, str) else d
    return F.year(d) * 100 + F.month(d)


def write_ranks(ranks: DataFrame, path: str) -> None:
    """Ranks of many dates as one table, a folder per month."""
    write(ranks.withColumn("ym", month_of(F.col("d"))), path, partition_by=["ym"])


def add_ranks(ranks: DataFrame, path: str) -> None:
    """Put the ranks of some dates into a stored table: these dates are replaced, all others stay.

    Only the months of these dates are read and written again.
    """
    spark = ranks.sparkSession
    # Read four times below, so the ranking behind it runs once.
    new = written_once(ranks.withColumn("ym", month_of(F.col("d"))))
    days = new.select("d", "ym").distinct()
    old = spark.read.parquet(path)
    kept = old.join(days.select("ym").distinct(), "ym", "left_semi").join(days.select("d"), "d", "left_anti")
    both = written_once(kept.select(*new.columns).unionByName(new))  # the files it reads are replaced
    both.hint("rebalance", "ym").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym").parquet(path)


def read_ranks(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Ranks of a date range; months outside it are not read."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("ym") >= month_of(start))
    if end is not None:
        df = df.where(F.col("ym") <= month_of(end))
    return select_bars(df, start=start, end=end).drop("ym")


def ranks_from_details(details: DataFrame) -> DataFrame:
    """Rank table from detail records, for instance JSON files of one record per code and date."""
    from barscope.operators.scoring import rank_scores

    return rank_scores(details.select("code", "d", "score", F.col("tiebreak").alias("j")))


def partition_dates(df: DataFrame) -> DataFrame:
    """Dates a stored table holds; one column is read and combined map-side."""
    return df.select("d").distinct()
