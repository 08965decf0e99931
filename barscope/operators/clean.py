"""Cleaning of raw bars, and filters over codes and dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscope.functions.series import W
from barscope.functions.values import col, parse_day, rnd, to_number
from barscope.operators.ranking import previous

# The numeric columns of the stored tables.
NUMERIC = (
    "o", "h", "l", "c", "pre_close", "change", "pct_chg", "v", "amount", "tor",
    "total_share", "float_share", "total_mv", "circ_mv",
)


def normalize_date(df: DataFrame, name: str = "d") -> DataFrame:
    """Strict YYYYMMDD text to dates; rows that do not parse are dropped."""
    return df.withColumn(name, parse_day(name)).dropna(subset=[name])


FIXED_WIDTH = ("double", "float", "bigint", "int", "smallint", "tinyint", "boolean", "date", "timestamp", "timestamp_ntz")


def pick(df: DataFrame, keys: Sequence[str], order: str, by=F.max_by) -> DataFrame:
    """One row per key, chosen by the greatest (or, with ``min_by``, least) ``order``.

    An aggregation rather than a row number: copies combine before the shuffle, however many.
    Columns of fixed width are picked one by one, so the aggregation hashes and need not sort.
    """
    rest = [c for c in df.columns if c not in keys]
    if all(t in FIXED_WIDTH or t.startswith("decimal") for c, t in df.dtypes if c in rest):
        out = df.groupBy(*keys).agg(*[by(c, order).alias(c) for c in rest])
    else:
        out = df.groupBy(*keys).agg(by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")
    return out.select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one that arrived last."""
    return pick(df, keys, order)


def _numeric(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    if "turnover_rate" in df.columns:
        df = df.withColumnRenamed("turnover_rate", "tor")
    if "tor" not in df.columns:
        df = df.withColumn("tor", F.lit(None).cast("double"))
    return df.withColumns(
        {n: rnd(to_number(n), decimals.get(n, 2)) for n in NUMERIC if n in df.columns}
    )


def fill_changes(df: DataFrame, prev_close: str | None = None) -> DataFrame:
    """Fill pre_close, change and pct_chg where missing; present values stay as they are.

    The previous close is that of the preceding bar, unless a column already holds it.
    """
    prev = F.lag("c").over(W()) if prev_close is None else F.col(prev_close)
    for name in ("pre_close", "change", "pct_chg"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    df = df.withColumn("pre_close", F.coalesce("pre_close", prev))
    df = df.withColumn("change", F.coalesce("change", F.col("c") - F.col("pre_close")))
    pct = F.col("change") / F.nullif(F.col("pre_close"), F.lit(0.0)) * 100
    return df.withColumn("pct_chg", F.coalesce("pct_chg", pct))


def clean_bars(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Numbers from text, rounding, last row per date, then the change columns.

    ``seq`` gives the order of arrival.
    """
    df = normalize_date(_numeric(df, {"pct_chg": 4}))
    return fill_changes(keep_last(df, ["code", "d"], seq).drop(seq))


def clean_index_bars(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Index bars: two decimals throughout, and changes filled in order of arrival before dedupe."""
    # Dates are parsed once, before the shuffle; rows without one still are the previous row of another.
    df = previous(_numeric(df, {}).withColumn("d", parse_day("d")), "code", seq, "c", copies=["d"])
    df = fill_changes(df, "_previous").drop("_previous")
    return keep_last(df.dropna(subset=["d"]), ["code", "d"], seq).drop(seq)


def to_storage(df: DataFrame, adj: str) -> DataFrame:
    """Stored column order: key columns first, helper columns dropped."""
    df = df.drop("seq", "name").withColumn("adj_type", F.lit(adj))
    head = ["code", "d", "adj_type"]
    return df.select(*head, *[c for c in df.columns if c not in head])


def ingest_day(bars: DataFrame, basics: DataFrame) -> DataFrame:
    """Daily bars with the turnover of the same day where there is one."""
    return bars.join(basics.select("code", "d", "tor"), ["code", "d"], "left")


def attach_basics(symbols: DataFrame, basics: DataFrame) -> DataFrame:
    """Latest share counts and market values on the symbol list."""
    latest = keep_last(basics, ["code"], "d").drop("d")
    return symbols.join(latest, "code", "left")


def tail_window(df: DataFrame, ref: Column | str, n: int) -> DataFrame:
    """The last ``n`` bars of each code up to the reference date."""
    ref = F.lit(ref).cast("date") if isinstance(ref, str) else ref
    back = Window.partitionBy("code").orderBy(F.col("d").desc())
    return (
        df.where(F.col("d") <= ref)
        .withColumn("_k", F.row_number().over(back))
        .where(F.col("_k") <= n)
        .drop("_k")
    )


def apply_universe(df: DataFrame, universe, lists: DataFrame | None = None) -> DataFrame:
    """Keep the codes of a universe: 'all', the name of a list, a sequence or a DataFrame of codes.

    Lists with dates (``d``) hold for those dates only. 'attention' takes category lists (``end_d``, ``code``), on each date
    the newest that has ended by then.
    """
    if isinstance(universe, DataFrame):
        keys = ["code", "d"] if "d" in universe.columns and "d" in df.columns else ["code"]
        return df.join(universe.select(*keys).distinct(), keys, "left_semi")
    if not isinstance(universe, str):
        return df.where(F.col("code").isin(list(universe)))
    if universe == "all":
        return df
    if universe == "attention":
        # One row per date and list end: bounded like the calendar.
        ends = lists.select(F.col("end_d").alias("d"), F.col("end_d")).distinct()
        days = df.select("d").distinct().withColumn("end_d", F.lit(None).cast("date")).unionByName(ends)
        newest = F.last("end_d", ignorenulls=True).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
        days = days.groupBy("d").agg(F.max("end_d").alias("end_d")).withColumn("end_d", newest).where("end_d IS NOT NULL")
        listed = lists.select("end_d", "code").distinct().join(F.broadcast(days), "end_d").select("code", "d")
        return df.join(listed, ["code", "d"], "left_semi")
    return apply_universe(df, lists.where(F.col("list") == universe))


def codes_on(df: DataFrame, day) -> DataFrame:
    """Codes that traded on a date."""
    return df.where(F.col("d") == F.lit(day).cast("date")).select("code").distinct()


def union_bars(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def code_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    # Both sides combine to one row per code before they are shuffled.
    return a.select("code").distinct().join(b.select("code").distinct(), "code", "left_anti")


def code_common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("code").intersect(b.select("code"))


def merge_prefer_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both sides; on a common key the new value wins wherever it is present."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, list(keys), "full_outer")
    names = [*old.columns, *[c for c in new.columns if c not in old.columns]]
    out = []
    for c in names:
        if c in keys:
            out.append(F.col(c))
        elif c in old.columns and c in new.columns:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def newest(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` bars of each code."""
    back = Window.partitionBy("code").orderBy(F.col("d").desc())
    return df.withColumn("_k", F.row_number().over(back)).where(F.col("_k") <= n).drop("_k")


def last_bars(df: DataFrame) -> DataFrame:
    """The last bar of each code."""
    return keep_last(df, ["code"], "d")


def head_tail(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows by date and code, or the last ones if it is negative."""
    keys = [k for k in ("d", "code") if k in df.columns]
    if limit >= 0:
        return df.orderBy(*keys).limit(limit)
    return df.orderBy(*[F.col(k).desc() for k in keys]).limit(-limit)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sort_ranked(df: DataFrame) -> DataFrame:
    """Score descending, tiebreak ascending with missing last, then code."""
    return df.orderBy(F.col("score").desc(), F.col("j").asc_nulls_last(), F.col("code"))


def restrict_codes(bars: DataFrame, codes: DataFrame) -> DataFrame:
    """Bars of the listed codes."""
    return bars.join(codes.select("code").distinct(), "code", "inner")


def missing_codes(expected: DataFrame, bars: DataFrame, day) -> DataFrame:
    """Expected codes without a bar on the date."""
    return code_diff(expected, codes_on(bars, day))


def prev_day_pairs(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars whose code also traded on the calendar's previous date, with that day's close.

    The pair is two neighbouring bars of one series, so a window replaces the self-join.
    """
    b = bars.join(F.broadcast(calendar), "d")
    pair = b.withColumns({"_i": F.lag("idx").over(W()), "prev_c": F.lag("c").over(W())})
    return pair.where(F.col("_i") == F.col("idx") - 1).drop("_i")


def join_hits_prices(hits: DataFrame, prices: DataFrame) -> DataFrame:
    return hits.join(prices, ["code", "d"], "inner")


def join_map(df: DataFrame, mapping: DataFrame, key: str, name: str) -> DataFrame:
    """Look up text by key; no entry gives empty text."""
    out = df.join(mapping.select(key, name), key, "left")
    return out.withColumn(name, F.coalesce(col(name), F.lit("")))
