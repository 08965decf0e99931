"""Ranks within groups of any size, by one plan.

A date's cross-section grows with the number of codes, so it is not ranked in one window task. Rows are
dealt by the group and an order-preserving bucket of the sort keys (``steps`` of a number, the first letters of a
code); the place inside the bucket comes from a window there, the rows in earlier buckets from the buckets'
sizes, a small table whose size per group depends on the steps and not on the rows. Both read the same
shuffle. Nothing is counted, written or broadcast beforehand, but for ``previous``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST = float("inf")


def steps(x: Column, size: float | None = None, ascending: bool = True) -> Column:
    """A number's step in the order asked for, missing values last: of a fixed width, or 8 to each doubling."""
    x = x.cast("double")
    if size is None:
        x = F.floor(F.signum(x) * F.log2(F.abs(x) * 2.0**20 + 1) * 8)
    else:
        x = F.floor(x / size)
    x = x.cast("double")
    return F.coalesce(x if ascending else -x, F.lit(LAST))


def letters(x: Column, n: int = 7) -> Column:
    """The first letters of a code."""
    return F.coalesce(F.substring(x, 1, n), F.lit(""))


def _bucketed(df: DataFrame, coarse: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_b{i}" for i in range(len(coarse))]
    return df.withColumns(dict(zip(names, coarse))), names


def _earlier(buckets: DataFrame, by: Sequence[str], names: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """For each bucket the sum over earlier buckets of its group, and further columns over all of them."""
    w = Window.partitionBy(*by).orderBy(*names)
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = buckets.withColumn("_before", before)
    return out.withColumns({n: e.over(whole) for n, e in sums.items()}).select(*by, *names, "_before", *sums)


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], coarse: Sequence[Column], out: str = "rank",
                total: str | None = None) -> DataFrame:
    """Add the 1-based place of each row in its group, and optionally the group's size.

    ``order`` must be a total order within the group; ``coarse`` are its first keys, ascending, all but the last exact and the
    last one in steps or letters.
    """
    rows, names = _bucketed(df, coarse)
    w = Window.partitionBy(*by, *names).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_k": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole)})
    buckets = _earlier(rows.where("_k = 1"), by, names, {total: F.sum("_n")} if total else {})
    rows = rows.join(buckets, [*by, *names])
    return rows.withColumn(out, (F.col("_before") + F.col("_k")).cast("int")).select(*df.columns, out, *([total] if total else []))


TOP = 1000  # as many rows of a group does Spark keep per task before the shuffle


def top_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], coarse: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their place: each task keeps its own first ones, so few rows meet."""
    if n > TOP:
        return rank_within(df, by, order, coarse, out).where(F.col(out) <= n)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= n)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, up: str | None = None, down: str | None = None,
                  total: str | None = None, size: float | None = None) -> DataFrame:
    """Ranks with ties averaged, from the smallest value (``up``) or from the largest (``down``), and the group's size.

    Missing values get the integer part of the highest rank plus one, and so does all of a group without any value.
    """
    # Rows without a value are only counted, so they may lie anywhere.
    anywhere = F.when(F.col(value).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(64))).otherwise(F.lit(0))
    rows, names = _bucketed(df, [steps(F.col(value), size), anywhere])
    w = Window.partitionBy(*by, *names).orderBy(value)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    peers = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    known = F.col(value).isNotNull()
    rows = rows.withColumns({"_k": F.row_number().over(w), "_mean": F.rank().over(w) + (peers - 1) / 2})
    rows = rows.withColumns({"_n": F.count(value).over(whole), "_low": F.min("_mean").over(whole), "_high": F.max("_mean").over(whole), "_rows": F.count(F.lit(1)).over(whole)})
    buckets = rows.where(F.col("_k") == 1).withColumn("_edges", F.when(known, F.struct(F.col("_b0").alias("at"), "_low", "_high", "_n")))
    sums = {"_size": F.sum("_n"), "_first": F.min("_edges"), "_last": F.max("_edges")}
    sums |= {total: F.sum("_rows")} if total else {}
    rows = rows.join(_earlier(buckets, by, names, sums), [*by, *names])
    mean, size = F.col("_before") + F.col("_mean"), F.col("_size")
    highest = {
        "up": size - F.col("_last._n") + F.col("_last._high"),
        "down": size + 1 - F.col("_first._low"),
    }
    for name, side in ((up, "up"), (down, "down")):
        if name:
            rank = mean if side == "up" else size + 1 - mean
            missing = F.floor(F.coalesce(highest[side], F.lit(0.0))) + 1
            rows = rows.withColumn(name, F.when(known, rank).otherwise(missing.cast("double")))
    return rows.select(*df.columns, *[n for n in (up, down, total) if n])


PARTS = 1000  # a key of many rows is cut into this many parts at most


def previous(df: DataFrame, key: str, order: str, name: str, size: int = 1 << 20, copies: Sequence[str] = ()) -> DataFrame:
    """Add ``_previous``: the value of the preceding row of the key, for keys with any number of rows.

    Neighbours of the same order that agree in all of ``copies``, if any are named, share what precedes the first of them.
    Rows without an order come last, those without a key are left out. The rows of each key are counted first, which reads
    only the key. One shuffle by key brings all rows together; keys of more than ``size`` rows, of which there are few, are
    cut at quantiles of their order and put together from the ends of their parts.
    """
    df = df.where(F.col(key).isNotNull())
    many = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size).collect()

    def by_key(some: DataFrame) -> DataFrame:
        return _preceded(some, [key], order, name, copies).select(*df.columns, F.col("_before.v").alias("_previous"))

    if not many:
        return by_key(df)
    large = F.col(key).isin([r[key] for r in many])
    parts = min(-(-max(r["_n"] for r in many) // int(size)), PARTS)
    return by_key(df.where(~large)).unionByName(_previous_in_parts(df.where(large), key, order, name, copies, parts))


def _preceded(df: DataFrame, keys: Sequence[str], order: str, name: str, copies: Sequence[str]) -> DataFrame:
    """Add the place ``_k`` and, in ``_before``, the place of the row's first copy and the value before that."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())
    before = F.struct(F.col("_k").alias("k"), F.col("_value").alias("v"))
    df = df.withColumns({"_k": F.row_number().over(w), "_value": F.lag(name).over(w)})
    if not copies:
        return df.withColumn("_before", before)
    same = [order, *copies]
    df = df.withColumns({f"_last_{x}": F.lag(x).over(w) for x in same})
    copy = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"_last_{x}")) for x in same])
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_before", F.last(F.when((F.col("_k") == 1) | ~copy, before), ignorenulls=True).over(so_far))


def _previous_in_parts(df: DataFrame, key: str, order: str, name: str, copies: Sequence[str], parts: int) -> DataFrame:
    cuts = df.groupBy(key).agg(F.percentile_approx(order, [i / parts for i in range(1, parts)]).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda cut: cut <= F.col(order)))
    part = F.when(F.col(order).isNull(), F.lit(parts)).otherwise(part)
    rows = _preceded(df.join(F.broadcast(cuts), key).withColumn("_b", part), [key, "_b"], order, name, copies)
    whole = Window.partitionBy(key, "_b").orderBy(F.col(order).asc_nulls_last())
    whole = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = F.lag("_end").over(Window.partitionBy(key).orderBy("_b"))
    edges = rows.withColumn("_end", F.last(name).over(whole)).where("_k = 1").select(key, "_b", edge.alias("_edge"))
    value = F.when(F.col("_before.k") == 1, F.col("_edge")).otherwise(F.col("_before.v"))
    return rows.join(edges, [key, "_b"]).select(*df.columns, value.alias("_previous"))
