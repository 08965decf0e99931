"""Features of bars against benchmark series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscope.functions.series import W, merged_sums, so_far
from barscope.functions.values import div

FEATURES = ("idx_c", "idx_ret", "ret", "exret", "exret_sum", "rs", "beta", "corr")


def join_benchmark(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Benchmark close and return on each bar; one benchmark row per date, so it is broadcast."""
    b = bench.select("d", F.col("c").alias("idx_c")).withColumn("code", F.lit("bench"))
    b = b.withColumn("idx_ret", div("idx_c", F.lag("idx_c").over(W())) - 1).drop("code")
    return bars.join(F.broadcast(b), "d", "left")


def align(joined: DataFrame, how: str = "ffill", ends: Sequence[str] = ("",)) -> DataFrame:
    """Repeat the last benchmark values over dates without one, or drop such dates."""
    if how == "ffill":
        held = {n: F.last(n, ignorenulls=True).over(so_far()) for e in ends for n in (f"idx_c{e}", f"idx_ret{e}")}
        return joined.withColumns(held)
    return joined.where(reduce(lambda a, b: a & b, [F.col(f"idx_c{e}").isNotNull() for e in ends]))


def benchmark_features(bars: DataFrame, bench: DataFrame, n: int = 20, how: str = "ffill") -> DataFrame:
    """Excess return and its rolling sum, relative strength, beta and correlation."""
    return _features(align(join_benchmark(bars, bench), how), n)


def several_benchmarks(bars: DataFrame, benches: dict[str, DataFrame], n: int = 20, how: str = "ffill") -> DataFrame:
    """The features against each benchmark, under ``<feature>_<name>``.

    With ``drop`` a benchmark only sees the bars whose dates it and all benchmarks before it have: returns are taken over
    these bars, and the result holds those that are left in the end. Otherwise all see the same bars, and share the windows.
    All benchmarks come in one table with a row per date, so it is broadcast, and all windows follow one shuffle of the bars.
    No benchmarks give the bars as they are.
    """
    if not benches:
        return bars
    rows = reduce(DataFrame.unionByName, [b.select(F.lit(name).alias("code"), "d", "c") for name, b in benches.items()])
    rows = rows.withColumn("ret", div("c", F.lag("c").over(W())) - 1)
    of = lambda name, x: F.max(F.when(F.col("code") == name, F.col(x)))
    values = [of(name, x).alias(f"{out}_{name}") for name in benches for x, out in (("c", "idx_c"), ("ret", "idx_ret"))]
    df = bars.join(F.broadcast(rows.groupBy("d").agg(*values)), "d", "left")
    ends = [f"_{name}" for name in benches]
    for together in [ends] if how == "ffill" else [[e] for e in ends]:
        df = _features(align(df, how, together), n, together)
    return df


def _features(df: DataFrame, n: int, ends: Sequence[str] = ("",)) -> DataFrame:
    n, least, given = max(int(n), 1), max(5, n // 3), df.columns
    held = F.last("c", ignorenulls=True).over(so_far())
    df = df.withColumn("_held", held).withColumn("_ret", div("_held", F.lag("_held").over(W())) - 1)
    for e in ends:
        df = df.withColumns({f"ret{e}": F.col("_ret"), f"exret{e}": F.col("_ret") - F.col(f"idx_ret{e}"), f"_ratio{e}": div("c", f"idx_c{e}")})
    sums, pairs = {}, {"_xx": ("_ret", "_ret")}
    for e in ends:
        for x in (f"exret{e}", f"_ratio{e}"):
            sums |= {f"_sum_{x}": F.coalesce(x, F.lit(0.0)), f"_n_{x}": F.col(x).isNotNull().cast("int")}
        pairs |= {f"_yy{e}": (f"idx_ret{e}", f"idx_ret{e}"), f"_xy{e}": ("_ret", f"idx_ret{e}")}
    df = merged_sums(df, n, sums, pairs)
    for e in ends:
        total, mean = (F.when(F.col(f"_n_{x}") >= least, v) for x, v in (
            (f"exret{e}", F.col(f"_sum_exret{e}")), (f"_ratio{e}", F.col(f"_sum__ratio{e}") / F.col(f"_n__ratio{e}"))))
        # A constant window has no correlation. The divisors of covariance and variance cancel.
        xy, yy = F.col(f"_xy{e}"), F.col(f"_yy{e}")
        spread = F.sqrt("_xx") * F.sqrt(yy)
        df = df.withColumns({
            f"exret_sum{e}": total, f"rs{e}": F.col(f"_ratio{e}") / mean,
            f"beta{e}": xy / F.when(yy != 0, yy), f"corr{e}": xy / F.when(spread != 0, spread),
        })
    return df.select(*given, *[f"{x}{e}" for e in ends for x in FEATURES if f"{x}{e}" not in given])
