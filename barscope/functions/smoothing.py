"""Exponentially weighted averages over the full history, without a recursive scan.

The average at bar ``t`` is a ratio of weighted sums, and the weights depend on ``t`` only through
a common factor that cancels.  So both sums are running window sums of ``x * w**-p`` over blocks of
bars, where ``p`` is the place in the block; blocks keep the powers in range, and what reaches back
further than the blocks taken along is below double precision.  Everything stays in window
operators: one shuffle by code, two sorts, whatever the number of averages.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscope.functions.series import W, last_n
from barscope.functions.values import col

MAX_DIGITS = 140  # powers stay below 1e140 within a block
NEGLIGIBLE_DIGITS = 22  # weights below 1e-22 cannot change a double


@dataclass(frozen=True)
class Ewm:
    """One average: ``out`` is its column name, ``x`` the input column name.

    ``adjust`` divides by the sum of all weights; otherwise the first value seeds the recursion and
    each later one enters with weight ``alpha`` (renormalised across gaps).  ``mask`` leaves rows
    without input missing; otherwise they repeat the last average.
    """

    out: str
    x: str
    alpha: float
    adjust: bool = False
    mask: bool = True


def ema(out: str, x: str, n: int) -> Ewm:
    return Ewm(out, x, 2.0 / (n + 1.0))


def sma(out: str, x: str, n: int, m: int = 1) -> Ewm:
    return Ewm(out, x, m / n)


def block_size(averages: Sequence[Ewm]) -> int:
    """Rows per block for which the powers of all averages stay in range."""
    return max(1, min([int(MAX_DIGITS / _digits(a)) for a in averages if a.alpha < 1.0] or [1]))


def _digits(a: Ewm) -> float:
    return -math.log10(1.0 - a.alpha)


def place(df: DataFrame, size: int) -> DataFrame:
    """Number the bars of each series from zero and cut them into blocks."""
    df = df.withColumn("_rn", F.row_number().over(W()) - 1)
    return df.withColumns(
        {"_blk": F.floor(F.col("_rn") / size), "_p": (F.col("_rn") % size).cast("double")}
    )


def with_ewm(df: DataFrame, averages: Sequence[Ewm]) -> DataFrame:
    """Add the averages as columns."""
    keep = [*df.columns, *[a.out for a in averages if a.out not in df.columns]]
    size = block_size(averages)
    return smooth(place(df, size), averages, size).select(*keep)


def smooth(df: DataFrame, averages: Sequence[Ewm], size: int, seeded: bool = False) -> DataFrame:
    """The averages over bars already placed in blocks; several levels share one sort.

    With ``seeded`` an input may be an average itself, that of all earlier bars: ``_wt_<out>`` is the weight of the input (1 for
    plain bars), ``_lag_<out>`` how many bars before this one the last of these lay (0 for plain bars).
    """
    moving = [(i, a) for i, a in enumerate(averages) if a.alpha < 1.0]
    if moving:
        df = _blocked(df, moving, size, seeded)
    plain = {a.out: col(a.x) for a in averages if a.alpha >= 1.0}
    if plain:
        df = df.withColumns(plain)
    held = {
        a.out: F.last(a.out, ignorenulls=True).over(_line().rowsBetween(Window.unboundedPreceding, 0))
        for a in averages
        if not a.mask
    }
    return df.withColumns(held) if held else df


def _line():
    # Same physical sort as the blocks: within a code, they follow each other in date order.
    return Window.partitionBy("code").orderBy("_blk", "d")


def _blocked(df: DataFrame, moving: list[tuple[int, Ewm]], size: int, seeds: bool = False) -> DataFrame:
    blocks = Window.partitionBy("code", "_blk").orderBy("d")
    so_far = blocks.rowsBetween(Window.unboundedPreceding, 0)
    whole = blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = _line()
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    base = df.columns
    valid = {i: F.col(a.x).isNotNull() for i, a in moving}
    at = {i: F.col("_rn") - F.col(f"_lag_{a.out}") if seeds else F.col("_rn") for i, a in moving}
    seeded = [(i, a) for i, a in moving if not a.adjust]
    if seeded:
        df = df.withColumns({
            f"_prev{i}": F.last(F.when(valid[i], at[i]), ignorenulls=True).over(earlier)
            for i, a in seeded
        })
        # Log of the renormalisation after a gap of k rows; zero where there is none.
        gaps = {}
        for i, a in seeded:
            k = F.col("_rn") - F.col(f"_prev{i}")
            g = F.log(F.pow(F.lit(1.0 - a.alpha), k) + F.lit(a.alpha))
            gaps[f"_g{i}"] = F.when(valid[i] & (k > 1), g).otherwise(F.lit(0.0))
        df = df.withColumns(gaps)
        df = df.withColumns({f"_gap{i}": F.sum(f"_g{i}").over(so_far) for i, a in seeded})
    weights = {}
    for i, a in moving:
        wgt = F.pow(F.lit(1.0 - a.alpha), -F.col("_p"))
        if not a.adjust:
            first = F.when(F.col(f"_prev{i}").isNull(), F.lit(1.0)).otherwise(F.lit(a.alpha))
            wgt = first * wgt * F.exp(F.col(f"_gap{i}") - F.col(f"_g{i}"))
        weights[f"_w{i}"] = F.when(valid[i], wgt * F.col(f"_wt_{a.out}") if seeds else wgt)
    df = df.withColumns(weights)
    sums = {}
    for i, a in moving:
        wx, w1 = F.col(f"_w{i}") * F.col(a.x), F.col(f"_w{i}")
        sums |= {
            f"_num{i}": F.sum(wx).over(so_far),
            f"_den{i}": F.sum(w1).over(so_far),
            f"_allnum{i}": F.sum(wx).over(whole),
            f"_allden{i}": F.sum(w1).over(whole),
        }
        if not a.adjust:
            sums[f"_allgap{i}"] = F.sum(f"_g{i}").over(whole)
    df = df.withColumns(sums)
    values = {}
    for i, a in moving:
        num, den, decay = F.col(f"_num{i}"), F.col(f"_den{i}"), F.lit(1.0)
        for j in range(1, math.ceil(NEGLIGIBLE_DIGITS / (size * _digits(a))) + 1):
            # A block is exactly ``size`` rows, so its totals are found that many rows back.
            def back(name, j=j):
                return F.coalesce(F.lag(name, j * size).over(line), F.lit(0.0))

            if not a.adjust:
                decay = decay * F.exp(-back(f"_allgap{i}"))
            carry = F.lit((1.0 - a.alpha) ** (j * size)) * decay
            num, den = num + carry * back(f"_allnum{i}"), den + carry * back(f"_allden{i}")
        values[a.out] = F.when(valid[i], num / den)
    return df.withColumns(values).select(*base, *[a.out for _, a in moving if a.out not in base])


def ewm_seeded(x, alpha: float, rows: int) -> Column:
    """The recursion started afresh ``rows`` bars back, for parity with sliced histories.

    The bars fit a bounded frame, so this is a fold over at most ``rows`` values.
    """
    t = F.row_number().over(W())
    obs = F.when(col(x).isNotNull(), F.struct(t.cast("double").alias("t"), col(x).alias("x")))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("t"))

    def step(acc, e):
        old = F.pow(F.lit(1.0 - alpha), e["t"] - acc["t"])
        y = (old * acc["y"] + alpha * e["x"]) / (old + alpha)
        return F.struct(F.coalesce(y, e["x"]).alias("y"), e["t"].alias("t"))

    folded = F.aggregate(F.collect_list(obs).over(last_n(rows)), start, step)
    return F.when(col(x).isNotNull(), folded["y"])
