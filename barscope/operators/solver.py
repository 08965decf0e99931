"""Prices at which a registered indicator reaches a target on the next bar.

Each indicator's next value is a closed form of the state after the last bar and the candidate
close; the other prices scale with it.  A code is one row, and the search is a fold in that row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscope.functions import series as ts
from barscope.functions.series import so_far
from barscope.functions.smoothing import Ewm, ema, sma, with_ewm
from barscope.functions.values import EPS
from barscope.operators.clean import last_bars
from barscope.operators.indicators import KDJ_EPS, REGISTRY

GRID_POINTS, GRID_RANGE = 50, 0.2  # fixed values
BOUND_LOW, BOUND_HIGH = 0.5, 2.0  # fixed values: allowed close relative to the last one
BISECTIONS = 60
W3 = 2 / 3  # decay of the kdj averages


@dataclass(frozen=True)
class NextValue:
    """State columns after the last bar, and the indicator at a candidate close."""

    state: Callable[[DataFrame], DataFrame]
    value: Callable[[Column], Column]


def _bbi_state(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_s{n}": ts.sum_n("c", n - 1) for n in (3, 6, 12, 24)})


def _bbi(x: Column) -> Column:
    return sum((F.col(f"_s{n}") + x) / n for n in (3, 6, 12, 24)) / 4


def _diff_state(df: DataFrame) -> DataFrame:
    return with_ewm(df, [ema("_e12", "c", 12), ema("_e26", "c", 26)])


def _diff(x: Column) -> Column:
    def step(state: str, n: int) -> Column:
        a = 2.0 / (n + 1.0)
        return (1.0 - a) * F.col(state) + a * x

    return step("_e12", 12) - step("_e26", 26)


def _rsi_state(df: DataFrame) -> DataFrame:
    d = F.col("c") - ts.ref("c", 1)
    df = df.withColumns({"_up": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "_abs": F.abs(d)})
    return with_ewm(df, [sma("_su", "_up", 12), sma("_sa", "_abs", 12)])


def _rsi(x: Column) -> Column:
    a, d = 1 / 12, x - F.col("c")
    up = (1 - a) * F.col("_su") + a * F.greatest(d, F.lit(0.0))
    size = (1 - a) * F.col("_sa") + a * F.abs(d)
    return up / (size + EPS) * 100


def _kdj_state(df: DataFrame) -> DataFrame:
    # Needs complete prices: the sum of weights then follows from the number of bars alone.
    from barscope.operators.indicators import _raw_rsv

    df = df.withColumns({"_low": ts.llv("l", 8), "_high": ts.hhv("h", 8), "_rsv": _raw_rsv()})
    df = with_ewm(df, [Ewm("_k", "_rsv", 1 / 3, adjust=True, mask=False)])
    df = with_ewm(df, [Ewm("_dd", "_k", 1 / 3, adjust=True, mask=False)])
    n = F.count("_rsv").over(so_far())
    return df.withColumn("_den", (1 - F.pow(F.lit(W3), n)) / (1 - W3))


def _kdj(x: Column) -> Column:
    ratio = x / F.col("c")
    low, high = F.least("_low", F.col("l") * ratio), F.greatest("_high", F.col("h") * ratio)
    span = high - low
    rsv = 100 * (x - low) / F.when(span == 0, F.lit(KDJ_EPS)).otherwise(span)

    def step(state: Column, new: Column) -> Column:
        return (state * F.col("_den") * W3 + new) / (F.col("_den") * W3 + 1)

    k = step(F.col("_k"), rsv)
    return 3 * k - 2 * step(F.col("_dd"), k)


NEXT: dict[str, NextValue] = {
    "bbi": NextValue(_bbi_state, _bbi),
    "diff": NextValue(_diff_state, _diff),
    "rsi": NextValue(_rsi_state, _rsi),
    "kdj": NextValue(_kdj_state, _kdj),
}


def next_value(indicator: str) -> NextValue:
    """Only registered indicators that depend on the price can be solved for."""
    if indicator not in REGISTRY or indicator not in NEXT:
        raise ValueError(f"no closed form for indicator {indicator!r}")
    return NEXT[indicator]


def last_state(bars: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """What the closed forms of the indicators need, in the row of each code's last bar."""
    df = bars.select("code", "d", "o", "h", "l", "c", "v")
    for name in indicators:
        df = next_value(name).state(df)
    return last_bars(df)


def candidate_prices(c, points: int = GRID_POINTS, span: float = GRID_RANGE) -> Column:
    """Evenly spaced closes around the last one, as an array in its row."""
    c = F.col(c) if isinstance(c, str) else c
    lo = F.greatest(c * BOUND_LOW, c - c * span)
    hi = F.least(c * BOUND_HIGH, c + c * span)
    step = (hi - lo) / (points - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: lo + i * step)


def solved(state: DataFrame, indicators: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Prices for rows of ``last_state`` that say what they want: indicator, target, tolerance and method (grid, bisect).

    A row may ask for any of the indicators; one that asks for another gets no price. The grid takes the price whose value is nearest the target,
    the first of equals; bisection is for indicators that rise with the close.
    """
    target, tolerance = F.col("target"), F.col("tolerance")

    def value(x):
        out = F.lit(None).cast("double")
        for name in indicators:
            out = F.when(F.col("indicator") == name, NEXT[name].value(x)).otherwise(out)
        return out

    tried = F.transform(
        candidate_prices("c"),
        lambda x, i: F.struct(F.abs(value(x) - target).alias("error"), i.alias("i"), x.alias("price")),
    )
    grid = F.array_min(F.filter(tried, lambda t: t["error"].isNotNull()))["price"]

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        low = value(mid) < target
        done = acc["hi"] - acc["lo"] <= tolerance
        return F.struct(
            F.when(~done & low, mid).otherwise(acc["lo"]).alias("lo"),
            F.when(~done & ~low, mid).otherwise(acc["hi"]).alias("hi"),
        )

    start = F.struct((F.col("c") * BOUND_LOW).alias("lo"), (F.col("c") * BOUND_HIGH).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve)
    found = F.when(F.col("indicator").isin(*indicators), (found["lo"] + found["hi"]) / 2)
    df = state.withColumn("price", F.when(F.col("method") == "grid", grid).otherwise(found))
    df = df.withColumn("value", value(F.col("price"))).withColumn("error", F.abs(F.col("value") - target))
    return df.select(
        "code", *keep, "d", "c", "price", "value", "error", F.coalesce(F.col("error") < tolerance, F.lit(False)).alias("converged")
    )


def _for_all(bars, indicator, target, tolerance, method) -> DataFrame:
    want = {"indicator": F.lit(indicator), "target": F.lit(float(target)), "tolerance": F.lit(float(tolerance)), "method": F.lit(method)}
    return solved(last_state(bars, [indicator]).withColumns(want), [indicator])


def reverse_price_grid(bars: DataFrame, indicator: str, target: float, tolerance: float = 1e-6) -> DataFrame:
    """The grid price whose indicator is nearest the target; the first of equals."""
    return _for_all(bars, indicator, target, tolerance, "grid")


def reverse_price_bisect(bars: DataFrame, indicator: str, target: float, tolerance: float = 1e-6) -> DataFrame:
    """Bisection on the close, for indicators that rise with it."""
    return _for_all(bars, indicator, target, tolerance, "bisect")


def reverse_prices(bars: DataFrame, wanted: DataFrame, indicators: Sequence[str] | None = None) -> DataFrame:
    """Prices for the codes of ``wanted`` (code, indicator, target, tolerance, method), each on its own terms.

    ``indicators`` are those that may be asked for, all that can be solved unless given; their states take one pass.
    """
    names = list(NEXT if indicators is None else indicators)
    return solved(last_state(bars, names).join(wanted, "code"), names)
