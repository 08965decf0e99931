"""Registered indicators: input columns, recursive averages in up to two levels, a final value.

Indicators asked for together share their inputs and are smoothed together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscope.functions import series as ts
from barscope.functions.smoothing import Ewm, block_size, ema, place, sma, smooth
from barscope.functions.values import rnd, safe_div
from barscope.operators.clean import keep_last, newest, union_bars

KDJ_EPS = 1e-9  # fixed value: replaces a zero range


@dataclass(frozen=True)
class Indicator:
    """``first`` and ``second`` are levels of averages; with them ``value`` only combines columns."""

    out: str
    value: Callable[[], Column]
    warmup: int = 0
    decimals: int = 2
    inputs: dict[str, Callable[[], Column]] = field(default_factory=dict)
    first: tuple[Ewm, ...] = ()
    second: tuple[Ewm, ...] = ()


REGISTRY: dict[str, Indicator] = {}


def register_indicator(name: str, indicator: Indicator) -> None:
    REGISTRY[name] = indicator


def _raw_rsv() -> Column:
    low = ts.llv("l", 9)
    span = ts.hhv("h", 9) - low
    return 100 * (F.col("c") - low) / F.when(span == 0, F.lit(KDJ_EPS)).otherwise(span)


def _change() -> Column:
    return F.col("c") - ts.ref("c", 1)


def _up() -> Column:
    d = _change()
    return F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))


register_indicator("kdj", Indicator(
    "j", lambda: 3 * F.col("_k") - 2 * F.col("_dd"), 10, 2, {"_rsv": _raw_rsv},
    (Ewm("_k", "_rsv", 1 / 3, adjust=True, mask=False),),
    (Ewm("_dd", "_k", 1 / 3, adjust=True, mask=False),),
))
register_indicator("volume_ratio", Indicator("vr", lambda: safe_div("v", ts.ma("v", 20)), 20, 4))
register_indicator("volume_ratio_prev", Indicator("vr_prev", lambda: safe_div("v", ts.ref("v", 1)), 2, 4))
register_indicator("bbi", Indicator(
    "bbi", lambda: (ts.ma("c", 3) + ts.ma("c", 6) + ts.ma("c", 12) + ts.ma("c", 24)) / 4, 24, 2,
))
register_indicator("rsi", Indicator(
    "rsi", lambda: safe_div("_rs_up", F.col("_rs_abs")) * 100, 12, 2,
    {"_up": _up, "_abs": lambda: F.abs(_change())},
    (sma("_rs_up", "_up", 12), sma("_rs_abs", "_abs", 12)),
))
register_indicator("diff", Indicator(
    "diff", lambda: F.col("_ema12") - F.col("_ema26"), 26, 2, {},
    (ema("_ema12", "c", 12), ema("_ema26", "c", 26)),
))


def cci(n: int = 14) -> Column:
    """Commodity channel index (a helper, not registered)."""
    tp = (F.col("h") + F.col("l") + F.col("c")) / 3
    return (tp - ts.ma(tp, n)) / F.nullif(0.015 * ts.mean_abs_dev(tp, n), F.lit(0.0))


def with_indicators(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add registered indicators; the first ``warmup`` bars of a series stay missing.

    Plain windows and the inputs of averages come first, then the averages level by level over one
    further sort, then arithmetic only.
    """
    chosen = [REGISTRY[n] for n in names]
    base = [c for c in df.columns if c not in {i.out for i in chosen}]
    early = {n: fn() for ind in chosen for n, fn in ind.inputs.items()}
    early |= {f"_raw_{i.out}": i.value() for i in chosen if not i.first}
    averages = [a for i in chosen for a in (*i.first, *i.second)]
    size = block_size(averages)
    out = place(df.withColumns(early) if early else df, size)
    for level in ("first", "second"):
        step = [a for i in chosen for a in getattr(i, level)]
        out = smooth(out, step, size) if step else out
    return out.select(*base, *[
        F.when(
            F.col("_rn") >= i.warmup, rnd(i.value() if i.first else F.col(f"_raw_{i.out}"), i.decimals)
        ).alias(i.out)
        for i in chosen
    ])


def indicators_incremental(history: DataFrame, new: DataFrame, names: Sequence[str]) -> DataFrame:
    """Indicators of the new bars, warmed up on each series' latest history; a new bar replaces an
    old one of the same date."""
    rows = max(REGISTRY[n].warmup for n in names) + 10
    starts = new.groupBy("code").agg(F.min("d").alias("_from"))
    old = history.join(starts, "code").where(F.col("d") < F.col("_from")).drop("_from")
    both = union_bars(
        newest(old, rows).withColumn("_new", F.lit(0)), new.withColumn("_new", F.lit(1))
    )
    both = keep_last(both, ["code", "d"], "_new")
    return with_indicators(both, names).where(F.col("_new") == 1).drop("_new")

