"""How far back a rule set can look, and the bars that matter for a few dates.

Every part of a rule says how many bars before the reference bar it can see: a scope its window, a condition its own ``back``, a
feature set the number given by ``looks_back``, an indicator its warm-up and, if it averages over all history, as many bars as it takes until older
ones weigh less than ``NEGLIGIBLE``. Looks through each other add up. Week and month bars reach back in days, as their series keep empty
periods. What does not say how far it looks gets the whole history.

From the sum follows a literal first date for the scan. Series with gaps have fewer bars in the same time, so the number of bars is counted:
codes that fall short (a suspended one, say) get their older bars too, all others none.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscope.functions.smoothing import Ewm

NEGLIGIBLE = 1e-13
WIDER = (1, 2, 4, 8)  # spans tried, as multiples of the plain one


@dataclass(frozen=True)
class Reach:
    """Bars and calendar days before the reference bar that can matter; ``bars`` is None for all of them."""

    bars: int | None = 0
    days: int = 0

    def __or__(self, other: Reach) -> Reach:
        """What either of two looks needs."""
        bars = None if self.bars is None or other.bars is None else max(self.bars, other.bars)
        return Reach(bars, max(self.days, other.days))


ALL = Reach(None)


def looks_back(bars: int | None):
    """Declare how many bars before a bar its features depend on."""

    def mark(features: Callable[[DataFrame], DataFrame]):
        features.bars_back = bars
        return features

    return mark


@looks_back(0)
def as_given(df: DataFrame) -> DataFrame:
    """No features but the bars' own columns."""
    return df


def features_back(features: Callable[[DataFrame], DataFrame]) -> int | None:
    return getattr(features, "bars_back", None)


def condition_back(when: Column | str, back: int | None) -> int | None:
    """Bars a condition sees before its bar: as declared, none without a window, unknown with one."""
    if back is not None:
        return back
    text = when if isinstance(when, str) else str(when)
    return None if any(x in text.lower() for x in ("over", "window")) else 0


def averages_back(levels: Sequence[Sequence[Ewm]]) -> int:
    """Bars after which averages of averages have forgotten what was before."""
    alphas = [min(a.alpha for a in level) for level in levels if level]
    if not alphas or min(alphas) >= 1:
        return 0
    keep, n = 1.0 - min(alphas), len(alphas)
    bars = 1
    # Weights of n levels at the slowest rate: binomial(bars + n - 1, n - 1) keep^bars.
    while math.comb(bars + n - 1, n - 1) * keep**bars > NEGLIGIBLE:
        bars += 1
    return bars


def indicators_back(names: Sequence[str]) -> int:
    """Bars the registered indicators look back."""
    from barscope.operators.indicators import REGISTRY

    return max((REGISTRY[n].warmup + averages_back([REGISTRY[n].first, REGISTRY[n].second]) for n in names), default=0)


def rules_reach(rules: Sequence, features: Callable[[DataFrame], DataFrame] = as_given, gates: bool = True) -> Reach:
    """The reach of a rule set over a feature set."""
    from barscope.operators.rules import units_of

    out, below = Reach(), features_back(features)
    for rule in rules:
        for unit, back in units_of(rule, gates):
            if below is None or back is None:
                return ALL
            bars = below + back + unit.window - 1
            if unit.timeframe == "D":
                out |= Reach(bars)
            else:
                # The unfinished period, one more for the period that a window begins in, and the periods looked at.
                out |= Reach(0, (bars + 3) * (7 if unit.timeframe == "W" else 31))
    return out


def day(x) -> dt.date:
    return x if isinstance(x, dt.date) and not isinstance(x, dt.datetime) else x.date() if isinstance(x, dt.datetime) else dt.date.fromisoformat(str(x))


def bars_for(bars: DataFrame, first, last, reach: Reach, every_code: bool = False) -> DataFrame:
    """The bars up to ``last`` that can matter for the dates from ``first`` on.

    The first date of the scan is a literal, chosen among a few by one count of the bars behind each: the fewest bars in all, where codes
    with a bar in the dates asked for (or simply all, with ``every_code``) that lack some count with all of theirs; none lacking any is worth twice
    the bars. Codes that lack some get their older bars in addition.
    """
    first, last = day(first), day(last)
    past = bars.where(F.col("d") <= F.lit(last))
    if reach.bars is None:
        return past
    plain = max(math.ceil(reach.bars * 7 / 5) + 14, reach.days + 7)
    starts = [first - dt.timedelta(days=plain * k) for k in WIDER]
    near = F.col("d") < F.lit(first)

    def enough(start):
        """Bars enough, and one at least as old as the days looked back."""
        inside = near & (F.col("d") >= F.lit(start))
        old = F.max(F.when(inside, F.col("d") <= F.lit(first - dt.timedelta(days=reach.days))))
        return (F.count_if(inside) >= reach.bars) & (F.coalesce(old, F.lit(False)) if reach.bars or reach.days else F.lit(True))

    def wanted():
        return F.lit(True) if every_code else F.max(~near)

    seen = past.where(F.col("d") >= F.lit(starts[-1])).groupBy("code").agg(
        wanted().alias("_w"),
        *[enough(s).alias(f"_e{k}") for k, s in enumerate(starts)],
        *[F.count_if(near & (F.col("d") >= F.lit(s))).alias(f"_n{k}") for k, s in enumerate(starts)],
    )
    lacking = [F.col("_w") & ~F.col(f"_e{k}") for k in range(len(starts))]
    found = seen.agg(
        *[F.count_if(x).alias(f"short{k}") for k, x in enumerate(lacking)],
        *[F.sum(F.when(x, F.col(f"_n{len(starts) - 1}")).otherwise(F.col(f"_n{k}"))).alias(f"bars{k}") for k, x in enumerate(lacking)],
    ).first()
    short = [found[f"short{k}"] for k in range(len(starts))]
    cost = [(found[f"bars{k}"] or 0) * (2 if short[k] else 1) for k in range(len(starts))]
    k = min(range(len(starts)), key=lambda k: (cost[k], k))
    recent = past.where(F.col("d") >= F.lit(starts[k]))
    if not short[k] and not every_code:
        return recent
    older = bars.where(F.col("d") < F.lit(starts[k]))
    of = recent.groupBy("code").agg(wanted().alias("_w"), enough(starts[k]).alias("_e")).where("_w")
    if every_code:
        # Codes without recent bars count as well.
        return recent.unionByName(older.join(of.where("_e").select("code"), "code", "left_anti"))
    return recent.unionByName(older.join(of.where("NOT _e").select("code"), "code", "left_semi"))
