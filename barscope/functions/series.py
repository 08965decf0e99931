"""Trailing-window functions per code, ordered by date.

All of them are ordinary window columns over the same partitioning and ordering, so any number of
them shares one shuffle and one sort.  ``n`` counts bars, not days.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscope.functions.values import col, gt, limit_up_pct, safe_div, sig

def W():
    """The series of a code, by date."""
    return Window.partitionBy("code").orderBy("d")


def so_far():
    """All bars up to the current one."""
    return W().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_n(n: int):
    """The current bar and the ``n - 1`` before it."""
    return W().rowsBetween(-(max(int(n), 1) - 1), Window.currentRow)


def before(n: int):
    """The ``n`` bars before the current one."""
    return W().rowsBetween(-max(int(n), 1), -1)


def bar_no() -> Column:
    return F.row_number().over(W())


def _strict(agg, x, n: int) -> Column:
    # Missing while the window is short or holds any missing value.
    return F.when(F.count(col(x)).over(last_n(n)) == n, agg(col(x)).over(last_n(n)))


def ref(x, n: int = 1) -> Column:
    """The value ``n`` bars ago; a negative ``n`` looks ahead."""
    return F.lag(col(x), n).over(W()) if n >= 0 else F.lead(col(x), -n).over(W())


def ma(x, n: int) -> Column:
    return _strict(F.avg, x, n)


def sum_n(x, n: int) -> Column:
    return _strict(F.sum, x, n)


def hhv(x, n: int) -> Column:
    return _strict(F.max, x, n)


def llv(x, n: int) -> Column:
    return _strict(F.min, x, n)


def std_n(x, n: int) -> Column:
    """Population deviation."""
    return _strict(F.stddev_pop, x, n)


def merged_sums(df: DataFrame, n: int, sums: dict[str, Column], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add sums over the last ``n`` bars, or as many as there are, in some log2(n) steps a bar rather than n.

    ``sums`` are never missing. ``pairs`` name two columns each: the sum of the products of their deviations from their means,
    missing unless all ``n`` bars have both values. Ranges of 1, 2, 4, ... bars are merged. Nothing is subtracted again, so a
    value has no effect outside its window, and where a column does not change its products sum to exactly 0.
    """
    means = {x: f"_mean_{x}" for xy in pairs.values() for x in xy}
    names, given = [*sums, *means.values(), *pairs], df.columns

    def merged(a: str, p: int, b: str, q: int) -> dict[str, Column]:
        off = {x: F.col(m + b) - F.col(m + a) for x, m in means.items()}
        out = {s + a: F.col(s + a) + F.coalesce(F.col(s + b), F.lit(0)) for s in sums}
        out |= {m + a: F.col(m + a) + off[x] * (q / (p + q)) for x, m in means.items()}
        return out | {s + a: F.col(s + a) + F.col(s + b) + off[x] * off[y] * (p * q / (p + q)) for s, (x, y) in pairs.items()}

    df = df.withColumns(sums | {m: F.col(x) for x, m in means.items()} | {
        s: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.lit(0.0)) for s, (x, y) in pairs.items()})
    size, done = 1, 0  # bars in a range, and bars in the result so far
    while size <= n:
        take, double = n & size, 2 * size <= n
        shifts = [("_prev", size)] * double + [("_rest", done)] * bool(take and done)
        df = df.withColumns({s + at: F.lag(s, k).over(W()) for at, k in shifts for s in names})
        new = merged("", size, "_prev", size) if double else {}
        if take:
            new |= merged("_out", done, "_rest", size) if done else {f"{s}_out": F.col(s) for s in names}
        df, size, done = df.withColumns(new), 2 * size, done + take
    return df.select(*given, *[F.col(f"{s}_out").alias(s) for s in (*sums, *pairs)])


def count_n(cond, n: int) -> Column:
    """How many of the available bars among the last ``n`` satisfy the condition."""
    return F.sum(sig(cond).cast("int")).over(last_n(n))


def barslast(cond) -> Column:
    """Bars since the condition last held; missing if it never did."""
    rn = bar_no()
    return rn - F.last(F.when(sig(cond), rn), ignorenulls=True).over(so_far())


def cross(a, b) -> Column:
    """``a`` is above ``b`` now and was not above it one bar ago."""
    a, b = col(a), col(b)
    prev = F.lag(a, 1).over(W()) <= F.lag(b, 1).over(W())
    return gt(a, b) & sig(prev)


def cross_level(a, level: float) -> Column:
    """Crossing of a constant level (a constant also holds before the first bar)."""
    a = col(a)
    return gt(a, F.lit(level)) & sig(F.lag(a, 1).over(W()) <= F.lit(level))


def rsv(c, h, l, n: int) -> Column:
    """Position of the close in the n-bar range, in percent."""
    low = llv(l, n)
    return safe_div((col(c) - low) * 100, hhv(h, n) - low)


def ts_rank(x, n: int) -> Column:
    """How many window values are at most the current one (ties take the highest place)."""
    x = col(x)
    vals = F.collect_list(x).over(last_n(n))
    return F.when(F.size(vals) == n, F.size(F.filter(vals, lambda v: v <= x)))


def ts_pct(x, n: int) -> Column:
    """Share of window values at most the current one."""
    return ts_rank(x, n) / F.lit(float(n))


def mean_abs_dev(x, n: int) -> Column:
    """Mean absolute deviation from the window mean."""
    vals, mean = F.collect_list(col(x)).over(last_n(n)), F.avg(col(x)).over(last_n(n))
    total = F.aggregate(F.transform(vals, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(vals) == n, total / n)


def limit_up_bar(code="code", pct_chg=None, c="c", pre_close=None, any_st=None) -> Column:
    """Bar that rose (nearly) to its limit, from the change column or the price ratio."""
    pct = limit_up_pct(code, any_st)
    if pct_chg is not None:
        return sig(col(pct_chg) >= pct * 98)
    base = col(pre_close) if pre_close is not None else ref(c, 1)
    return sig(safe_div(c, base) >= 1 + pct * 0.98)


def get_last(cond, price, lookback: int = 20) -> Column:
    """Price at the latest bar that satisfied the condition, among the previous bars only."""
    hit = F.when(sig(cond), F.struct(col(price).alias("p")))
    return F.last(hit, ignorenulls=True).over(before(lookback))["p"]


def close_at_lowest(j, threshold: float, lookback: int, c="c") -> Column:
    """Close at the lowest ``j`` below the threshold among the previous bars, latest on ties.

    Given only once ``lookback`` earlier bars exist.
    """
    hit = F.when(
        sig(col(j) < threshold),
        F.struct(col(j).alias("j"), (-bar_no()).alias("k"), col(c).alias("p")),
    )
    return F.when(bar_no() > lookback, F.min(hit).over(before(lookback))["p"])


def price_if(cond, lookback: int, c="c") -> Column:
    """Today's close if the condition holds today and ``lookback`` earlier bars exist."""
    return F.when(sig(cond) & (bar_no() > lookback), col(c))


def _named(names: Sequence[str], pattern: str) -> list[str]:
    """Names that hold the pattern, a regular expression if it has such signs; case doesn't matter."""
    p = pattern.strip()
    if re.search(r"[.^$*+?{}\[\]|()]", p):
        return [n for n in names if re.search(p, n, re.IGNORECASE)]
    return [n for n in names if p.lower() in n.lower()]


def _set_count(names: Sequence[str], shift: int) -> Column:
    n = reduce(lambda a, b: a + b, [sig(F.col(f"`{t}`").cast("boolean")).cast("int") for t in names], F.lit(0))
    return n if shift == 0 else F.coalesce(F.lag(n, shift).over(W()), F.lit(0))


def any_tag(tags: Sequence[str], pattern: str, shift: int = 0, columns: Sequence[str] = ()) -> Column:
    """Whether any tag ``bucket::name`` or table column whose name matches is set, ``shift`` bars ago."""
    return _set_count(_named([*columns, *tags], pattern), shift) > 0


def matching_tags(tags: Sequence[str], pattern: str, columns: Sequence[str] = ()) -> list[str]:
    """Tags of the bucket of that name; without any the matching columns, and without those the matching tags."""
    bucket = [t for t in tags if t.split("::")[0].lower() == pattern.strip().lower()]
    return bucket or _named(columns, pattern) or _named(tags, pattern)


def tag_hits(tags: Sequence[str], pattern: str, shift: int = 0, columns: Sequence[str] = ()) -> Column:
    """How many matching tags are set, ``shift`` bars ago."""
    return _set_count(matching_tags(tags, pattern, columns), shift)


def any_tag_at_least(tags: Sequence[str], pattern: str, k: int, shift: int = 0, columns: Sequence[str] = ()) -> Column:
    return tag_hits(tags, pattern, shift, columns) >= k


def yday_any_tag(tags: Sequence[str], pattern: str, columns: Sequence[str] = ()) -> Column:
    return any_tag(tags, pattern, 1, columns)


def yday_tag_hits(tags: Sequence[str], pattern: str, columns: Sequence[str] = ()) -> Column:
    return tag_hits(tags, pattern, 1, columns)


def yday_any_tag_at_least(tags: Sequence[str], pattern: str, k: int, columns: Sequence[str] = ()) -> Column:
    return any_tag_at_least(tags, pattern, k, 1, columns)


def at_max(df, value: str, price: str = "c"):
    """Per code the greatest value and the price at its first occurrence; zeros if there is none."""
    first = F.struct(F.col(value), -F.unix_date("d"))
    out = df.groupBy("code").agg(
        F.max(value).alias("value"), F.max_by(price, F.when(F.col(value).isNotNull(), first)).alias("price")
    )
    return out.na.fill(0.0, ["value", "price"])
