"""Window scopes: how a per-bar signal decides a rule on its reference bar."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barscope.functions.series import so_far, W, bar_no, last_n
from barscope.functions.values import col, sig

PER_BAR = ("EACH", "PERBAR", "EACH_TRUE")
RECENCY = ("RECENT", "DIST", "NEAR")
# Spellings of the counted scopes.
_SPELLED = ((re.compile(r"^(COUNT|CONSEC)(?:>=|=|≥|＝)(\d+)$"), ">="), (re.compile(r"^(ANY|ALL)[_-]?(\d+)$"), "_"))


def parse_scope(scope: str) -> tuple[str, int]:
    """Kind of scope and its number, e.g. ``('CONSEC>=', 3)``; unknown scopes are refused.

    ``COUNT = 3`` and ``COUNT≥3`` are ``COUNT>=3``; ``ANY3``, ``ANY-3`` and ``ANY 3`` are ``ANY_3``.
    """
    s = "".join((scope or "ANY").upper().split())
    if s in ("LAST", "ANY", "ALL", *PER_BAR, *RECENCY):
        return s, 0
    for form, ending in _SPELLED:
        m = form.match(s)
        if m and int(m.group(2)) >= 1:
            return m.group(1) + ending, int(m.group(2))
    raise ValueError(f"unknown scope {scope!r}")


def scope_or_any(scope: str) -> str:
    """The scope if it is known, else ``ANY``: for rules from files that must not stop a run."""
    try:
        parse_scope(scope)
    except ValueError:
        return "ANY"
    return scope


def effective_window(scope: str, window: int, bins: Sequence[tuple] = ()) -> int:
    """How many bars the scope looks at."""
    kind, k = parse_scope(scope)
    if kind == "LAST":
        return 1
    if kind in RECENCY and bins:
        widest = max(int(hi) for _, hi, _ in bins)
        return widest + 1 if widest > 0 else max(int(window), 1)
    return max(int(window), k, 1)


def scope_hit(signal, scope: str, window: int) -> Column:
    """Whether the rule holds on each bar, seen as the reference bar."""
    s = sig(signal)
    kind, k = parse_scope(scope)
    n = effective_window(scope, window)
    as_int = s.cast("int")
    if kind == "LAST":
        return s
    if kind == "ALL":
        return F.min(as_int).over(last_n(n)) == 1
    if kind == "COUNT>=":
        return F.sum(as_int).over(last_n(n)) >= k
    if kind in ("CONSEC>=", "ALL_"):
        run = (F.sum(as_int).over(last_n(k)) == k).cast("int")
        return F.max(run).over(last_n(n - k + 1)) == 1
    some = F.max(as_int).over(last_n(n)) == 1
    if kind == "ANY_":
        return some & (F.count(as_int).over(last_n(n)) >= k)
    return some


def true_count(signal, window: int) -> Column:
    """Number of true bars in the window."""
    return F.sum(sig(signal).cast("int")).over(last_n(window))


def bars_since(signal, window: int) -> Column:
    """Bars since the latest true bar inside the window; missing if there is none."""
    n = bar_no()
    lag = n - F.last(F.when(sig(signal), n), ignorenulls=True).over(so_far())
    return F.when(lag < window, lag)


def bin_points(lag, bins: Sequence[tuple]) -> Column:
    """Points of the first bin ``(lo, hi, points)`` that holds the lag, else zero."""
    lag = col(lag)
    out = F.when(lag.isNull(), F.lit(0.0))
    for lo, hi, points in bins:
        out = out.when(lag.between(int(lo), int(hi)), F.lit(float(points)))
    return out.otherwise(F.lit(0.0))


def hit_dates(signal, window: int, d="d") -> Column:
    """Dates of the true bars in the window, ascending."""
    if window <= 1:
        return F.when(sig(signal) & col(d).isNotNull(), F.array(col(d))).otherwise(F.array().cast("array<date>"))
    return F.collect_list(F.when(sig(signal), col(d))).over(last_n(window))


def last_hit(signal, window: int, d="d") -> Column:
    """Date of the latest true bar in the window."""
    return F.max(F.when(sig(signal), col(d))).over(last_n(window))


def period_start(window: int, d="d") -> Column:
    return F.min(col(d)).over(W().rowsBetween(-(window - 1), Window.currentRow))


def period_label(window: int, d="d") -> Column:
    """``start-end`` of the window, or the single date."""
    if window <= 1:
        return F.date_format(col(d), "yyyyMMdd")
    a, b = F.date_format(period_start(window, d), "yyyyMMdd"), F.date_format(col(d), "yyyyMMdd")
    return F.when(a == b, b).otherwise(F.concat_ws("-", a, b))
