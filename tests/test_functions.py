"""Null rules and windows on tiny hand-made series, and brute force on random ones."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from series_helpers import column

from barscope.functions import scopes, series as ts, smoothing, values as val
from barscope.functions.smoothing import Ewm, with_ewm

HOLES = [1.0, 2.0, None, 4.0, 5.0, 6.0, 3.0]


def near(got, want, tol=1e-9):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None or w != w), (got, want)
        if g is not None:
            assert g == pytest.approx(w, rel=tol, abs=tol)


def test_strict_windows_need_every_value(series):
    df = series({"a": HOLES})
    for fn, want in ((ts.ma, 4.5), (ts.sum_n, 9.0), (ts.hhv, 5.0), (ts.llv, 4.0), (ts.std_n, 0.5)):
        got = column(df.withColumn("y", fn("c", 2)), "y")
        assert got[0] is None and got[2] is None and got[3] is None
        assert got[4] == pytest.approx(want)


def test_all_missing_constant_and_single(series):
    df = series({"a": [None] * 4, "b": [7.0] * 4, "e": [9.0]})
    df = df.withColumns({"m": ts.ma("c", 2), "s": ts.std_n("c", 2), "n": ts.count_n(F.col("c") > 8, 3)})
    assert column(df, "m") == [None] * 4
    assert column(df, "s", "b") == [None, 0.0, 0.0, 0.0]
    assert column(df, "n", "e") == [1]


def test_missing_comparisons(series):
    df = series({"a": [None, 2.0]})
    df = df.select("code", "d", val.gt("c", 1).alias("g"), val.not_(F.col("c") > 1).alias("n"), val.ne("c", 2).alias("u"),
                   val.max2("c", F.lit(1.0)).alias("m"), val.if_(F.col("c") > 1, F.lit(1), F.lit(0)).alias("i"))
    assert [tuple(r[2:]) for r in df.orderBy("d").collect()] == [(False, True, True, None, 0), (True, False, False, 2.0, 1)]


def test_cross_at_equality(series):
    df = series({"a": [1.0, 2.0, 2.0, 3.0]}).withColumn("b", F.lit(2.0))
    assert column(df.withColumn("x", ts.cross("c", "b")), "x") == [False, False, False, True]


def test_rounding_is_half_even(spark):
    got = spark.sql("SELECT * FROM VALUES (0.125D), (0.375D), (2.675D), (-0.001D) t(x)").select(val.rnd("x", 2)).collect()
    assert [r[0] for r in got] == [float(np.round(x, 2)) + 0.0 for x in (0.125, 0.375, 2.675, -0.001)]


def test_numbers_and_dates_that_do_not_parse(spark):
    df = spark.createDataFrame([("1.5", "20240131"), ("n/a", "2024-01-31"), ("NaN", "20240231"), (None, None)], "x string, d string")
    got = df.select(val.to_number("x"), val.day_text(val.parse_day("d"))).collect()
    assert [tuple(r) for r in got] == [(1.5, "20240131"), (None, None), (None, None), (None, None)]


def pandas_ewm(x, a: Ewm):
    s = pd.Series(x, dtype=float)
    y = s.ewm(alpha=a.alpha, adjust=a.adjust).mean()
    return y.where(s.notna()) if a.mask else y


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("mask", [True, False])
def test_averages_match_pandas(series, adjust, mask):
    rng = random.Random(5)
    data = {c: [None if rng.random() < p else rng.uniform(1, 1e4) for _ in range(n)] for c, p, n in (("a", 0.0, 200), ("b", 0.3, 300), ("e", 0.9, 150))}
    todo = [Ewm(f"y{i}", "c", al, adjust, mask) for i, al in enumerate((2 / 13, 1 / 3, 0.9, 1.0))]
    out = with_ewm(series(data), todo).persist()
    for code, x in data.items():
        for a in todo:
            near(column(out, a.out, code), list(pandas_ewm(x, a)), 1e-11)


def test_averages_over_many_blocks(series, monkeypatch):
    """Small blocks force the carry from earlier blocks, also across long gaps."""
    monkeypatch.setattr(smoothing, "MAX_DIGITS", 1)
    rng = random.Random(6)
    data = {"a": [rng.uniform(1, 9) for _ in range(120)], "b": [None if 20 < i < 90 or rng.random() < 0.2 else float(i) for i in range(160)]}
    for adjust in (True, False):
        a = Ewm("y", "c", 0.2, adjust)
        out = with_ewm(series(data), [a])
        for code, x in data.items():
            near(column(out, "y", code), list(pandas_ewm(x, a)), 1e-10)


def test_survey_gap_example(series):
    out = with_ewm(series({"a": [1.0, 2.0, None, 4.0]}), [Ewm("y", "c", 0.5)])
    near(column(out, "y"), [1.0, 1.5, None, 2.375 / 0.75])


def test_seeded_average_equals_average_of_the_slice(series):
    x = [float(i * i % 17) for i in range(40)]
    got = column(series({"a": x}).withColumn("y", smoothing.ewm_seeded("c", 0.25, 10)), "y")
    for t in range(40):
        near([got[t]], [pd.Series(x[max(0, t - 9) : t + 1]).ewm(alpha=0.25, adjust=False).mean().iloc[-1]])


def test_ranks_in_window(series):
    x = [5.0, 1.0, 3.0, 3.0, 2.0, 9.0]
    df = series({"a": x}).withColumns({"r": ts.ts_rank("c", 3), "p": ts.ts_pct("c", 3)})
    want = [None, None] + [sum(v <= x[t] for v in x[t - 2 : t + 1]) for t in range(2, 6)]
    assert column(df, "r") == want
    near(column(df, "p"), [w and w / 3 for w in want])


def test_price_lookups(series):
    rng = random.Random(7)
    c = [float(rng.randint(1, 50)) for _ in range(60)]
    j = [float(rng.randint(0, 30)) if rng.random() < 0.9 else None for _ in range(60)]
    df = series({"a": c}, j={"a": j})
    df = df.withColumns({"g": ts.get_last(F.col("c") > 40, "j", 5), "l": ts.close_at_lowest("j", 13.0, 8), "i": ts.price_if(F.col("c") > 20, 8)})
    want_g, want_l, want_i = [], [], []
    for t in range(60):
        hit = [k for k in range(max(0, t - 5), t) if c[k] > 40]
        want_g.append(j[hit[-1]] if hit else None)
        low = [(j[k], -k) for k in range(t - 8, t) if t >= 8 and j[k] is not None and j[k] < 13]
        want_l.append(c[-min(low)[1]] if low else None)
        want_i.append(c[t] if t >= 8 and c[t] > 20 else None)
    assert column(df, "g") == want_g and column(df, "l") == want_l and column(df, "i") == want_i


def brute(kind, k, s, n):
    w = s[-n:]
    runs = max((len(r) for r in "".join("1" if x else "0" for x in w).split("0")), default=0)
    return {
        "LAST": w[-1], "ANY": any(w), "ALL": all(w), "COUNT>=": sum(w) >= k, "CONSEC>=": runs >= k,
        "ANY_": len(w) >= k and any(w), "ALL_": runs >= k,
    }[kind]


@pytest.mark.parametrize("scope,n", [("LAST", 5), ("ANY", 4), ("ALL", 3), ("COUNT>=3", 6), ("CONSEC>=3", 5), ("CONSEC>=4", 2), ("ANY_3", 5), ("ALL_2", 6)])
def test_scopes_match_brute_force(series, scope, n):
    rng = random.Random(8)
    s = [rng.random() < 0.5 for _ in range(80)]
    df = series({"a": [1.0 if x else None for x in s]})
    got = column(df.withColumn("y", scopes.scope_hit(F.col("c") > 0, scope, n)), "y")
    kind, k = scopes.parse_scope(scope)
    size = scopes.effective_window(scope, n)
    assert got == [brute(kind, k, s[: t + 1], size) for t in range(80)]


def test_recency_bins_first_match_wins(series):
    df = series({"a": [1.0, None, None, None, None, 1.0]})
    lag = scopes.bars_since(F.col("c") > 0, scopes.effective_window("RECENT", 9, ((0, 0, 5), (0, 2, 3), (2, 3, 1))))
    df = df.withColumn("lag", lag).withColumn("y", scopes.bin_points("lag", ((0, 0, 5), (0, 2, 3), (2, 3, 1))))
    assert column(df, "y") == [5.0, 3.0, 3.0, 1.0, 0.0, 5.0]


def test_recency_with_only_a_zero_bin_uses_the_window():
    assert scopes.effective_window("RECENT", 7, ((0, 0, 5),)) == 7
    assert scopes.effective_window("RECENT", 7, ((0, 0, 5), (1, 3, 1))) == 4


def test_unknown_scope_is_refused():
    with pytest.raises(ValueError):
        scopes.parse_scope("SOMETIMES")


def test_tag_patterns():
    tags = ["trend::up", "trend::thin", "range::wide"]
    assert ts.matching_tags(tags, "trend") == ["trend::up", "trend::thin"]
    assert ts.matching_tags(tags, "thin|wide") == ["trend::thin", "range::wide"]
    assert ts.matching_tags(tags, "wid") == ["range::wide"]
