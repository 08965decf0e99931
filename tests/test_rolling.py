"""Rolling lists against sums over every window."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barscope.operators.category import category_rank_rolling, time_weights

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i + i // 5) for i in range(60)]


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(2)
    ranks = [(f"c{k}", d, rnd.randrange(1, 31), 30 + k) for k in range(12) for d in DAYS if rnd.random() < 0.1 * k]
    days = [(d, i + 1) for i, d in enumerate(DAYS)]
    return ranks, spark.createDataFrame(ranks, "code string, d date, rank int, total int"), spark.createDataFrame(days, "d date, idx int")


def plain(ranks, n, min_hits, top_n, top_m, mode, weights, half_life, low):
    out = []
    for e, end in enumerate(DAYS):
        window = DAYS[max(0, e - n + 1) : e + 1]
        w = dict(zip(window, time_weights(len(window), weights, half_life, low)))
        limit = top_n if mode == "hits" else top_m
        listed = {}
        for code, d, rank, total in sorted(ranks, key=lambda r: r[1]):
            if d in w and (not limit or rank <= limit):
                listed.setdefault(code, []).append((d, rank, 1 - (rank - 1) / total))
        rows = []
        for code, own in listed.items():
            if len(own) >= max(1, min(min_hits, len(window))):
                s, sw = sum(p * w[d] for d, _, p in own), sum(w[d] for d, _, _ in own)
                rows.append((code, len(own), round(s, 6), round(s / max(sw, 1e-9), 6), min(r for _, r, _ in own), own[-1][1], own[0][0], own[-1][0]))
        key = (lambda r: (-r[1], -r[7].toordinal(), r[0])) if mode == "hits" else (lambda r: (-r[2], -r[7].toordinal(), r[4], r[0]))
        rows = sorted(rows, key=key)[: top_n or None]
        out += [(end, i + 1, *((r[0], r[1], r[6], r[7]) if mode == "hits" else r)) for i, r in enumerate(rows)]
    return out


@pytest.mark.parametrize("mode, weights, n, min_hits, top_n, top_m, half_life, low", [
    ("strength", "none", 10, 2, 5, 15, 5.0, 0.3), ("strength", "exp", 7, 1, None, None, 3.0, 0.3), ("strength", "linear", 12, 3, 6, 20, 5.0, 0.3),
    ("strength", "linear", 1, 1, None, None, 5.0, 0.0), ("strength", "exp_decay", 25, 2, 4, None, 0.5, 0.3), ("hits", "none", 9, 2, 8, None, 5.0, 0.3), ("strength", "", 80, 1, 3, 9, 5.0, 0.3),
])
def test_equals_every_window(tables, mode, weights, n, min_hits, top_n, top_m, half_life, low):
    ranks, df, days = tables
    got = category_rank_rolling(df, days, n, min_hits, top_n, top_m, mode, weights, half_life, low)
    cols = ["end_d", "place", "code", "hits", *(["first", "last"] if mode == "hits" else ["strength", "mean_strength", "best_rank", "last_rank", "first", "last"])]
    got = sorted(tuple(r) for r in got.select(*cols).collect())
    want = sorted(plain(ranks, n, min_hits, top_n, top_m, mode, weights, half_life, low))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and [x if not isinstance(x, float) else round(x, 5) for x in a[4:]] == [x if not isinstance(x, float) else pytest.approx(x, abs=2e-5) for x in b[4:]] if mode != "hits" else a == b


def test_no_ranks(tables):
    _, df, days = tables
    assert category_rank_rolling(df.limit(0), days, 10, weights="exp").collect() == []


def test_one_shuffle_by_code(tables):
    import re

    _, df, days = tables
    plan = category_rank_rolling(df, days, 10, top_n=30, weights="exp")._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"Exchange hashpartitioning\(code#\d+", plan))) == 1 and "WindowGroupLimit" in plan
