"""Scores of a few dates, from the bars that matter, against scores of all dates."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from barscope.functions import series as ts
from barscope.functions.smoothing import Ewm
from barscope.operators import reach
from barscope.operators.reach import Reach, bars_for, looks_back, rules_reach
from barscope.operators.rules import Clause, Rule
from barscope.operators.scoring import rank_scores, score, score_reach, screen
from barscope.operators.simulate import Scenario, predict_ranking, simulate_next
from barscope.plans import fixtures as fx
from barscope.plans.q_sources import store

SF = "/root/testdata/sf0.001"


@looks_back(4)
def features(df):
    return df.withColumns({"ma5": ts.ma("c", 5), "prev": ts.ref("c", 1)})


RULES = (
    Rule("day", "c > ma5", 3, window=6, scope="COUNT>=2"),
    Rule("own", "c > lag(c, 3) over (partition by code order by d)", 5, window=4, scope="CONSEC>=2", back=3),
    Rule("week", "c > prev", 2, timeframe="W", window=3, scope="ALL"),
    Rule("month", "v > 20", 1, timeframe="M", window=2, scope="EACH"),
    Rule("peak", "c >= ma5", 0, scope="RECENT", bins=((0, 0, 6), (1, 3, 2)), gate="v > 3"),
    Rule("both", None, 7, clauses=(Clause("c > o", window=2, scope="ANY"), Clause("c > prev", "W", 2, "LAST")), gate="c > ma5"),
)


@pytest.fixture(scope="module")
def bars(spark):
    """Codes of every kind: dense, sparse, suspended for years, listed late, gone early."""
    rnd = random.Random(11)
    rows = []
    for k in range(24):
        kind, price = k % 6, 10.0
        for i in range(1500):
            if kind == 1 and rnd.random() < 0.8 or kind == 2 and 300 < i < 1390 or kind == 3 and i < 1395 or kind == 4 and i > 700 or kind == 5 and rnd.random() < 0.97:
                continue
            o, price = price, round(price * rnd.uniform(0.95, 1.06) + 0.01, 2)
            rows.append((f"c{k:02d}", dt.date(2020, 1, 1) + dt.timedelta(days=i), o, max(o, price) + 0.1, min(o, price) - 0.1, price, float(rnd.randrange(1, 40)), 1.0))
    return spark.createDataFrame(rows, "code string, d date, o double, h double, l double, c double, v double, amount double").persist()


def rows(df):
    return sorted(map(str, df.collect()))


def test_reach_adds_up(spark):
    assert rules_reach([RULES[0]], features) == Reach(4 + 5)
    assert rules_reach([RULES[1]], features) == Reach(4 + 3 + 3)
    assert rules_reach([RULES[2]], features) == Reach(0, (4 + 2 + 3) * 7)
    assert rules_reach([RULES[4]], features, gates=False) == Reach(4 + 3)
    assert rules_reach(RULES[:1], lambda df: df) == reach.ALL  # undeclared features
    assert rules_reach([Rule("x", RULES[1].when, 1, window=1)], features) == reach.ALL  # an undeclared window
    assert rules_reach([Rule("x", ts.ref("c", 9) > 1, 1, window=1)], features) == reach.ALL
    assert rules_reach([Rule("x", F.col("c") > 1, 1, window=1)], features) == Reach(4)
    n = reach.averages_back([[Ewm("a", "x", 1 / 3)]])
    assert (2 / 3) ** n <= reach.NEGLIGIBLE < (2 / 3) ** (n - 1)
    assert score_reach(fx.RULES, fx.features).bars >= 86


@pytest.mark.parametrize("dates", [["2024-01-20"], ["2023-12-24", "2024-02-08"], ["2022-01-05"], ["2020-01-03"], ["2031-01-01"]])
def test_scores_of_few_dates_equal_the_full_run(bars, dates):
    black = [Rule("crash", "c < 0.96 * prev", window=3, scope="ANY"), Rule("thin", "v < 4", timeframe="M", window=1, scope="LAST")]
    full = rank_scores(score(bars, RULES, features, blacklist=black)).where(F.col("d").isin([dt.date.fromisoformat(d) for d in dates]))
    assert rows(rank_scores(score(bars, RULES, features, blacklist=black, dates=dates))) == rows(full)


def test_dates_as_a_table_and_without_rows(spark, bars):
    days = spark.createDataFrame([(dt.date(2024, 1, 20),), (dt.date(2024, 1, 22),), (None,)], "d date")
    full = score(bars, RULES, features).where(F.col("d").isin([dt.date(2024, 1, 20), dt.date(2024, 1, 22)]))
    assert rows(score(bars, RULES, features, dates=days)) == rows(full)
    assert score(bars, RULES, features, dates=days.limit(0)).collect() == []


def test_screens_of_one_date(bars):
    ranks = rank_scores(score(bars, RULES, features))
    for rule in RULES[:3]:
        full = screen(bars, rule, ranks, features).where(F.col("d") == F.lit("2024-01-25").cast("date"))
        assert rows(screen(bars, rule, ranks, features, "2024-01-25")) == rows(full)


def test_simulated_ranking_equals_the_full_run(bars):
    sim = "2024-02-09"
    full = simulate_next(bars, Scenario(pct=2.0), None, ["kdj"], sim)
    full = rank_scores(score(full, RULES, features).where(F.col("d") == F.lit(sim).cast("date")))
    assert rows(predict_ranking(bars, Scenario(pct=2.0), RULES, features)) == rows(full)


def test_the_first_date_reaches_the_scan(spark):
    stored = spark.read.parquet(store(spark, SF)).where(F.col("adj_type") == "raw").drop("adj_type")
    out = score(stored, fx.RULES, fx.features, dates=["2001-06-01"])
    scans = re.findall(r"PushedFilters: \[([^\n]*)", out._jdf.queryExecution().executedPlan().toString())
    assert scans and all("LessThanOrEqual(d,2001-06-01)" in s or "LessThan(d," in s for s in scans)
    assert any("GreaterThanOrEqual(d," in s for s in scans)


def test_only_short_codes_read_older_bars(bars):
    cut = bars_for(bars.where("substring(code, 2) % 6 IN (0, 2)"), "2023-10-25", "2023-10-30", Reach(20))
    have = {r.code: (r.n, r.all) for r in cut.groupBy("code").agg(F.count("*").alias("n")).join(bars.where("d <= '2023-10-30'").groupBy("code").agg(F.count("*").alias("all")), "code").collect()}
    assert all(n < 60 for code, (n, _) in have.items() if int(code[1:]) % 6 == 0)  # dense ones: the recent bars only
    assert all(n == a for code, (n, a) in have.items() if int(code[1:]) % 6 == 2)  # suspended ones: all
