"""Ranking under skew, periods, rules over dates, simulation and solving, writes."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from series_helpers import column

from barscope.functions import series as ts
from barscope.operators import benchmark, category, crosssection, quality, research, solver
from barscope.operators.indicators import with_indicators
from barscope.operators.ranking import average_ranks, previous, rank_within, steps
from barscope.operators.resample import last_finished, resample
from barscope.operators.rules import Clause, Rule, evaluate, rule_details
from barscope.operators.scoring import rank_scores, recent_history, score
from barscope.operators.simulate import Scenario, next_bars, simulate_next
from barscope.session import scratch_path
from barscope.sources import tables


@pytest.fixture(scope="module")
def skewed(spark):
    """One date holds most rows and most of them share one score."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        day = dt.date(2024, 1, 1 if i % 10 < 8 else 2 + i % 3)
        rows.append((f"S{i:05d}", day, 50.0 if i % 3 else float(rng.randint(40, 60)), rng.choice([None, 1.0, 2.0, 3.5])))
    return spark.createDataFrame(rows, "code string, d date, score double, j double")


def as_set(df):
    return {tuple(r) for r in df.select(*sorted(df.columns)).collect()}


def test_ranks_of_a_skewed_date_equal_pandas(skewed):
    got = {r.code: (r.rank, r.total) for r in rank_scores(skewed).collect()}
    pdf = skewed.toPandas().sort_values(["score", "j", "code"], ascending=[False, True, True], na_position="last")
    pdf["rank"] = pdf.groupby("d").cumcount() + 1
    pdf["total"] = pdf.groupby("d").code.transform("count")
    assert got == {c: (r, t) for c, r, t in zip(pdf.code, pdf["rank"], pdf.total)}


def test_ranks_do_not_depend_on_the_steps(skewed):
    want = as_set(rank_scores(skewed))
    order = [F.col("score").desc(), F.col("j").asc_nulls_last(), F.col("code")]
    for coarse in ([steps(F.col("score"), 100, ascending=False)], [-F.col("score"), steps(F.col("j"), 0.1)]):
        assert as_set(rank_within(skewed, ["d"], order, coarse, "rank", "total")) == want


def test_average_ranks_of_a_skewed_date_equal_pandas(skewed):
    got = {r.code: r for r in average_ranks(skewed, ["d"], "score", "up", "down", "n").collect()}
    pdf = skewed.toPandas()
    groups = pdf.groupby("d").score
    for side, up in (("up", True), ("down", False)):
        assert {c: r[side] for c, r in got.items()} == dict(zip(pdf.code, groups.rank(method="average", ascending=up)))
    assert {c: r.n for c, r in got.items()} == dict(zip(pdf.code, groups.transform("count")))


def test_average_rank_of_missing_values(spark):
    rows = [("a", 1, 5.0), ("b", 1, 5.0), ("c", 1, -3.0), ("e", 1, None), ("f", 2, None), ("g", 2, None)]
    got = {r.code: (r.up, r.down) for r in average_ranks(spark.createDataFrame(rows, "code string, d int, x double"), ["d"], "x", "up", "down").collect()}
    assert got == {"a": (2.5, 1.5), "b": (2.5, 1.5), "c": (1.0, 3.0), "e": (3.0, 4.0), "f": (1.0, 1.0), "g": (1.0, 1.0)}


def test_steps_keep_the_order(spark):
    values = [float("-inf"), -1e9, -5.0, -0.1, -1e-5, 0.0, 1e-7, 0.1, 0.10001, 5.0, 1e9, float("inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    for size in (None, 0.25):
        got = [r.s for r in df.select(steps(F.col("x"), size).alias("s"), "i").orderBy("i").collect()]
        assert got == sorted(got)


def test_previous_row_across_buckets(spark):
    """A hot key spread over several buckets, with missing values in between."""
    rows = [("hot" if i % 4 else f"k{i % 3}", i, float(i) if i % 7 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "code string, seq int, c double").repartition(7)
    got = {(r.code, r.seq): r._previous for r in previous(df, "code", "seq", "c", size=100).collect()}
    want, last = {}, {}
    for code, seq, c in rows:
        want[code, seq] = last.get(code)
        last[code] = c
    assert got == want


def test_missing_returns_rank_last(spark, series):
    """The second code has no bar on the first of two dates."""
    day = dt.date(2024, 1, 2)
    bars = spark.createDataFrame([("a", day, 1.0, 5.0), ("a", day + dt.timedelta(1), 2.0, 6.0), ("b", day + dt.timedelta(1), 3.0, 7.0)], "code string, d date, c double, v double")
    cal = spark.createDataFrame([(day, 1), (day + dt.timedelta(1), 2)], "d date, idx int")
    for side in ("up", "down"):
        got = {(r.code, r.d.day): r.r for r in crosssection.rank_ret(bars, cal, side).collect()}
        assert got == {("a", 2): float("inf"), ("a", 3): 1.0, ("b", 3): 2.0}
    coef = {(r.code, r.d.day): r.coef for r in crosssection.rank_match_coef(bars, cal).collect()}
    assert coef == {("a", 2): 0.0, ("a", 3): 1.0, ("b", 3): 1.0}


DAYS = [dt.date(2024, 12, 20), dt.date(2024, 12, 23), dt.date(2024, 12, 31), dt.date(2025, 1, 1), dt.date(2025, 1, 27), dt.date(2025, 2, 28), dt.date(2025, 3, 1)]


@pytest.fixture(scope="module")
def sparse(spark):
    rows = [("a", d, 1.0 + i, 9.0 + i, 0.5, 2.0 + i, 10.0, 5.0) for i, d in enumerate(DAYS)]
    return spark.createDataFrame(rows, "code string, d date, o double, h double, l double, c double, v double, amount double")


@pytest.mark.parametrize("freq,rule", [("W", "W-FRI"), ("M", "ME")])
def test_periods_match_pandas(sparse, freq, rule):
    pdf = sparse.toPandas().set_index(pd.DatetimeIndex(DAYS)).drop(columns=["code", "d"])
    how = {"o": "first", "h": "max", "l": "min", "c": "last", "v": "sum", "amount": "sum"}
    want = [(i.date(), *[None if x != x else x for x in r]) for i, r in zip(pdf.resample(rule).agg(how).index, pdf.resample(rule).agg(how).values.tolist())]
    got = [tuple(r) for r in resample(sparse, freq).orderBy("d").select("d", *how).collect()]
    assert got == want
    assert [g for g in got if g[1] is not None] == [tuple(r) for r in resample(sparse, freq, keep_gaps=False).orderBy("d").select("d", *how).collect()]


def test_last_finished_period(spark):
    days = ["2024-01-03", "2024-01-05", "2024-01-06", "2024-01-31", "2024-02-29", "2024-03-30"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("d"))
    got = [(str(r.w), str(r.m)) for r in df.select(last_finished("d", "W").alias("w"), last_finished("d", "M").alias("m")).collect()]
    assert got == [("2023-12-29", "2023-12-31"), ("2024-01-05", "2023-12-31"), ("2024-01-05", "2023-12-31"), ("2024-01-26", "2024-01-31"),
                   ("2024-02-23", "2024-02-29"), ("2024-03-29", "2024-02-29")]


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(3)
    rows = []
    for code in ("a", "b", "e"):
        c = 100.0
        for i in range(140):
            if rng.random() < 0.2:
                continue
            o, c = c, round(max(5.0, c + rng.uniform(-6, 6)), 2)
            rows.append((code, dt.date(2024, 1, 1) + dt.timedelta(days=i), o, max(o, c) + 1, min(o, c) - 1, c, float(rng.randint(1, 50)), c))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "code string, d date, o double, h double, l double, c double, v double, amount double").persist()


RULES = (
    Rule("up", "c > prev", 3, window=4, scope="CONSEC>=2"), Rule("each", "v > 20", 1, window=3, scope="EACH"),
    Rule("near", "c >= top", scope="RECENT", bins=((0, 0, 4), (1, 5, 2))), Rule("week", "c > o", 5, "W", 2, "ALL"),
    Rule("both", None, -2, clauses=(Clause("c < prev", window=1, scope="LAST"), Clause("v > 60", "M", 1, "LAST"))),
)


def features(df):
    return df.withColumns({"prev": ts.ref("c", 1), "top": ts.hhv("c", 5)})


def test_all_dates_at_once_equal_each_date_alone(walk):
    every = {(r.code, r.d): (r.score, r.j) for r in score(walk, RULES, features).collect()}
    for day in (dt.date(2024, 2, 9), dt.date(2024, 3, 31), dt.date(2024, 5, 2)):
        alone = score(walk.where(F.col("d") <= F.lit(day)), RULES, features).where(F.col("d") == F.lit(day)).collect()
        assert alone and {(r.code, r.d): (r.score, r.j) for r in alone} == {k: v for k, v in every.items() if k[1] == day}


def test_recent_history_is_enough_for_bounded_windows(walk):
    days = walk.select("d").distinct()
    part = recent_history(walk, days.select("d"), "2024-05-01", 90)
    assert part.count() < walk.count()
    from_part = score(part, RULES[:2], features, tiebreak=False).where("d >= date '2024-05-01'")
    assert as_set(from_part) == as_set(score(walk, RULES[:2], features, tiebreak=False).where("d >= date '2024-05-01'"))


def test_zero_point_hit_is_not_stored_unless_counted(walk):
    rules = (Rule("zero", "c > 0", 0, window=1, scope="LAST"), Rule("zero_each", "c > 0", 0, window=2, scope="EACH"))
    names = {r.name for r in rule_details(evaluate(walk, rules, dates=True), rules).select("name").distinct().collect()}
    assert names == {"zero_each"}


def test_per_bar_clauses_must_share_their_window():
    with pytest.raises(ValueError):
        Rule("x", None, 1, scope="EACH", clauses=(Clause("c > 1", window=3), Clause("c > 1", window=4)))
    with pytest.raises(ValueError):
        Rule("x", "c > 1", 1, timeframe="60MIN")


@pytest.mark.parametrize("name,out,target", [("bbi", "bbi", 90.0), ("diff", "diff", 0.5), ("rsi", "rsi", 55.0), ("kdj", "j", 50.0)])
def test_reverse_price_reaches_the_indicator(walk, name, out, target):
    """The closed form at the found price equals the indicator of a history with that bar appended."""
    found = solver.reverse_price_grid(walk, name, target).persist()
    ratio = found.select("code", (F.col("price") / F.col("c")).alias("k"))
    last = next_bars(walk, Scenario("flat")).select("code", "d")
    base = walk.groupBy("code").agg(*[F.max_by(n, "d").alias(n) for n in ("o", "h", "l", "c", "v")])
    new = base.join(ratio, "code").join(last, "code").select("code", "d", *[(F.col(n) * F.col("k")).alias(n) for n in "ohlc"], "v")
    again = with_indicators(walk.select("code", "d", *"ohlcv").unionByName(new), [name])
    got = {r.code: r[out] for r in again.join(last, ["code", "d"], "left_semi").collect()}
    want = {r.code: r.value for r in found.collect()}
    assert set(got) == {"a", "b", "e"}
    for code, value in want.items():
        assert got[code] == pytest.approx(value, abs=0.0051)


def test_bisection_finds_the_target_and_reports_failure(walk):
    hit = solver.reverse_price_bisect(walk, "diff", 0.0, 1e-4).collect()
    assert all(r.converged and abs(r.value) < 1e-4 for r in hit)
    assert not any(r.converged for r in solver.reverse_price_bisect(walk, "diff", 1e9, 1e-4).collect())
    with pytest.raises(ValueError):
        solver.reverse_price_grid(walk, "macd", 1.0)


def test_reverse_scenario(walk):
    s = Scenario("reverse_indicator", reverse_indicator="diff", reverse_target_value=0.0, reverse_method="bisect", reverse_tolerance=1e-3)
    sim = with_indicators(simulate_next(walk, s), ["diff"]).where("sim")
    assert [r["diff"] for r in sim.collect()] == [pytest.approx(0.0, abs=0.006)] * 3
    never = Scenario("reverse_indicator", reverse_indicator="diff", reverse_target_value=1e9, reverse_tolerance=1e-3)
    flat = {tuple(r) for r in next_bars(walk, Scenario("flat")).collect()}
    assert {tuple(r) for r in next_bars(walk, never).collect()} == flat


def test_upsert_null_wins_and_keys_only_changes_nothing(spark):
    old = spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], "k int, a int, b string")
    new = spark.createDataFrame([(1, None), (3, 30)], "k int, a int")
    assert as_set(tables.upsert(old, new, ["k"]).select("k", "a", "b")) == {(None, "x", 1), (20, "y", 2), (30, None, 3)}
    assert as_set(tables.upsert(old, new.select("k"), ["k"]).where("k < 3").select("k", "a", "b")) == {(10, "x", 1), (20, "y", 2)}


def test_empty_list_can_be_read_back(spark):
    path = scratch_path(spark, "empty")
    empty = spark.createDataFrame([], "code string, period string, reason string, d date, list string")
    tables.write_lists(empty, path)
    back = tables.read_list(spark, path, "2024-01-01", "white")
    assert back.count() == 0 and back.columns == ["code", "period", "reason", "d", "list"]


def test_time_weights():
    assert category.time_weights(3, "none") == [1.0, 1.0, 1.0]
    for mode in ("exp", "linear"):
        w = category.time_weights(7, mode)
        assert sum(w) == pytest.approx(7) and w == sorted(w)
    assert category.time_weights(0) == [] and len(category.time_weights(1, "linear")) == 1


def test_small_datasets_are_refused(spark):
    with pytest.raises(ValueError):
        research.require_rows(spark.range(99))
    research.require_rows(spark.range(100))


def test_informative_rule_is_most_important(spark):
    rng = random.Random(4)
    rows = [(float(a), float(rng.random() < 0.5), 2.0 * a + rng.uniform(-0.1, 0.1)) for a in (rng.randint(0, 1) for _ in range(300))]
    df = spark.createDataFrame(rows, "good double, noise double, target double")
    gain = {r.rule: r.gain for r in research.rule_importance(df, df, ["good", "noise"], rounds=3).collect()}
    assert gain["good"] > 0.8 > gain["noise"]


def test_best_round():
    assert research.best_round([3.0, 2.0, 2.5, 1.0], None) == 3
    assert research.best_round([3.0, 2.0, 2.5, 2.5, 1.0], 2) == 1  # stopped before the better one
    assert research.best_round([3.0, 2.0, 2.5, 1.0, 1.0], 2) == 3
    assert research.best_round([1.0], 5) == 0


def test_early_stopping_ends_at_the_best_round_of_the_test_part(spark):
    """Train and test disagree about one rule, so every round after the first makes the test part worse."""
    import random

    rng = random.Random(7)
    rows = [(float(i % 2), float(rng.random() < 0.5), 1.0 * (i % 2) + rng.gauss(0, 0.1)) for i in range(200)]
    train = spark.createDataFrame(rows, "r double, noise double, target double")
    test = train.withColumn("target", F.lit(0.5))
    gains, metrics = research.rule_model(train, test, ["r", "noise"], rounds=6, patience=2, rows=1.0, columns=1.0, rate=0.5)
    m = metrics.first()
    one = research.rule_model(train, test, ["r", "noise"], rounds=m.best_round + 1, patience=None, rows=1.0, columns=1.0, rate=0.5)
    assert m.best_round < 5 and one[1].first() == m and one[0].collect() == gains.collect()
    assert (m.train_size, m.test_size, m.test_target) == (200, 200, 0.5) and m.train_rmse < m.test_rmse


def test_list_hits(spark):
    import datetime as dt

    from barscope.operators import category
    from barscope.operators.calendar import trade_dates

    day = lambda i: dt.date(2024, 1, i)
    span = trade_dates(spark.createDataFrame([(day(i),) for i in (2, 3, 4)], "d date"))
    rows = [("a", day(2), "white"), ("a", day(4), "white"), ("b", day(3), "white"), ("b", day(3), "black"), ("a", day(9), "white"), (None, day(3), "white")]
    lists = spark.createDataFrame(rows, "code string, d date, list string")
    hits = lambda *a: [tuple(r) for r in category.list_hits(lists, span, *a).collect()]
    assert hits("white") == [("a", 2, day(2), day(4)), ("b", 1, day(3), day(3))]
    assert hits("white", 2) == [("a", 2, day(2), day(4))] and hits("white", 1, 1) == hits("white", 2)
    assert hits("black", 9) == []  # needs as many hits as the span has dates, at most
    with pytest.raises(ValueError):
        hits("top")


def test_validation_rules_by_kind(spark):
    df = spark.createDataFrame([("600000.SH", 1.0, -1), ("bad", 0.0, 2)], "code string, o double, v int")
    got = as_set(quality.validate(df, quality.DEFAULT_RULES["bars"]))
    assert {(c, col) for c, col, _ in got} >= {("constraint", "code"), ("constraint", "o"), ("constraint", "v"), ("missing_column", "h")}


def test_match_coefficient_is_in_range(walk):
    from barscope.operators.calendar import trade_dates

    got = crosssection.rank_match_coef(walk, trade_dates(walk), 2).agg(F.min("coef"), F.max("coef")).first()
    assert 0.0 <= got[0] <= got[1] <= 1.0


def test_reverse_mode_per_symbol(spark, series):
    """Symbols may ask for the reverse mode, or for another where it is the default."""
    bars = series({k: [10.0 + i % 3 for i in range(40)] for k in "abc"})
    bars = bars.withColumns({"o": F.col("c"), "h": F.col("c") + 1, "l": F.col("c") - 1, "v": F.lit(5.0)})
    reverse = Scenario("reverse_indicator", reverse_indicator="bbi", reverse_target_value=10.9, reverse_tolerance=0.05)
    alone = {r.code: r.c for r in next_bars(bars, reverse).collect()}
    plain = Scenario("close_pct", 2.0, reverse_indicator="bbi", reverse_target_value=10.9, reverse_tolerance=0.05)
    some = spark.createDataFrame([("a", "reverse_indicator"), ("b", None)], "code string, mode string")
    got = {r.code: r.c for r in next_bars(bars, plain, some).collect()}
    last = {r.code: r.c for r in bars.where("d = '2024-02-09'").collect()}
    assert got == {"a": alone["a"], "b": last["b"] * 1.02, "c": last["c"] * 1.02}
    some = spark.createDataFrame([("a", "close_pct", 3.0)], "code string, mode string, pct double")
    got = {r.code: r.c for r in next_bars(bars, reverse, some).collect()}
    assert got == {"a": last["a"] * 1.03, "b": alone["b"], "c": alone["c"]}


def test_lists_of_other_dates_stay(spark):
    path = scratch_path(spark, "lists")
    lists = lambda day, codes: spark.createDataFrame([(c, "p", "r", day, "white") for c in codes], "code string, period string, reason string, d string, list string")
    tables.write_lists(lists("2024-01-02", ["a", "b"]), path)
    tables.write_lists(lists("2024-01-03", ["c"]), path)
    tables.write_lists(lists("2024-01-03", []), path, ["2024-01-03"])
    read = lambda day: sorted(r.code for r in tables.read_list(spark, path, day, "white").collect())
    assert read("2024-01-02") == ["a", "b"] and read("2024-01-03") == []


def test_reverse_indicators_per_symbol(spark, series):
    """Indicator, target, tolerance and method are each symbol's own; solving them together changes nothing."""
    from barscope.operators.simulate import scenario_bars

    rng = random.Random(8)
    bars = series({k: [round(10 + rng.random() * 3, 2) for _ in range(60)] for k in "abcdef"})
    bars = bars.withColumns({"o": F.col("c") - 0.2, "h": F.col("c") + 1, "l": F.col("c") - 1, "v": F.lit(5.0)})
    wants = {"a": ("bbi", 11.5, "grid", 1.0), "b": ("diff", 0.3, "bisect", 1e-6), "c": ("rsi", 70.0, "bisect", 1e-3), "d": ("kdj", 50.0, "grid", 50.0), "e": ("nothing", 1.0, "grid", 1.0)}
    table = spark.createDataFrame([(k, "reverse_indicator", *v) for k, v in wants.items()],
                                  "code string, mode string, reverse_indicator string, reverse_target_value double, reverse_method string, reverse_tolerance double")
    prices = lambda df: {r.code: (r.o, r.h, r.l, r.c) for r in df.collect()}
    got = prices(next_bars(bars, Scenario("close_pct", 1.0, reverse_indicator="bbi", reverse_target_value=12.3), table))
    for k, (name, target, method, tolerance) in wants.items():
        if name != "nothing":
            alone = Scenario("reverse_indicator", reverse_indicator=name, reverse_target_value=target, reverse_method=method, reverse_tolerance=tolerance)
            assert got[k] == pytest.approx(prices(next_bars(bars, alone))[k])
    assert got["e"] == prices(next_bars(bars, Scenario("flat")))["e"]
    assert got["f"] == prices(next_bars(bars, Scenario("close_pct", 1.0)))["f"]
    many = scenario_bars(bars, {"x": Scenario("flat"), "y": Scenario("reverse_indicator", reverse_indicator="diff", reverse_target_value=0.3, reverse_method="bisect")})
    assert {r.code: r.c for r in many.where("scenario = 'y'").collect()}["b"] == pytest.approx(got["b"][3])
    assert prices(many.where("scenario = 'x'")) == prices(next_bars(bars, Scenario("flat")))


def test_scenarios_share_one_scan(spark, tmp_path):
    import re

    from barscope.plans import fixtures as fx
    from barscope.operators.simulate import scenario_bars

    fx.bars(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    scans = lambda n: len(re.findall(r"FileScan", scenario_bars(bars, {str(i): Scenario(pct=float(i)) for i in range(n)})._jdf.queryExecution().executedPlan().toString()))
    assert scans(1) == scans(9) <= 2


@pytest.mark.parametrize("how", ["ffill", "drop"])
def test_several_benchmarks_like_pandas(spark, how):
    """Each benchmark lacks other dates; with drop the second sees what the first has left."""
    rng = random.Random(8)
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(60)]
    series = {"s1": days, "s2": days[7:50]}
    bars = pd.DataFrame([(c, d, rng.uniform(5, 9)) for c, own in series.items() for d in own], columns=["code", "d", "c"])
    benches = {"x": pd.DataFrame([(d, rng.uniform(50, 60)) for i, d in enumerate(days) if i % 4], columns=["d", "c"]),
               "y": pd.DataFrame([(d, rng.uniform(80, 90)) for i, d in enumerate(days) if i % 7 != 2], columns=["d", "c"])}
    want = []
    for _, g in bars.groupby("code"):
        g = g.reset_index(drop=True)
        for name, b in benches.items():
            m = g[["d"]].merge(b.assign(r=b.c.pct_change()), on="d", how="left")
            if how == "ffill":
                m = m.ffill()
            else:
                g, m = g[m.c.notna()].reset_index(drop=True), m[m.c.notna()].reset_index(drop=True)
            ret, ratio = g.c.pct_change(), g.c / m.c
            g[f"exret_sum_{name}"] = (ret - m.r).rolling(10, min_periods=5).sum()
            g[f"rs_{name}"] = ratio / ratio.rolling(10, min_periods=5).mean()
            g[f"beta_{name}"] = ret.rolling(10).cov(m.r) / m.r.rolling(10).var()
            g[f"corr_{name}"] = ret.rolling(10).corr(m.r)
        want.append(g)
    want = pd.concat(want).sort_values(["code", "d"]).reset_index(drop=True)
    sides = {n: spark.createDataFrame(b, "d date, c double") for n, b in benches.items()}
    out = benchmark.several_benchmarks(spark.createDataFrame(bars, "code string, d date, c double"), sides, 10, how)
    got = out.select(*want.columns).orderBy("code", "d").toPandas()
    assert 0 < len(want) and (how == "ffill" or len(want) < len(bars))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-8)
