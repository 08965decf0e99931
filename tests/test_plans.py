"""What the physical plans must not hold, and how many shuffles they may."""

import re

import pytest
from pyspark.sql import functions as F

from barscope.functions.smoothing import ema, with_ewm
from barscope.operators.indicators import with_indicators
from barscope.plans import fixtures as fx
from barscope.plans.q_sources import store
from barscope.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|round|Single)", plan(df), re.I))


@pytest.fixture(scope="module")
def bars(spark):
    return spark.read.parquet(store(spark, SF)).where(F.col("adj_type") == "raw")


def test_averages_take_one_shuffle_and_no_python(bars):
    df = with_ewm(bars, [ema("x", "c", 12), ema("y", "c", 26)])
    assert shuffles(df) == 1
    assert "Python" not in plan(df) and "Pandas" not in plan(df)


def test_all_indicators_take_one_shuffle_and_two_sorts(bars):
    df = with_indicators(bars, ["kdj", "volume_ratio", "volume_ratio_prev", "bbi", "rsi", "diff"])
    assert shuffles(df) == 1
    assert len(re.findall(r"\bSort \[", plan(df))) == 2


def test_scoring_all_dates_takes_one_shuffle_per_timeframe_and_no_join(bars):
    from barscope.operators.scoring import rank_scores, score

    scored = score(bars, fx.RULES, fx.features)
    assert "Join" not in plan(scored)
    # Day bars by code, week bars by code.
    assert shuffles(scored) == 2
    # Ranks add one shuffle of the bars, which the bucket sizes read again, and none by date alone.
    df = rank_scores(scored)
    df.write.format("noop").mode("overwrite").save()
    text = plan(df)
    assert not re.search(r"Exchange hashpartitioning\(d#\d+, \d+\)[^\n]*\n[^\n]*Window", text)


def test_rank_windows_are_partitioned(spark):
    text = plan(fx.ranks(spark, SF))
    assert not re.search(r"Exchange SinglePartition", text)


def test_filters_and_columns_reach_the_scan(spark):
    df = tables.read_bars(spark, store(spark, SF), start="1999-01-01", columns=["code", "c"], adj="raw")
    text = plan(df)
    assert "PartitionFilters: [isnotnull(adj_type" in text and "PushedFilters: [IsNotNull(d), GreaterThanOrEqual(d" in text
    assert re.search(r"ReadSchema: struct<code:string,d:date,c:double>", text)


def test_bars_combine_before_the_shuffle(spark):
    assert "partial_min_by" in plan(fx.bars(spark, SF)) and "SortAggregate" not in plan(fx.bars(spark, SF))
