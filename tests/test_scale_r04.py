"""Disk of batches carried on from stored states: what a batch writes for itself is slim, and gone after it."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from barscope import session
from barscope.operators import state
from barscope.operators.indicators import REGISTRY, with_indicators
from barscope.session import passing, scratch_path, shared_dir, written_once
from barscope.sources import store
from barscope.streaming.ingest import read_values, take_batch

ALL = ["kdj", "volume_ratio", "volume_ratio_prev", "bbi", "rsi", "diff"]
DAY = dt.date(2024, 1, 20)


def make_bars(spark, n=60):
    rows = [(c, DAY + dt.timedelta(days=i), 9.0 + i % 7, 12.0 + i % 7, 8.0 + i % 3, 10.0 + (i * k) % 5, 1.0 + i) for k, c in ((3, "a"), (4, "b")) for i in range(n)]
    return spark.createDataFrame(rows, "code string, d date, o double, h double, l double, c double, v double")


def at(k):
    return F.lit(DAY + dt.timedelta(days=k))


def scratch(spark):
    return {p.name for p in pathlib.Path(shared_dir(spark).removeprefix("file://")).rglob("rows-*")}


def test_a_batch_leaves_nothing_but_its_tables(spark):
    bars, root = make_bars(spark), scratch_path(spark, "carried")
    before, setting = scratch(spark), spark.conf.get(session.SHUFFLES)
    fix = bars.where((F.col("code") == "a") & (F.col("d") == at(5))).withColumn("c", F.col("c") + 3)
    take_batch(bars.where(F.col("d") < at(30)), 0, root, ALL)
    take_batch(bars.where(F.col("d") >= at(30)).unionByName(fix), 1, root, ALL)
    assert scratch(spark) == before and spark.conf.get(session.SHUFFLES) == setting
    outs = [REGISTRY[n].out for n in ALL]
    whole = with_indicators(bars.join(fix, ["code", "d"], "left_anti").unionByName(fix), ALL)
    assert sorted(map(tuple, read_values(spark, root).select("code", "d", *outs).collect())) == sorted(map(tuple, whole.select("code", "d", *outs).collect()))


def test_a_lost_batch_leaves_nothing_either(spark):
    before, setting = scratch(spark), spark.conf.get(session.SHUFFLES)
    with pytest.raises(RuntimeError, match="lost"), passing(spark):
        assert written_once(spark.range(3)).count() == 3 and scratch(spark) != before
        raise RuntimeError("lost")
    assert scratch(spark) == before and spark.conf.get(session.SHUFFLES) == setting
    kept = written_once(spark.range(3))
    assert kept.count() == 3 and len(scratch(spark) - before) == 1


def test_rows_of_new_partitions_are_not_joined(spark, monkeypatch):
    staged, plain = [], store.stage

    def spied(rows, *rest):
        staged.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return plain(rows, *rest)

    monkeypatch.setattr(store, "stage", spied)
    root, columns = scratch_path(spark, "stored"), "code string, d date, c double, v double, ym int"
    row = lambda code, m, c: (code, dt.date(2024, m, 1), c, 1.0, 202400 + m)
    store.create(spark.createDataFrame([row("a", 1, 1.0), row("b", 1, 2.0)], columns), root, ["code", "d"], "ym")
    store.upsert(spark.createDataFrame([row("a", 2, 3.0), row("b", 3, 4.0)], columns).drop("v"), root)
    assert "Join" not in staged[-1]
    # Some partitions are known: their rows are updated, the others' are as supplied.
    store.upsert(spark.createDataFrame([row("a", 1, 5.0), row("c", 1, 6.0), row("a", 4, 7.0)], columns).drop("v"), root)
    assert staged[-1].count("Join") == 1
    got = sorted((r.code, r.ym, r.c, r.v) for r in store.read(spark, root).collect())
    assert got == [("a", 202401, 5.0, 1.0), ("a", 202402, 3.0, None), ("a", 202404, 7.0, None), ("b", 202401, 2.0, 1.0), ("b", 202403, 4.0, None), ("c", 202401, 6.0, None)]


def test_averages_are_written_in_last_rows_only(spark, monkeypatch):
    made = []
    monkeypatch.setattr(state, "written_once", lambda df: made.append(written_once(df)) or made[-1])
    state.advance(None, make_bars(spark), ALL)
    (rows,) = made
    averages = [c for c in rows.columns if c.startswith("_next")]
    assert len(averages) == 6 and not [c for c in rows.columns if c.startswith(("_in_", "_wt_", "_lag_"))]
    assert all(r == 2 for r in rows.agg(*[F.count(c) for c in averages]).first())
