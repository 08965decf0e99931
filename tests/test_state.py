"""Indicators carried on from a state equal those of the full run, however the bars are cut into batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barscope.operators.indicators import REGISTRY, with_indicators
from barscope.operators.state import advance, late, rebuild

ALL = ["kdj", "volume_ratio", "volume_ratio_prev", "bbi", "rsi", "diff"]
OUT = [REGISTRY[n].out for n in ALL]
SCHEMA = "code string, d date, o double, h double, l double, c double, v double"
DAY = dt.date(2024, 1, 1)


def make_bars(spark, holes=0.0, seed=3, lengths=(5, 40, 90, 400)):
    rng, rows = random.Random(seed), []
    for k, n in enumerate(lengths):
        c = 20.0
        for i in range(n):
            c = round(max(1.0, c + rng.uniform(-1, 1)), 2)
            px = None if rng.random() < holes else c
            rows.append((f"s{k}", DAY + dt.timedelta(days=i), c, c + 1, c - 1, px, float(rng.randint(1, 99))))
    rows += [("late", DAY + dt.timedelta(days=60 + i), 5.0, 6.0, 4.0, 5.0 + i % 3, 7.0) for i in range(30)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def at(k):
    return F.lit(DAY + dt.timedelta(days=k))


def compared(df):
    return {(r.code, r.d): tuple(r[n] for n in OUT) for r in df.collect()}


def in_batches(bars, cuts):
    state, values = None, None
    for lo, hi in zip((0, *cuts), (*cuts, 10_000)):
        part = bars.where((F.col("d") >= at(lo)) & (F.col("d") < at(hi)))
        got, new = advance(state, part, ALL)
        # Codes without bars in the batch keep their state.
        state = new if state is None else state.join(new, "code", "left_anti").unionByName(new)
        values = got if values is None else values.unionByName(got)
    return values, state


@pytest.mark.parametrize("holes", [0.0, 0.2])
def test_three_batches_equal_the_full_run(spark, holes):
    bars = make_bars(spark, holes)
    values, state = in_batches(bars, (38, 70))
    want = compared(with_indicators(bars, ALL))
    assert compared(values) == want and len(want) == 565
    assert {r.code: r.n for r in state.collect()} == {"s0": 5, "s1": 40, "s2": 90, "s3": 400, "late": 30}


def test_single_days(spark):
    bars = make_bars(spark, 0.3, lengths=(34, 31)).where("code <> 'late'")
    values, _ = in_batches(bars, (30, 31, 32, 33))
    assert compared(values) == compared(with_indicators(bars, ALL))


def test_averages_do_not_drift(spark):
    bars = make_bars(spark, 0.1, lengths=(400,))
    _, cut = in_batches(bars, (37, 120, 260))
    _, whole = advance(None, bars, ALL)
    for r, s in zip(cut.orderBy("code").collect(), whole.orderBy("code").collect()):
        assert r.ring == s.ring and r.n == s.n and r.d == s.d
        for name in [n for n in r.asDict() if n.startswith("seed")]:
            assert r[name].y == pytest.approx(s[name].y, rel=1e-12) and r[name].wt == pytest.approx(s[name].wt, rel=1e-9)
            assert r[name].lag == s[name].lag


def test_a_corrected_bar_is_rebuilt(spark):
    bars = make_bars(spark)
    values, state = in_batches(bars, (50,))
    fix = bars.where((F.col("code") == "s2") & (F.col("d") == at(30))).withColumn("c", F.col("c") + 3)
    again = late(state, fix)
    assert [(r.code, r.since) for r in again.collect()] == [("s2", DAY + dt.timedelta(days=30))]
    none, same = advance(state, fix, ALL)
    assert none.count() == 0 and same.count() == 1  # a passed bar changes nothing by itself
    corrected = bars.join(fix, ["code", "d"], "left_anti").unionByName(fix)
    new, _ = rebuild(corrected, again, ALL)
    got = compared(values) | compared(new)
    assert got == compared(with_indicators(corrected, ALL)) and got != compared(values)


def test_odd_batches(spark):
    bars = make_bars(spark).where("code = 's1'").withColumn("note", F.lit("x"))
    _, state = advance(None, bars.where(F.col("d") < at(30)), ALL)
    values, new = advance(state, bars.limit(0), ALL)
    assert values.count() == 0 and new.count() == 0
    _, nothing = advance(None, bars.limit(0), ALL)
    values, _ = advance(nothing, bars, ["volume_ratio"])
    assert values.columns == [*bars.columns, "vr"] and values.where("vr is not null").count() == 20
    missing = bars.withColumn("c", F.lit(None).cast("double"))
    _, none = advance(None, missing.where(F.col("d") < at(30)), ALL)
    values, _ = advance(none, bars.where(F.col("d") >= at(30)), ALL)
    half = missing.where(F.col("d") < at(30)).unionByName(bars.where(F.col("d") >= at(30)))
    later = with_indicators(half, ALL).where(F.col("d") >= at(30))
    assert compared(values) == compared(later)


def test_stored_batches_with_a_retry_and_a_correction(spark, monkeypatch):
    from barscope.session import scratch_path
    from barscope.sources import store
    from barscope.streaming.ingest import read_values, take_batch

    root = scratch_path(spark, "carried")
    bars = make_bars(spark, lengths=(40, 90))
    days = lambda lo, hi: bars.where((F.col("d") >= at(lo)) & (F.col("d") < at(hi)))
    fix = bars.where((F.col("code") == "s1") & (F.col("d") == at(20))).withColumn("c", F.col("c") + 3)
    take_batch(days(0, 35), 0, root, ALL)
    second = days(35, 60).unionByName(fix)

    def gone(updates, path, keys, part, notes=None, put=store.put):
        if path.endswith("/states"):
            raise RuntimeError("driver lost")
        return put(updates, path, keys, part, notes)

    with monkeypatch.context() as m:
        m.setattr(store, "put", gone)
        with pytest.raises(RuntimeError, match="driver lost"):
            take_batch(second, 1, root, ALL)
    take_batch(second, 1, root, ALL)
    before = store.current(spark, f"{root}/values")
    take_batch(second.withColumn("c", F.lit(1.0)), 1, root, ALL)  # delivered again after its commit
    assert store.current(spark, f"{root}/values") == before
    take_batch(days(60, 1000), 2, root, ALL)
    whole = bars.join(fix, ["code", "d"], "left_anti").unionByName(fix)
    assert compared(read_values(spark, root)) == compared(with_indicators(whole, ALL))
