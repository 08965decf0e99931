"""Resampling, calendar and date operators (R group, J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barscope.functions.values import day_text
from barscope.operators import calendar as cal
from barscope.operators.resample import last_finished, resample
from barscope.plans import fixtures as fx
from barscope.plans.registry import CTES, T, query, shown, sql_shown, with_

NUMS = ["o", "h", "l", "c", "v", "amount"]
# A stretch without any bars, so that whole periods are empty for every series.
CTES["gaps"] = "SELECT * FROM bars WHERE d NOT BETWEEN DATE '1997-03-01' AND DATE '1997-05-10'"
from barscope.plans.fixtures import resample_sql  # noqa: E402

CTES["gap_weeks"] = resample_sql("gaps", "W")
CTES["gap_months"] = resample_sql("gaps", "M")
CTES["gap_cal"] = "SELECT d, CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS idx FROM (SELECT DISTINCT d FROM gaps)"


def gaps(spark, sf):
    d = F.col("d")
    return fx.bars(spark, sf).where(~d.between(F.lit("1997-03-01").cast("date"), F.lit("1997-05-10").cast("date")))


def _all(source):
    return with_(source) + f"SELECT code, {sql_shown(['d'], NUMS, digits=2)} FROM {source}"


query("r1_weeks", with_("gap_weeks") + f"SELECT code, {sql_shown(['d'], NUMS, digits=2)} FROM gap_weeks WHERE o IS NOT NULL")(
    lambda spark, sf: shown(resample(gaps(spark, sf), "W", keep_gaps=False), ["d"], NUMS, ["code"], 2))
query("r2_months", with_("gap_months") + f"SELECT code, {sql_shown(['d'], NUMS, digits=2)} FROM gap_months WHERE o IS NOT NULL")(
    lambda spark, sf: shown(resample(gaps(spark, sf), "M", keep_gaps=False), ["d"], NUMS, ["code"], 2))
query("r3_weeks_with_gaps", _all("gap_weeks"))(
    lambda spark, sf: shown(resample(gaps(spark, sf), "W"), ["d"], NUMS, ["code"], 2))
query("r3_months_with_gaps", _all("gap_months"))(
    lambda spark, sf: shown(resample(gaps(spark, sf), "M"), ["d"], NUMS, ["code"], 2))


@query("r4_finished_periods", with_("bars", "weeks", "months") + f"""
SELECT b.code, {T('b.d')} AS d, (SELECT 1) AS one,
  {T('max(w.d)')} AS week, {T('max(m.d)')} AS month FROM bars b
LEFT JOIN weeks w ON w.code = b.code AND w.d <= b.d AND w.d > b.d - 7
LEFT JOIN months m ON m.code = b.code AND m.d <= b.d AND m.d > b.d - 31 GROUP BY b.code, b.d""")
def r4(spark, sf):
    b = fx.bars(spark, sf)
    out = b.select("code", "d", last_finished("d", "W").alias("pw"), last_finished("d", "M").alias("pm"))
    w = resample(b, "W").select("code", F.col("d").alias("pw"), F.col("d").alias("week"))
    m = resample(b, "M").select("code", F.col("d").alias("pm"), F.col("d").alias("month"))
    out = out.join(w, ["code", "pw"], "left").join(m, ["code", "pm"], "left")
    return out.select("code", day_text("d").alias("d"), F.lit(1).alias("one"), day_text("week").alias("week"),
                      day_text("month").alias("month"))


@query("r5_calendar", with_("cal") + f"SELECT {T('d')} AS d, idx FROM cal")
def r5(spark, sf):
    return shown(cal.trade_dates(fx.bars(spark, sf)), ["d"], [], ["idx"])


@query("r5_latest", with_("cal") + f"SELECT {T('max(d)')} AS d FROM cal")
def r5_latest(spark, sf):
    return shown(cal.latest_date(fx.bars(spark, sf)), ["d"])


@query("r5_recent", with_("cal") + f"SELECT {T('d')} AS d FROM cal ORDER BY cal.d DESC LIMIT 30")
def r5_recent(spark, sf):
    return shown(cal.recent_dates(fx.bars(spark, sf), 30), ["d"])


# Every calendar day as a reference date, trading day or not.
CTES["alldays"] = "SELECT CAST(g AS DATE) AS d FROM (SELECT unnest(range(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 DAY)) AS g FROM gaps)"


def all_days(b):
    return b.agg(F.explode(F.sequence(F.min("d"), F.date_sub(F.max("d"), 1), F.expr("interval 1 day"))).alias("d"))


@query("r6_prev_trade_date", with_("alldays", "gap_cal") + f"""
SELECT {T('a.d')} AS d, {T('max(c.d)')} AS prev_d FROM alldays a LEFT JOIN gap_cal c ON c.d < a.d GROUP BY a.d""")
def r6(spark, sf):
    b = gaps(spark, sf)
    return shown(cal.prev_trade_date(fx.calendar(b), all_days(b)), ["d", "prev_d"])


@query("r7_start_for", with_("alldays", "gap_cal") + f"""
SELECT {T('x.d')} AS d, {T('s.d')} AS start FROM (
  SELECT a.d, greatest(max(c.idx) - 20, 1) AS idx FROM alldays a JOIN gap_cal c ON c.d <= a.d GROUP BY a.d) x
JOIN gap_cal s USING (idx)""")
def r7(spark, sf):
    b = gaps(spark, sf)
    return shown(cal.start_for(fx.calendar(b), all_days(b), 20), ["d", "start"])


@query("r8_trade_span", with_("cal") + f"""
SELECT {T('d')} AS d, 'range' AS kind FROM cal WHERE d BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'
UNION ALL SELECT {T('d')}, 'last' FROM (SELECT d FROM cal WHERE d <= DATE '1999-12-31' ORDER BY d DESC LIMIT 60)""")
def r8(spark, sf):
    days = fx.calendar(fx.bars(spark, sf))
    a = cal.trade_span(days, "1998-01-01", "1999-12-31").withColumn("kind", F.lit("range"))
    b = cal.trade_span(days, end="1999-12-31", n=60).withColumn("kind", F.lit("last"))
    return shown(a.unionByName(b), ["d"], [], ["kind"])


@query("r10_date_gaps", with_("gap_cal") + f"""
SELECT {T('d')} AS d, {T('n')} AS next_d, CAST(n - d AS INTEGER) AS days FROM (
SELECT d, lead(d) OVER (ORDER BY d) AS n FROM gap_cal) WHERE n - d > 21""")
def r10(spark, sf):
    return shown(cal.date_gaps(gaps(spark, sf)), ["d", "next_d"], [], ["days"])


@query("r11_missing_dates", with_("cal", "gap_cal") + f"SELECT {T('d')} AS d FROM (SELECT d FROM cal EXCEPT SELECT d FROM gap_cal)")
def r11(spark, sf):
    return shown(cal.missing_dates(fx.calendar(fx.bars(spark, sf)), gaps(spark, sf)), ["d"])


@query("r12_ref_date", with_("gaps") + f"""
SELECT {T('max(d)')} AS newest, {T("coalesce(max(CASE WHEN d = DATE '1998-06-15' THEN d END), max(d))")} AS given,
  {T("coalesce(max(CASE WHEN d = DATE '1997-04-01' THEN d END), max(d))")} AS without_data FROM gaps""")
def r12(spark, sf):
    b = gaps(spark, sf)
    one = [cal.pick_ref_date(b, c).select(day_text("d").alias(n), F.lit(1).alias("k"))
           for n, c in (("newest", None), ("given", "1998-06-15"), ("without_data", "1997-04-01"))]
    return one[0].join(one[1], "k").join(one[2], "k").drop("k")


@query("j11_window_dates", with_("cal") + f"""
SELECT {T('e.d')} AS end_d, e.idx AS end_idx, {T('c.d')} AS d, c.idx FROM cal e JOIN cal c ON c.idx BETWEEN e.idx - 4 AND e.idx""")
def j11(spark, sf):
    return shown(cal.window_dates(fx.calendar(fx.bars(spark, sf)), 5), ["end_d", "d"], [], ["end_idx", "idx"])


@query("u2_merge_calendar", with_("bars", "event_bars") + f"SELECT {T('d')} AS d FROM (SELECT d FROM bars UNION SELECT d FROM event_bars)")
def u2(spark, sf):
    return shown(cal.merge_calendar(fx.bars(spark, sf), fx.event_bars(spark, sf)), ["d"])
