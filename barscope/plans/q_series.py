"""Trailing windows, recursive averages and indicators (T and I groups)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barscope.functions import series as ts
from barscope.functions import values as val
from barscope.functions.smoothing import ema, ewm_seeded, sma, with_ewm
from barscope.operators import indicators as ind
from barscope.operators.rules import Clause, Rule, rule_tags, tag_columns
from barscope.plans import fixtures as fx
from barscope.plans.registry import CTES, R, T, WIN, ewm_sql, lag, over, query, shown, sql_shown, strict, with_
from barscope.session import passing, scratch_path
from barscope.streaming.ingest import read_values, stream_indicators, take_batch

# Closes with holes, so windows meet missing values.
CTES["holes"] = (
    "SELECT *, CASE WHEN v <= 40 THEN c END AS x, "
    "CAST(row_number() OVER (PARTITION BY code ORDER BY d) AS INTEGER) AS rn FROM bars"
)


def holes(spark, sf):
    return fx.bars(spark, sf).withColumn("x", F.when(F.col("v") <= 40, F.col("c")))


def column(name: str, sql: str, fn, digits: int = 6, source: str = "holes", make=holes):
    """Register a query that adds one numeric column."""
    text = with_(source) + f"SELECT code, {T('d')} AS d, {R('y', digits)} AS y FROM (SELECT *, {sql} AS y FROM {source})"

    @query(name, text)
    def run(spark, sf):
        return shown(make(spark, sf).withColumn("y", fn()), ["d"], ["y"], ["code"], digits)


column("t01_ref", f"coalesce({lag('c', 3)}, -1) + coalesce(lead(c, 2) OVER ({WIN}), -1)",
       lambda: F.coalesce(ts.ref("c", 3), F.lit(-1.0)) + F.coalesce(ts.ref("c", -2), F.lit(-1.0)))
column("t02_ma", strict("avg", "x", 5), lambda: ts.ma("x", 5), 4)
column("t03_sum", strict("sum", "x", 5), lambda: ts.sum_n("x", 5), 4)
column("t04_hhv", strict("max", "x", 5), lambda: ts.hhv("x", 5))
column("t05_llv", strict("min", "x", 5), lambda: ts.llv("x", 5))
column("t06_std", strict("stddev_pop", "x", 5), lambda: ts.std_n("x", 5), 3)
column("t07_count", f"sum(coalesce(x > o, false)::INT) {over(10)}", lambda: ts.count_n(F.col("x") > F.col("o"), 10))
column("t08_barslast", f"rn - max(CASE WHEN x > o THEN rn END) {over()}",
       lambda: ts.barslast(F.col("x") > F.col("o")))
column("t09_cross", f"coalesce(x > o AND {lag('x')} <= {lag('o')}, false)::INT + 2 * coalesce(x > 2000 AND {lag('x')} <= 2000, false)::INT",
       lambda: ts.cross("x", "o").cast("int") + 2 * ts.cross_level("x", 2000.0).cast("int"))
_low, _high = strict("min", "l", 9), strict("max", "h", 9)
column("t12_rsv", f"(c - {_low}) * 100 / ({_high} - {_low} + 1e-12)", lambda: ts.rsv("c", "h", "l", 9), 4)
_at_most = f"len(list_filter(list(x) {over(20)}, lambda e: e <= x))"
column("t13_ts_pct", f"CASE WHEN count(x) {over(20)} = 20 THEN {_at_most} / 20.0 END", lambda: ts.ts_pct("x", 20))
column("t14_ts_rank", f"CASE WHEN count(c) {over(20)} = 20 THEN len(list_filter(list(c) {over(20)}, lambda e: e <= c)) END",
       lambda: ts.ts_rank("c", 20))


def prior(n: int) -> str:
    return f"OVER ({WIN} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


column("t15_get", f"struct_extract(last_value(CASE WHEN x > o THEN {{'p': h}} END IGNORE NULLS) {prior(20)}, 'p')",
       lambda: ts.get_last(F.col("x") > F.col("o"), "h", 20))
CTES["rise"] = f"SELECT *, {lag('c')} AS pc FROM bars"
column("t15_get_limit_up",
       f"last_value(CASE WHEN c / (pc + 1e-12) >= 1 + 0.095 * 0.98 THEN c END IGNORE NULLS) {prior(5)}",
       lambda: ts.get_last(ts.limit_up_bar(), "c", 5), source="rise", make=fx.bars)
CTES["jrsv"] = f"SELECT *, CASE WHEN v <= 40 THEN c - o END AS jj, CAST(row_number() OVER ({WIN}) AS INTEGER) AS rn FROM bars"


def jrsv(spark, sf):
    return fx.bars(spark, sf).withColumn("jj", F.when(F.col("v") <= 40, F.col("c") - F.col("o")))


column("t16_close_at_lowest",
       f"CASE WHEN rn > 30 THEN arg_min(c, CASE WHEN jj < 13 THEN {{'j': jj, 'k': -rn}} END) {prior(30)} END",
       lambda: ts.close_at_lowest("jj", 13.0, 30), source="jrsv", make=jrsv)
column("t17_price_if", "CASE WHEN x > o AND rn > 20 THEN c END", lambda: ts.price_if(F.col("x") > F.col("o"), 20))


@query("t18_at_max", with_("jrsv") + f"""
SELECT code, {R('coalesce(max(jj), 0)')} AS value,
  {R("coalesce(arg_max(c, CASE WHEN jj IS NOT NULL THEN {'j': jj, 'k': -rn} END), 0)")} AS price FROM jrsv GROUP BY code""")
def t18(spark, sf):
    return shown(ts.at_max(jrsv(spark, sf), "jj", "c"), [], ["value", "price"], ["code"])


TAGGED = (
    Rule("rise", "c > o", tag="trend"), Rule("wide", "h > 1.2 * l", tag="range"), Rule("thin", "v < 10", tag="trend"),
)
CTES["tags"] = "SELECT *, c > o AS t_rise, h > 1.2 * l AS r_wide, v < 10 AS t_thin FROM bars"


@query("t19_t22_tags", with_("tags") + f"""
SELECT code, {T('d')} AS d, t_rise OR t_thin AS any_trend, t_thin OR r_wide AS any_regex,
  coalesce({lag('t_rise')}, false) AS yday_rise, t_rise::INT + t_thin::INT + r_wide::INT AS hits_all,
  coalesce({lag('t_rise')}::INT + {lag('t_thin')}::INT, 0) AS yday_hits,
  t_rise::INT + t_thin::INT + r_wide::INT >= 2 AS two_hits,
  coalesce({lag('t_rise')}::INT + {lag('t_thin')}::INT + {lag('r_wide')}::INT, 0) >= 2 AS yday_two FROM tags""")
def t19(spark, sf):
    df, names = tag_columns(fx.bars(spark, sf), TAGGED)
    return df.select(
        "code", val.day_text("d").alias("d"),
        ts.any_tag(names, "trend").alias("any_trend"), ts.any_tag(names, "thin|wide").alias("any_regex"),
        ts.yday_any_tag(names, "rise").alias("yday_rise"), ts.tag_hits(names, "::").alias("hits_all"),
        ts.yday_tag_hits(names, "trend").alias("yday_hits"),
        ts.any_tag_at_least(names, "::", 2).alias("two_hits"),
        ts.yday_any_tag_at_least(names, "::", 2).alias("yday_two"),
    )


@query("w19_rule_tags", with_("tags") + f"""
SELECT code, {T('d')} AS d, bucket, name FROM (
  SELECT code, d, 'trend' AS bucket, 'rise' AS name, t_rise AS on_ FROM tags UNION ALL
  SELECT code, d, 'range', 'wide', r_wide FROM tags UNION ALL SELECT code, d, 'trend', 'thin', t_thin FROM tags)
WHERE on_""")
def w19(spark, sf):
    out = rule_tags(fx.bars(spark, sf), TAGGED)
    return shown(out, ["d"], [], ["code", "bucket", "name"])


@query("t19_columns", with_("tags") + f"""
SELECT code, {T('d')} AS d, t_rise AS any_case, t_thin OR v > 60 AS any_column, t_rise::INT + t_thin::INT AS bucket_hits,
  (v > 60)::INT AS column_hits, coalesce({lag('t_rise')} OR {lag('r_wide')}, false) AS yday FROM tags""")
def t19_columns(spark, sf):
    """Names match without regard to case, over tags and table columns; counts look for a bucket of that name first."""
    df, names = tag_columns(fx.bars(spark, sf).withColumn("very_thin_or_fat", F.col("v") > 60), TAGGED)
    own = ["very_thin_or_fat"]
    return df.select(
        "code", val.day_text("d").alias("d"), ts.any_tag(names, "RISE").alias("any_case"),
        ts.any_tag(names, "Thin", columns=own).alias("any_column"), ts.tag_hits(names, "TREND", columns=own).alias("bucket_hits"),
        ts.tag_hits(names, "thin", columns=own).alias("column_hits"), ts.yday_any_tag(names, "rise|WIDE").alias("yday"),
    )


CLAUSE_TAGS = (
    Rule("both", None, tag="mix", clauses=(Clause("c > o"), Clause("v > 10"))), Rule("after", "`mix::both` AND h > 1.1 * l", tag="late"),
    Rule("weekly", "c > o", timeframe="W", tag="mix"),
)


@query("w19_clause_tags", with_("tags") + f"""
SELECT code, {T('d')} AS d, bucket, name FROM (SELECT code, d, 'mix' AS bucket, 'both' AS name, t_rise AND v > 10 AS on_ FROM tags
UNION ALL SELECT code, d, 'late', 'after', t_rise AND v > 10 AND h > 1.1 * l FROM tags) WHERE on_""")
def w19_clauses(spark, sf):
    """Clauses must all hold, later tags read earlier ones, week rules publish no day tags."""
    return shown(rule_tags(fx.bars(spark, sf), CLAUSE_TAGS), ["d"], [], ["code", "bucket", "name"])


# Recursive averages: SQL folds the recursion, Spark uses the window form.

CTES["ema_x"] = ewm_sql("x", 2 / 13, False, "holes", "y")
CTES["sma_x"] = ewm_sql("x", 1 / 7, False, "holes", "y")


def averaged(make_avg):
    def run(spark, sf):
        return shown(with_ewm(holes(spark, sf), [make_avg]), ["d"], ["y"], ["code"], 2)
    return run


query("t10_ema", with_("ema_x") + f"SELECT code, {sql_shown(['d'], ['y'], digits=2)} FROM ema_x")(averaged(ema("y", "x", 12)))
query("t11_sma", with_("sma_x") + f"SELECT code, {sql_shown(['d'], ['y'], digits=2)} FROM sma_x")(averaged(sma("y", "x", 7, 1)))
CTES["seeded"] = ewm_sql("x", 2 / 13, False, "holes", "y").replace(over(), over(30))


@query("t10_ema_seeded", with_("seeded") + f"SELECT code, {sql_shown(['d'], ['y'], digits=2)} FROM seeded")
def t10_seeded(spark, sf):
    return shown(holes(spark, sf).withColumn("y", ewm_seeded("x", 2 / 13, 30)), ["d"], ["y"], ["code"], 2)


CTES["ev_holes"] = (
    "SELECT *, CASE WHEN amount <= 3 THEN c END AS x, "
    "CAST(row_number() OVER (PARTITION BY code ORDER BY d) AS INTEGER) AS rn FROM event_bars"
)
CTES["ev_ema"] = ewm_sql("x", 2 / 13, False, "ev_holes", "y")


@query("t23_moving_average_ema", with_("ev_ema") + f"""
SELECT code, {T('d')} AS d, {R(strict('avg', 'c', 10), 4)} AS mean, {R('y', 4)} AS y FROM ev_ema""")
def t23(spark, sf):
    df = fx.event_bars(spark, sf).withColumn("x", F.when(F.col("amount") <= 3, F.col("c")))
    df = with_ewm(df, [ema("y", "x", 12)]).withColumn("mean", ts.ma("c", 10))
    return shown(df, ["d"], ["mean", "y"], ["code"], 4)


# Indicators.

# Prices in whole cents: sums are exact, so halves round alike in both engines.
CTES["cents"] = (
    "SELECT code, d, round_even(o * 100, 0) AS o, round_even(h * 100, 0) AS h, round_even(l * 100, 0) AS l, "
    "round_even(c * 100, 0) AS c, v, amount FROM bars"
)
fx.kdj_sql("cents", "cent")


def cents(spark, sf):
    return fx.bars(spark, sf).withColumns({n: F.rint(F.col(n) * 100) for n in "ohlc"})


CTES["delta"] = (
    f"SELECT code, d, rn, greatest(dc, 0) AS up, abs(dc) AS size FROM ("
    f"SELECT *, c - {lag('c')} AS dc, CAST(row_number() OVER ({WIN}) AS INTEGER) AS rn FROM cents)"
)
CTES["delta_up"] = ewm_sql("up", 1 / 12, False, "(SELECT code, d, rn, CASE WHEN size IS NOT NULL THEN up END AS up, size FROM delta)", "su")
CTES["delta_both"] = ewm_sql("size", 1 / 12, False, "delta_up", "sa")
CTES["close_n"] = f"SELECT *, CAST(row_number() OVER ({WIN}) AS INTEGER) AS rn FROM cents"
CTES["e12"] = ewm_sql("c", 2 / 13, False, "close_n", "e12")
CTES["e26"] = ewm_sql("c", 2 / 27, False, "e12", "e26")


def indicator(name: str, reg: str, out: str, source: str, value: str, warm: int, digits: int):
    text = with_(source) + f"SELECT code, {T('d')} AS d, CASE WHEN rn > {warm} THEN {R(value, digits)} END AS {out} FROM {source}"

    @query(name, text)
    def run(spark, sf):
        return shown(ind.with_indicators(cents(spark, sf), [reg]), ["d"], [out], ["code"], digits)


query("i1_kdj", with_("day_j") + f"SELECT code, {T('d')} AS d, j FROM day_j")(
    lambda spark, sf: shown(ind.with_indicators(fx.bars(spark, sf), ["kdj"]), ["d"], ["j"], ["code"], 2))
indicator("i2_volume_ratio", "volume_ratio", "vr", "close_n", f"v / ({strict('avg', 'v', 20)} + 1e-12)", 20, 4)
indicator("i3_volume_ratio_prev", "volume_ratio_prev", "vr_prev", "close_n", f"v / ({lag('v')} + 1e-12)", 2, 4)
indicator("i4_bbi", "bbi", "bbi", "close_n",
          f"({strict('avg', 'c', 3)} + {strict('avg', 'c', 6)} + {strict('avg', 'c', 12)} + {strict('avg', 'c', 24)}) / 4", 24, 2)
indicator("i5_rsi", "rsi", "rsi", "delta_both", "su / (sa + 1e-12) * 100", 12, 2)
indicator("i6_diff", "diff", "diff", "e26", "e12 - e26", 26, 2)
CTES["tp"] = "SELECT *, (h + l + c) / 3 AS tp FROM bars"
CTES["tpm"] = f"SELECT *, {strict('avg', 'tp', 14)} AS m, list(tp) {over(14)} AS tps FROM tp"


@query("i7_cci", with_("tpm") + f"""
SELECT code, {T('d')} AS d, {R("(tp - m) / nullif(0.015 * (list_sum(list_transform(tps, lambda e: abs(e - m))) / 14), 0)", 4)} AS cci
FROM tpm""")
def i7(spark, sf):
    return shown(fx.bars(spark, sf).withColumn("cci", ind.cci(14)), ["d"], ["cci"], ["code"], 4)


ALL = ["kdj", "volume_ratio", "volume_ratio_prev", "bbi", "rsi", "diff"]
CTES["all_ind"] = f"""
SELECT e26.code, e26.d, e26.rn, j, {R(f"v / ({strict('avg', 'v', 20)} + 1e-12)", 4)} AS vr0,
  {R(f"v / ({lag('v')} + 1e-12)", 4)} AS vp0,
  {R(f"({strict('avg', 'c', 3)} + {strict('avg', 'c', 6)} + {strict('avg', 'c', 12)} + {strict('avg', 'c', 24)}) / 4", 2)} AS bbi0,
  {R('su / (sa + 1e-12) * 100', 2)} AS rsi0, {R('e12 - e26', 2)} AS diff0
FROM e26 JOIN cent_j USING (code, d) JOIN delta_both USING (code, d)""".replace(WIN, "PARTITION BY e26.code ORDER BY e26.d")
_ALL_SQL = (
    "j, CASE WHEN rn > 20 THEN vr0 END AS vr, CASE WHEN rn > 2 THEN vp0 END AS vr_prev, "
    "CASE WHEN rn > 24 THEN bbi0 END AS bbi, CASE WHEN rn > 12 THEN rsi0 END AS rsi, CASE WHEN rn > 26 THEN diff0 END AS diff"
)


@query("i8_compute_all", with_("all_ind") + f"SELECT code, {T('d')} AS d, {_ALL_SQL} FROM all_ind")
def i8(spark, sf):
    out = ind.with_indicators(cents(spark, sf), ALL)
    return out.select("code", val.day_text("d").alias("d"), "j", "vr", "vr_prev", "bbi", "rsi", "diff")


# New bars arrive from 2001 on and replace a stored bar of the same date (with twice the volume).
INC = ["volume_ratio", "bbi"]
CTES["inc"] = """
SELECT code, d, o, h, l, c, CASE WHEN d >= DATE '2001-01-01' THEN 2 * v ELSE v END AS v, amount FROM cents"""
CTES["inc_rows"] = """
SELECT *, row_number() OVER (PARTITION BY code ORDER BY d) AS rn FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS back FROM inc WHERE d < DATE '2001-01-01')
  WHERE back <= 34 UNION ALL SELECT *, 0 AS back FROM inc WHERE d >= DATE '2001-01-01')"""


@query("i11_incremental", with_("inc_rows") + f"""
SELECT code, {T('d')} AS d, CASE WHEN rn > 20 THEN {R('vr', 4)} END AS vr, CASE WHEN rn > 24 THEN {R('bbi', 2)} END AS bbi FROM (
SELECT *, v / ({strict('avg', 'v', 20)} + 1e-12) AS vr,
  ({strict('avg', 'c', 3)} + {strict('avg', 'c', 6)} + {strict('avg', 'c', 12)} + {strict('avg', 'c', 24)}) / 4 AS bbi
FROM inc_rows) WHERE d >= DATE '2001-01-01'""")
def i11(spark, sf):
    b = cents(spark, sf)
    new = b.where(F.col("d") >= F.lit("2001-01-01").cast("date")).withColumn("v", F.col("v") * 2)
    return shown(ind.indicators_incremental(b, new, INC), ["d"], [], ["code", "vr", "bbi"])


def _between(b, start: str, end: str):
    return b.where((F.col("d") >= F.lit(start).cast("date")) & (F.col("d") < F.lit(end).cast("date")))


def _carried(spark, root: str):
    return shown(read_values(spark, root), ["d"], [], ["code", *[ind.REGISTRY[n].out for n in ALL]])


@query("i11_state", with_("all_ind") + f"SELECT code, {T('d')} AS d, {_ALL_SQL} FROM all_ind")
def i11_state(spark, sf):
    """Six indicators over three batches from stored states. The first has wrong prices of some codes; the last corrects them."""
    b, root = cents(spark, sf), scratch_path(spark, "carried")
    doubtful = F.col("code").like("%7") & (F.col("d") >= F.lit("1994-06-01").cast("date"))
    first = _between(b, "1900-01-01", "1995-01-01")
    take_batch(first.withColumn("c", F.when(doubtful, F.col("c") + 100).otherwise(F.col("c"))), 0, root, ALL)
    take_batch(_between(b, "1995-01-01", "1998-01-01"), 1, root, ALL)
    take_batch(_between(b, "1998-01-01", "2100-01-01").unionByName(first.where(doubtful)), 2, root, ALL)
    return _carried(spark, root)


@query("s19_stream_indicators", with_("all_ind") + f"SELECT code, {T('d')} AS d, {_ALL_SQL} FROM all_ind")
def s19_indicators(spark, sf):
    """Three deliveries of files, each taken up by a stream that goes on from the stored states."""
    b = cents(spark, sf).withColumn("seq", F.lit(1))
    landing, root, offsets = (scratch_path(spark, n) for n in ("landing", "streamed", "offsets"))
    for start, end in (("1900-01-01", "1996-01-01"), ("1996-01-01", "1997-01-01"), ("1997-01-01", "2100-01-01")):
        with passing(spark):
            _between(b, start, end).write.mode("append").parquet(landing)
        stream_indicators(spark, landing, b.schema, root, ALL, offsets).awaitTermination()
    return _carried(spark, root)
