"""Tables the queries run on, derived from the driver's tables: Spark form and SQL form.

``bars`` treats each supplier as a symbol, so the number of series grows with the data while a
series stays as long as the calendar.  ``brand_bars`` groups by part brand instead: few, dense series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barscope.functions import series as ts
from barscope.functions.values import rnd
from barscope.operators.reach import looks_back
from barscope.operators.rules import Clause, Rule, evaluate, rule_details
from barscope.operators.scoring import rank_scores, score
from barscope.plans.registry import CTES, R, ewm_sql, lag, over, strict


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# Bars ------------------------------------------------------------------------------------------

def _ticks(li: DataFrame) -> DataFrame:
    p = rnd(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    net = rnd(F.col("p") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 2)
    return li.withColumn("p", p).withColumn("net", net).withColumn("d", F.to_date("l_shipdate"))


_KEY = "(l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576"


def _aggs():
    # All buffers are numbers, so the aggregation hashes and combines before the shuffle.
    return [
        F.min_by("p", F.expr(_KEY)).alias("o"), F.max(F.greatest("p", "net")).alias("h"),
        F.min(F.least("p", "net")).alias("l"), F.max_by("net", F.expr(_KEY)).alias("c"),
        F.sum("l_quantity").alias("v"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"),
    ]


def code_of(key) :
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 9, "0"))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    df = _ticks(load(spark, sf, "lineitem")).groupBy("l_suppkey", "d").agg(*_aggs())
    return df.select(code_of("l_suppkey").alias("code"), "d", "o", "h", "l", "c", "v", "amount")


def brand_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Per brand; the part table is joined by key, and broadcast only if the planner finds it small."""
    brand = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("code"))
    df = _ticks(load(spark, sf, "lineitem")).join(brand, "l_partkey")
    return df.groupBy("code", "d").agg(*_aggs())


def bench_bars(spark: SparkSession, sf: str) -> DataFrame:
    """One bar per date over all rows."""
    df = _ticks(load(spark, sf, "lineitem")).groupBy("d").agg(*_aggs())
    return df.withColumn("code", F.lit("ALL"))


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """The symbol list: suppliers, plus one code that has no bars."""
    own = load(spark, sf, "supplier").select(
        code_of("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("area")
    )
    return own.unionByName(spark.createDataFrame([("S999999999", "Unlisted", 0)], "code string, name string, area int"))


def calendar(b: DataFrame) -> DataFrame:
    from barscope.operators.calendar import trade_dates

    return trade_dates(b)


def basics(b: DataFrame, cal: DataFrame) -> DataFrame:
    """Turnover on even calendar days only, so that left joins miss."""
    even = F.broadcast(cal.where(F.col("idx") % 2 == 0))
    return b.join(even, "d").select("code", "d", (F.col("v") / 1000).alias("tor"))


def lists(spark: SparkSession, sf: str) -> DataFrame:
    """Even-numbered suppliers on the white list, the others on the black one."""
    s = load(spark, sf, "supplier")
    white = F.col("s_suppkey") % 2 == 0
    return s.select(code_of("s_suppkey").alias("code"), F.when(white, "white").otherwise("black").alias("list"))


CTES["ticks"] = """
SELECT *, round_even(p * (1 - l_discount) * (1 + l_tax) * 100.0, 0) / 100.0 AS net,
  CAST(l_shipdate AS DATE) AS d,
  (l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576 AS k
FROM (SELECT *, round_even(l_extendedprice / l_quantity * 100.0, 0) / 100.0 AS p FROM lineitem)"""

_AGG_SQL = """arg_min(p, k) AS o, max(greatest(p, net)) AS h, min(least(p, net)) AS l, arg_max(net, k) AS c,
  sum(l_quantity) AS v, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount"""
CODE = "'S' || lpad(CAST({} AS VARCHAR), 9, '0')"
CTES["bars"] = f"SELECT {CODE.format('l_suppkey')} AS code, d, {_AGG_SQL} FROM ticks GROUP BY l_suppkey, d"
CTES["brand_bars"] = (
    f"SELECT p_brand AS code, d, {_AGG_SQL} FROM ticks JOIN part ON p_partkey = l_partkey GROUP BY p_brand, d"
)
CTES["bench"] = f"SELECT d, {_AGG_SQL} FROM ticks GROUP BY d"
CTES["cal"] = "SELECT d, CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS idx FROM (SELECT DISTINCT d FROM bars)"
CTES["symbols"] = (
    f"SELECT {CODE.format('s_suppkey')} AS code, s_name AS name, s_nationkey AS area FROM supplier "
    "UNION ALL SELECT 'S999999999', 'Unlisted', 0"
)
CTES["basics"] = "SELECT code, d, v / 1000 AS tor FROM bars JOIN cal USING (d) WHERE idx % 2 = 0"
CTES["lists"] = (
    f"SELECT {CODE.format('s_suppkey')} AS code, "
    "CASE WHEN s_suppkey % 2 = 0 THEN 'white' ELSE 'black' END AS list FROM supplier"
)

# Events: short series ---------------------------------------------------------------------------

def event_bars(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").withColumn("d", F.to_date("ts"))
    return e.groupBy("user_id", "d").agg(
        F.min_by("value", "event_id").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"),
        F.max_by("value", "event_id").alias("c"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"),
        F.count(F.lit(1)).cast("double").alias("amount"),
    ).withColumn("code", F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 9, "0"))).drop("user_id")


CTES["event_bars"] = """
SELECT 'U' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS code, CAST(ts AS DATE) AS d,
  arg_min(value, event_id) AS o, max(value) AS h, min(value) AS l, arg_max(value, event_id) AS c,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS amount
FROM events GROUP BY user_id, CAST(ts AS DATE)"""

# Features and rules -----------------------------------------------------------------------------

@looks_back(19)
def features(df: DataFrame) -> DataFrame:
    """Columns the example rules read; what a rule set does not read is never computed."""
    return df.withColumns({
        "ma5": ts.ma("c", 5), "ma20": ts.ma("c", 20), "vma5": ts.ma("v", 5),
        "top20": ts.hhv("c", 20), "prev_c": ts.ref("c", 1),
    })


CROSS = "ma5 > ma20 and lag(ma5) over (partition by code order by d) <= lag(ma20) over (partition by code order by d)"

RULES = (
    Rule("golden", CROSS, 8, window=10, scope="ANY", back=1, explain="short average crossed the long one"),
    Rule("below", "c < ma20", -5, window=10, scope="COUNT>=3", explain="often below the long average"),
    Rule("streak", "c > prev_c", 4, window=10, scope="CONSEC>=3", explain="rose three bars in a row", tag="opportunity"),
    Rule("busy", "v > 1.5 * vma5", 1, window=5, scope="EACH", gate="c > ma5", explain="busy bars"),
    Rule("peak", "c >= top20", 0, scope="RECENT", bins=((0, 0, 6), (1, 3, 3), (4, 8, 1)), explain="recent peak"),
    Rule("week_up", "c > o", 2, timeframe="W", window=1, scope="LAST", explain="last week rose"),
    Rule("mixed", None, 3, clauses=(
        Clause("c > ma5", window=1, scope="LAST"), Clause("c > prev_c", "W", 3, "ANY")), explain="day and week agree"),
)
BLACKLIST = (
    Rule("crash", "c < 0.2 * prev_c", window=3, scope="ANY", reason="fell by four fifths", gate="1 = 0"),
    Rule("month_thin", "v < 20", timeframe="M", window=1, scope="LAST", reason="thin month"),
)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return score(bars(spark, sf), RULES, features)


def ranks(spark: SparkSession, sf: str) -> DataFrame:
    return rank_scores(scores(spark, sf))


def details(spark: SparkSession, sf: str) -> DataFrame:
    return rule_details(evaluate(bars(spark, sf), RULES, features, dates=True), RULES)


def feat_sql(source: str) -> str:
    return (
        f"SELECT *, {strict('avg', 'c', 5)} AS ma5, {strict('avg', 'c', 20)} AS ma20, "
        f"{strict('avg', 'v', 5)} AS vma5, {strict('max', 'c', 20)} AS top20, {lag('c')} AS prev_c FROM {source}"
    )


def resample_sql(source: str, freq: str) -> str:
    """Period bars with empty periods kept."""
    if freq == "W":
        pe = "d + CAST((5 - dayofweek(d) + 7) % 7 AS INTEGER)"
        grid = "range(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 7 DAY)"
        label = "CAST(g AS DATE)"
    else:
        pe = "last_day(d)"
        grid = "range(date_trunc('month', CAST(a AS TIMESTAMP)), CAST(b AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 MONTH)"
        label = "last_day(CAST(g AS DATE))"
    return (
        f"SELECT x.code, x.d, p.o, p.h, p.l, p.c, coalesce(p.v, 0) AS v, coalesce(p.amount, 0) AS amount FROM ("
        f"SELECT code, {label} AS d FROM (SELECT code, unnest({grid}) AS g FROM ("
        f"SELECT code, min({pe}) AS a, max({pe}) AS b FROM {source} GROUP BY code))) x LEFT JOIN ("
        f"SELECT code, {pe} AS d, arg_min(o, d) AS o, max(h) AS h, min(l) AS l, arg_max(c, d) AS c, "
        f"sum(v) AS v, sum(amount) AS amount FROM {source} GROUP BY code, {pe}) p ON p.code = x.code AND p.d = x.d"
    )


CTES["feat"] = feat_sql("bars")
CTES["weeks"] = resample_sql("bars", "W")
CTES["months"] = resample_sql("bars", "M")
CTES["wfeat"] = feat_sql("weeks")
CTES["mfeat"] = feat_sql("months")
CTES["wsig"] = (
    f"SELECT code, d AS pe, coalesce(c > o, false) AS w_up, "
    f"max(coalesce(c > prev_c, false)::INT) {over(3)} = 1 AS w_any FROM wfeat"
)
CTES["sig"] = f"""
SELECT *, CAST(row_number() OVER (PARTITION BY code ORDER BY d) AS INTEGER) AS rn,
  coalesce(ma5 > ma20 AND {lag('ma5')} <= {lag('ma20')}, false) AS s0,
  coalesce(c < ma20, false) AS s1, coalesce(c > prev_c, false) AS s2,
  coalesce(v > 1.5 * vma5, false) AND coalesce(c > ma5, false) AS s3, coalesce(c >= top20, false) AS s4,
  coalesce(c > ma5, false) AS s6,
  CASE WHEN dayofweek(d) = 5 THEN d ELSE d + CAST((5 - dayofweek(d) + 7) % 7 AS INTEGER) - 7 END AS pe
FROM feat"""
CTES["run3"] = f"SELECT *, (sum(s2::INT) {over(3)} = 3)::INT AS full3 FROM sig"
CTES["hits"] = f"""
SELECT x.*, coalesce(w_up, false) AS r5, s6 AND coalesce(w_any, false) AS r6 FROM (
SELECT *, max(s0::INT) {over(10)} = 1 AS r0, sum(s1::INT) {over(10)} >= 3 AS r1,
  max(full3) {over(8)} = 1 AS r2, CAST(sum(s3::INT) {over(5)} AS INTEGER) AS n3,
  CASE WHEN rn - max(CASE WHEN s4 THEN rn END) {over()} < 9
       THEN rn - max(CASE WHEN s4 THEN rn END) {over()} END AS lag4
FROM run3) x LEFT JOIN wsig ON wsig.code = x.code AND wsig.pe = x.pe"""
CTES["adds"] = """
SELECT *, CASE WHEN r0 THEN 8.0 ELSE 0.0 END AS a0, CASE WHEN r1 THEN -5.0 ELSE 0.0 END AS a1,
  CASE WHEN r2 THEN 4.0 ELSE 0.0 END AS a2, CAST(n3 AS DOUBLE) AS a3,
  CASE WHEN lag4 = 0 THEN 6.0 WHEN lag4 BETWEEN 1 AND 3 THEN 3.0 WHEN lag4 BETWEEN 4 AND 8 THEN 1.0 ELSE 0.0 END AS a4,
  CASE WHEN r5 THEN 2.0 ELSE 0.0 END AS a5, CASE WHEN r6 THEN 3.0 ELSE 0.0 END AS a6 FROM hits"""


def kdj_sql(source: str, tag: str) -> None:
    """CTEs ending in ``{tag}_j`` (code, d, j) over a bar table."""
    low, span = strict("min", "l", 9), f"({strict('max', 'h', 9)} - {strict('min', 'l', 9)})"
    CTES[f"{tag}_rsv"] = (
        f"SELECT code, d, CAST(row_number() OVER (PARTITION BY code ORDER BY d) AS INTEGER) AS rn, "
        f"100 * (c - {low}) / (CASE WHEN {span} = 0 THEN 1e-9 ELSE {span} END) AS rsv FROM {source}"
    )
    CTES[f"{tag}_k"] = ewm_sql("rsv", 1 / 3, True, f"{tag}_rsv", "k", mask=False)
    CTES[f"{tag}_kd"] = ewm_sql("k", 1 / 3, True, f"{tag}_k", "dd", mask=False)
    CTES[f"{tag}_j"] = f"SELECT code, d, CASE WHEN rn > 10 THEN {R('3 * k - 2 * dd', 2)} END AS j FROM {tag}_kd"


kdj_sql("bars", "day")
CTES["scores"] = """
SELECT code, d, greatest(50.0 + (a0 + a1 + a2 + a3 + a4 + a5 + a6), 0.0) AS score, j
FROM adds JOIN day_j USING (code, d)"""
CTES["ranks"] = f"""
SELECT code, d, {R('score', 3)} AS score, j,
  CAST(row_number() OVER (PARTITION BY d ORDER BY score DESC, j ASC NULLS LAST, code) AS INTEGER) AS rank,
  count(*) OVER (PARTITION BY d) AS total FROM scores"""
