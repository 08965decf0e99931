"""Cleaning, filters and row-wise functions (P and F groups), and simple joins (J group)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barscope.functions import scopes
from barscope.functions import values as val
from barscope.functions.values import day_text
from barscope.operators import benchmark, clean, research, status
from barscope.operators.custom import trigger_dates
from barscope.plans import fixtures as fx
from barscope.plans.q_sources import PX, BARS_SQL, bars_out, plain_ranks
from barscope.plans.registry import CTES, R, T, WIN, lag, out_num, over, query, shown, sql_shown, strict, with_

# Raw rows as they arrive: one per line item, text dates (some broken), copies of a day, given changes.
CTES["raw"] = f"""
SELECT {fx.CODE.format('l_suppkey')} AS code, CASE WHEN l_linenumber < 7 THEN d END AS d, k AS seq, p AS o,
  greatest(p, net) AS h, least(p, net) AS l, net AS c, CASE WHEN l_quantity <> 13 THEN l_quantity END AS v,
  l_extendedprice AS amount, l_discount * 100 AS tor, CASE WHEN l_tax = 0.03 THEN p ELSE NULL END AS pre_close,
  CASE WHEN l_discount = 0.05 THEN 1.23456789 END AS pct_chg FROM ticks"""


def raw(spark, sf):
    t = fx._ticks(fx.load(spark, sf, "lineitem"))
    text = F.when(F.col("l_linenumber") < 7, val.day_text("d")).otherwise(F.lit("2001-1-1"))
    return t.select(
        fx.code_of("l_suppkey").alias("code"), text.alias("d"), F.expr(fx._KEY).alias("seq"),
        F.col("p").cast("string").alias("o"), F.greatest("p", "net").cast("string").alias("h"),
        F.least("p", "net").cast("string").alias("l"), F.col("net").cast("string").alias("c"),
        F.when(F.col("l_quantity") != 13, F.col("l_quantity").cast("string")).otherwise(F.lit("n/a")).alias("v"),
        F.col("l_extendedprice").cast("string").alias("amount"),
        (F.col("l_discount") * 100).cast("string").alias("turnover_rate"),
        F.when(F.col("l_tax") == 0.03, F.col("p").cast("string")).alias("pre_close"),
        F.when(F.col("l_discount") == 0.05, F.lit("1.23456789")).alias("pct_chg"),
    )


def _r(x, n):
    return f"round_even({x} * 1e{n}, 0) / 1e{n}"


CLEAN_COLS = ["o", "h", "l", "c", "v", "amount", "tor", "pre_close", "change", "pct_chg"]
_last = ", ".join(f"x.{n}" for n in ("o", "h", "l", "c", "v", "amount", "tor", "pre_close", "pct_chg"))
CTES["deduped"] = f"""
SELECT code, d, {_last} FROM (SELECT code, d, arg_max({{'o': o, 'h': h, 'l': l, 'c': c, 'v': v,
  'amount': {_r('amount', 2)}, 'tor': {_r('tor', 2)}, 'pre_close': pre_close, 'pct_chg': {_r('pct_chg', 4)}}}, seq) AS x
FROM raw WHERE d IS NOT NULL GROUP BY code, d)"""


def filled(source, part, order):
    prev = f"lag(c) OVER (PARTITION BY {part} ORDER BY {order})"
    return (
        f"SELECT * REPLACE (coalesce(pct_chg, change / nullif(pre_close, 0) * 100) AS pct_chg) FROM ("
        f"SELECT *, c - pre_close AS change FROM (SELECT * REPLACE (coalesce(pre_close, {prev}) AS pre_close) FROM {source}))"
    )


CTES["cleaned"] = filled("deduped", "code", "d")
CTES["raw_index"] = f"SELECT * REPLACE ({_r('amount', 2)} AS amount, {_r('tor', 2)} AS tor, {_r('pct_chg', 2)} AS pct_chg) FROM raw"
CTES["filled_index"] = filled("raw_index", "code", "seq")


@query("p1_clean_bars", with_("cleaned") + f"SELECT code, {sql_shown(['d'], CLEAN_COLS, digits=4)} FROM cleaned")
def p1(spark, sf):
    return shown(clean.clean_bars(raw(spark, sf)), ["d"], CLEAN_COLS, ["code"], 4)


_cols = ", ".join(f"x.{n}" for n in CLEAN_COLS)
_packed = ", ".join(f"'{n}': {n}" for n in CLEAN_COLS)


@query("p1_clean_index", with_("filled_index") + f"""
SELECT code, {sql_shown(['d'], CLEAN_COLS, digits=4)} FROM (SELECT code, d, {_cols} FROM (
SELECT code, d, arg_max({{{_packed}}}, seq) AS x FROM filled_index WHERE d IS NOT NULL GROUP BY code, d))""")
def p1_index(spark, sf):
    return shown(clean.clean_index_bars(raw(spark, sf)), ["d"], CLEAN_COLS, ["code"], 4)


CTES["partly"] = f"SELECT *, CASE WHEN v > 25 THEN 0.5 * c WHEN v < 5 THEN 0 END AS pre_close, CASE WHEN v < 10 THEN 1.5 END AS change, NULL::DOUBLE AS pct_chg FROM bars"


@query("p2_fill_changes", with_("partly") + f"""
SELECT code, {sql_shown(['d'], ['pre_close', 'change'], digits=4)}, {R('change / nullif(pre_close, 0) * 100', 4)} AS pct_chg FROM (
SELECT code, d, c, pre_close, coalesce(change, c - pre_close) AS change FROM (
SELECT code, d, c, change, coalesce(pre_close, {lag('c')}) AS pre_close FROM partly))""")
def p2(spark, sf):
    v = F.col("v")
    df = fx.bars(spark, sf).withColumns({
        "pre_close": F.when(v > 25, 0.5 * F.col("c")).when(v < 5, F.lit(0.0)),
        "change": F.when(v < 10, F.lit(1.5))})
    return shown(clean.fill_changes(df), ["d"], ["pre_close", "change", "pct_chg"], ["code"], 4)


@query("p3_normalize_date", f"""
SELECT o_orderkey, {T('CAST(o_orderdate AS DATE)')} AS d FROM orders WHERE o_orderkey % 4 < 2""")
def p3(spark, sf):
    k = F.col("o_orderkey") % 4
    day = F.to_date("o_orderdate")
    text = (F.when(k == 0, val.day_text(day)).when(k == 1, F.concat(F.lit(" "), val.day_text(day)))
            .when(k == 2, day.cast("string")).otherwise(F.concat(val.day_text(day), F.lit("x"))))
    df = fx.load(spark, sf, "orders").select("o_orderkey", text.alias("d"))
    return shown(clean.normalize_date(df), ["d"], [], ["o_orderkey"])


_six = "lpad(CAST((p_partkey * 7919) % 1000000 AS VARCHAR), 6, '0')"
CTES["spelled"] = f"""
SELECT p_partkey, p_name, {_six} AS six, CASE p_partkey % 6 WHEN 0 THEN 'sz' || {_six} WHEN 1 THEN {_six} || '-SH'
  WHEN 2 THEN ' ' || {_six} || ' ' WHEN 3 THEN {_six} || '_bj' WHEN 4 THEN 'x' || {_six} ELSE 'BJ.' || {_six} END AS code FROM part"""
_board = "CASE WHEN six LIKE '8%' OR six LIKE '920%' THEN 'BJ' WHEN left(six, 1) IN ('5', '6', '9') THEN 'SH' ELSE 'SZ' END"
CTES["normal"] = f"""
SELECT *, CASE p_partkey % 6 WHEN 0 THEN six || '.SZ' WHEN 1 THEN six || '.SH' WHEN 2 THEN six || '.' || {_board}
  WHEN 3 THEN six || '.BJ' WHEN 4 THEN 'X' || six ELSE six || '.BJ' END AS n FROM spelled"""


def spelled(spark, sf):
    six = F.lpad(((F.col("p_partkey") * 7919) % 1000000).cast("string"), 6, "0")
    k = F.col("p_partkey") % 6
    code = (F.when(k == 0, F.concat(F.lit("sz"), six)).when(k == 1, F.concat(six, F.lit("-SH")))
            .when(k == 2, F.concat(F.lit(" "), six, F.lit(" "))).when(k == 3, F.concat(six, F.lit("_bj")))
            .when(k == 4, F.concat(F.lit("x"), six)).otherwise(F.concat(F.lit("BJ."), six)))
    return fx.load(spark, sf, "part").select("p_partkey", "p_name", code.alias("code"), six.alias("six"))


@query("p4_normalize_code", with_("normal") + f"""
SELECT p_partkey, n, CASE WHEN ltrim(six, '0') = '' THEN '' ELSE six || '.' || {_board} END AS padded FROM normal""")
def p4(spark, sf):
    bare = F.ltrim(F.col("six"), F.lit("0"))
    return spelled(spark, sf).select(
        "p_partkey", val.normalize_code("code").alias("n"), val.pad_code(bare).alias("padded"))


@query("p5_market_label", with_("normal") + """
SELECT p_partkey, CASE WHEN n LIKE '2%' THEN 'B股' WHEN n LIKE '60%' THEN '沪A' WHEN n LIKE '00%' THEN '深A'
  WHEN n LIKE '3%' THEN '创业板' WHEN n LIKE '68%' THEN '科创板' WHEN left(n, 1) IN ('4', '8', '9') THEN '北交所'
  ELSE '其他' END AS label FROM normal""")
def p5(spark, sf):
    return spelled(spark, sf).select("p_partkey", val.market_label(val.normalize_code("code")).alias("label"))


@query("p6_limit_up_pct", with_("normal") + """
SELECT p_partkey, CASE WHEN max(regexp_matches(p_name, '(?i)\\*?st')::INT) OVER (PARTITION BY left(six, 3)) = 1 AND p_partkey % 2 = 0 THEN 0.05::DOUBLE
  WHEN n LIKE '%.BJ' THEN 0.295::DOUBLE WHEN left(n, 3) IN ('300', '301', '688', '689') THEN 0.195::DOUBLE ELSE 0.095::DOUBLE END AS pct FROM normal""")
def p6(spark, sf):
    df = spelled(spark, sf).withColumns({"n": val.normalize_code("code"), "grp": F.substring("six", 1, 3)})
    df = val.mark_st(df, "p_name", "grp")
    st = F.col("any_st") & (F.col("p_partkey") % 2 == 0)
    return df.select("p_partkey", val.limit_up_pct("n", st).alias("pct"))


@query("p8_aliases", with_("bars") + f"SELECT code, {T('d')} AS d, {R('(h + l) / 2 + v')} AS x FROM bars")
def p8(spark, sf):
    return fx.bars(spark, sf).select("CODE", val.day_text("D").alias("d"), out_num(F.expr("(H + L) / 2 + V")).alias("x")).withColumnRenamed("CODE", "code")


@query("p9_tail_window", with_("bars") + f"""
SELECT {BARS_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS k FROM bars WHERE d <= DATE '1998-06-15') WHERE k <= 20""")
def p9(spark, sf):
    return bars_out(clean.tail_window(fx.bars(spark, sf), "1998-06-15", 20))


@query("p10_universe_by_date", with_("bars") + f"""
SELECT 'dated' AS universe, code, {T('d')} AS d FROM bars WHERE month(d) % 2 = 0 AND CAST(substr(code, 2) AS BIGINT) % 2 = 0
UNION ALL SELECT 'attention', code, {T('d')} FROM bars WHERE (d >= DATE '1998-01-01' AND d < DATE '2000-01-01' AND CAST(substr(code, 2) AS BIGINT) % 3 = 0)
  OR (d >= DATE '2000-01-01' AND CAST(substr(code, 2) AS BIGINT) % 5 = 0)""")
def p10_dates(spark, sf):
    """Lists with dates hold on those dates; category lists hold until the next one ends."""
    b, n = fx.bars(spark, sf), F.substring("code", 2, 20).cast("long")
    dated = b.where(F.month("d") % 2 == 0).select("code", "d", F.when(n % 2 == 0, F.lit("white")).otherwise("black").alias("list"))
    codes = b.select("code").distinct()
    ends = [codes.where(n % k == 0).withColumn("end_d", F.lit(d).cast("date")) for k, d in ((3, "1998-01-01"), (5, "2000-01-01"))]
    parts = [("dated", clean.apply_universe(b, "white", dated)), ("attention", clean.apply_universe(b, "attention", ends[0].unionByName(ends[1])))]
    out = [x.select(F.lit(name).alias("universe"), "code", day_text("d").alias("d")) for name, x in parts]
    return out[0].unionByName(out[1])


@query("p10_universe", with_("bars", "lists") + """
SELECT 'white' AS universe, count(*) AS n FROM bars WHERE code IN (SELECT code FROM lists WHERE list = 'white')
UNION ALL SELECT 'black', count(*) FROM bars WHERE code IN (SELECT code FROM lists WHERE list = 'black')
UNION ALL SELECT 'all', count(*) FROM bars UNION ALL SELECT 'given', count(*) FROM bars WHERE code IN ('S000000001', 'S000000002')""")
def p10(spark, sf):
    b, lists = fx.bars(spark, sf), fx.lists(spark, sf)
    out = None
    for name, u in (("white", "white"), ("black", "black"), ("all", "all"), ("given", ["S000000001", "S000000002"])):
        n = clean.apply_universe(b, u, lists).agg(F.count(F.lit(1)).alias("n")).withColumn("universe", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


@query("p11_codes_on", with_("bars") + "SELECT DISTINCT code FROM bars WHERE d = DATE '1998-06-15'")
def p11(spark, sf):
    return clean.codes_on(fx.bars(spark, sf), "1998-06-15")


@query("p12_to_storage", with_("bars") + f"SELECT {BARS_SQL}, 'qfq' AS adj_type FROM bars")
def p12(spark, sf):
    return bars_out(clean.to_storage(fx.bars(spark, sf).withColumn("seq", F.lit(0)), "qfq"), "adj_type")


@query("p13_round_display", with_("bars") + f"SELECT code, {T('d')} AS d, {R('c / 3', 2)} AS c, {R('amount / 7', 2)} AS amount FROM bars")
def p13(spark, sf):
    df = fx.bars(spark, sf).select("code", "d", (F.col("c") / 3).alias("c"), (F.col("amount") / 7).alias("amount"))
    return shown(val.round_display(df), ["d"], [], ["code", "c", "amount"])


@query("p14_nan_to_null", with_("bars") + f"SELECT code, {T('d')} AS d, CASE WHEN v > 10 AND v <= 40 THEN v END AS x FROM bars")
def p14(spark, sf):
    v = F.col("v")
    x = F.when(v <= 10, F.lit(float("nan"))).when(v > 40, F.lit(float("inf"))).otherwise(v)
    return shown(val.sanitize(fx.bars(spark, sf).select("code", "d", x.alias("x"))), ["d"], [], ["code", "x"])


RANK_COLS = f"code, {T('d')} AS d, score, rank"


def _details(df, part):
    return df.select("code", val.day_text("d").alias("d"), "score", "rank", F.lit(part).alias("part"))


@query("p15_details_filters", with_("plain_ranks") + f"""
SELECT {RANK_COLS}, 'stock' AS part FROM (SELECT * FROM plain_ranks WHERE code = 'S000000007' ORDER BY d DESC LIMIT 30)
UNION ALL SELECT {RANK_COLS}, 'date' FROM plain_ranks WHERE d = DATE '1998-06-15'
UNION ALL SELECT {RANK_COLS}, 'range' FROM plain_ranks WHERE d = DATE '1998-06-15' AND score BETWEEN 10 AND 30
UNION ALL SELECT {RANK_COLS}, 'top' FROM plain_ranks WHERE d = DATE '1998-06-15' AND rank <= 5""")
def p15(spark, sf):
    r, day = plain_ranks(spark, sf), "1998-06-15"
    return (_details(status.details_by_stock(r, "S000000007", 30), "stock")
            .unionByName(_details(status.details_by_date(r, day), "date"))
            .unionByName(_details(status.details_score_range(r, day, 10, 30), "range"))
            .unionByName(_details(status.details_top(r, day, 5), "top")))


CTES["logic"] = "SELECT *, CASE WHEN v <= 40 THEN c END AS x FROM bars"


@query("p16_logic", with_("logic") + f"""
SELECT code, {T('d')} AS d, coalesce(x > o, false) AND coalesce(v > 10, false) AS both, coalesce(x > o, false) OR v > 30 AS either,
  NOT coalesce(x > o, false) AS negated, coalesce(x <> o, true) AS unequal FROM logic""")
def p16(spark, sf):
    df = fx.bars(spark, sf).withColumn("x", F.when(F.col("v") <= 40, F.col("c")))
    up = F.col("x") > F.col("o")
    return df.select("code", val.day_text("d").alias("d"), val.all_of(up, val.gt("v", 10)).alias("both"),
                     val.any_of(up, val.gt("v", 30)).alias("either"), val.not_(up).alias("negated"), val.ne("x", "o").alias("unequal"))


@query("f1_f5_scalars", with_("logic") + f"""
SELECT code, {T('d')} AS d, {R('abs(x - o)')} AS abs_, {R('CASE WHEN x IS NOT NULL THEN greatest(x, o) END')} AS max_,
  {R('CASE WHEN x IS NOT NULL THEN least(x, o) END')} AS min_, {R('CASE WHEN x > o THEN x ELSE -o END')} AS if_,
  {R('x / (v - v + 1e-12) * 1e-12', 4)} AS div_, {R('atan(x / o)')} AS atan_ FROM logic""")
def f1(spark, sf):
    df = fx.bars(spark, sf).withColumn("x", F.when(F.col("v") <= 40, F.col("c")))
    x, o, v = F.col("x"), F.col("o"), F.col("v")
    df = df.withColumns({
        "abs_": F.abs(x - o), "max_": val.max2("x", "o"), "min_": val.min2("x", "o"), "if_": val.if_(x > o, x, -o),
        "atan_": F.atan(x / o)})
    out = df.withColumn("div_", val.safe_div(x, v - v) * 1e-12)
    return out.select("code", val.day_text("d").alias("d"), *[out_num(n).alias(n) for n in ("abs_", "max_", "min_", "if_", "atan_")],
                      out_num("div_", 4).alias("div_"))


@query("f6_slope_angle", with_("bars") + f"""
SELECT code, {T('d')} AS d, {R('degrees(atan((m / lag(m, 5) OVER (' + WIN + ') - 1) / 0.5))', 4)} AS angle FROM (SELECT *, {strict('avg', 'c', 10)} AS m FROM bars)""")
def f6(spark, sf):
    from barscope.functions import series as ts

    df = fx.bars(spark, sf).withColumn("m", ts.ma("c", 10))
    return shown(df.withColumn("angle", val.slope_angle(F.col("m") / ts.ref("m", 5) - 1)), ["d"], ["angle"], ["code"], 4)


@query("f7_round_outputs", with_("bars") + f"SELECT code, {T('d')} AS d, {R('c / 3', 4)} AS a, {R('c / 7', 2)} AS b FROM bars")
def f7(spark, sf):
    df = fx.bars(spark, sf).select("code", "d", (F.col("c") / 3).alias("a"), (F.col("c") / 7).alias("b"))
    return shown(val.round_columns(df, {"a": 4, "b": 2, "absent": 1}), ["d"], [], ["code", "a", "b"])


CTES["members"] = """
SELECT p_brand AS code, p_type AS concept_name, 'C' || CAST(p_size AS VARCHAR) AS concept_code, p_name AS name, p_partkey AS seq FROM part"""


def members(spark, sf):
    return fx.load(spark, sf, "part").select(
        F.col("p_brand").alias("code"), F.col("p_type").alias("concept_name"),
        F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("concept_code"), F.col("p_name").alias("name"),
        F.col("p_partkey").alias("seq"))


@query("f8_filter_concepts", """
SELECT p_partkey, nullif(array_to_string(list_filter([trim(p_type), 'x', p_brand], lambda e: lower(e) NOT IN ('economy', 'brand#7', 'x')), ','), '') AS kept FROM part""")
def f8(spark, sf):
    text = F.concat_ws(",", F.concat(F.lit(" "), F.col("p_type")), F.lit("x"), F.lit(" "), F.col("p_brand"))
    kept = val.filter_concepts(text, ["Economy", "brand#7", "X "])
    return fx.load(spark, sf, "part").select("p_partkey", kept.alias("kept"))


@query("f11_period_label", with_("bars") + f"""
SELECT code, {T('d')} AS d, CASE WHEN a = d THEN {T('d')} ELSE {T('a')} || '-' || {T('d')} END AS label FROM (
SELECT code, d, min(d) {over(5)} AS a FROM bars)""")
def f11(spark, sf):
    return fx.bars(spark, sf).select("code", val.day_text("d").alias("d"), scopes.period_label(5).alias("label"))


@query("f12_next_day", with_("cal") + f"SELECT {T('d')} AS d, {T('d + 1')} AS n FROM cal")
def f12(spark, sf):
    days = fx.calendar(fx.bars(spark, sf)).withColumn("n", val.next_day("d"))
    return shown(days, ["d", "n"])


# Joins.

@query("j1_restrict_codes", with_("bars", "lists") + f"SELECT {BARS_SQL} FROM bars WHERE code IN (SELECT code FROM lists WHERE list = 'black')")
def j1(spark, sf):
    return bars_out(clean.restrict_codes(fx.bars(spark, sf), fx.lists(spark, sf).where(F.col("list") == "black")))


CTES["half_bench"] = "SELECT d, c AS idx_c, c / nullif(lag(c) OVER (ORDER BY d), 0) - 1 AS idx_ret FROM bench WHERE day(d) % 3 <> 0"


def half_bench(spark, sf):
    return fx.bench_bars(spark, sf).where(F.dayofmonth("d") % 3 != 0)


@query("j2_join_benchmark", with_("bars", "half_bench") + f"""
SELECT b.code, {T('b.d')} AS d, {R('i.idx_c')} AS idx_c, {R('i.idx_ret')} AS idx_ret FROM bars b LEFT JOIN half_bench i ON i.d = b.d""")
def j2(spark, sf):
    return shown(benchmark.join_benchmark(fx.bars(spark, sf), half_bench(spark, sf)), ["d"], ["idx_c", "idx_ret"], ["code"])


@query("j3_align", with_("bars", "half_bench") + f"""
SELECT code, {T('d')} AS d, 'ffill' AS how, {R(f'last_value(idx_c IGNORE NULLS) {over()}')} AS idx_c FROM (
  SELECT b.code, b.d, i.idx_c FROM bars b LEFT JOIN half_bench i ON i.d = b.d)
UNION ALL SELECT b.code, {T('b.d')}, 'drop', {R('i.idx_c')} FROM bars b JOIN half_bench i ON i.d = b.d""")
def j3(spark, sf):
    j = benchmark.join_benchmark(fx.bars(spark, sf), half_bench(spark, sf))
    both = [benchmark.align(j, how).withColumn("how", F.lit(how)) for how in ("ffill", "drop")]
    return shown(both[0].unionByName(both[1]), ["d"], ["idx_c"], ["code", "how"])


@query("j5_prefer_new", with_("bars") + f"""
SELECT coalesce(n.code, o.code) AS code, {T('coalesce(n.d, o.d)')} AS d, {R('coalesce(n.v, o.v)')} AS v, {R('coalesce(o.c, NULL)')} AS c
FROM (SELECT * FROM bars WHERE d < DATE '2000-01-01') o FULL JOIN (SELECT code, d, CASE WHEN v > 25 THEN v * 2 END AS v FROM bars WHERE d >= DATE '1999-01-01') n
ON n.code = o.code AND n.d = o.d""")
def j5(spark, sf):
    b = fx.bars(spark, sf).select("code", "d", "v", "c")
    new = b.where(F.col("d") >= F.lit("1999-01-01").cast("date")).select("code", "d", F.when(F.col("v") > 25, F.col("v") * 2).alias("v"))
    out = clean.merge_prefer_new(b.where(F.col("d") < F.lit("2000-01-01").cast("date")), new, ["code", "d"])
    return shown(out, ["d"], ["v", "c"], ["code"])


@query("j6_prev_day_pairs", with_("bars", "cal") + f"""
SELECT b.code, {T('b.d')} AS d, {R('b.c')} AS c, {R('p.c')} AS prev_c FROM (SELECT bars.*, idx FROM bars JOIN cal USING (d)) b
JOIN (SELECT bars.*, idx FROM bars JOIN cal USING (d)) p ON p.code = b.code AND p.idx = b.idx - 1""")
def j6(spark, sf):
    b = fx.bars(spark, sf)
    return shown(clean.prev_day_pairs(b, fx.calendar(b)), ["d"], ["c", "prev_c"], ["code"])


@query("j10_semi_join", with_("bars", "plain_ranks") + f"""
SELECT {BARS_SQL} FROM bars WHERE code IN (SELECT code FROM plain_ranks WHERE rank = 1)""")
def j10(spark, sf):
    best = plain_ranks(spark, sf).where(F.col("rank") == 1).select("code").distinct()
    return bars_out(clean.apply_universe(fx.bars(spark, sf), best))
