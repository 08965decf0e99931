"""Validation, completeness, status, concepts and upserts (Q and A groups, J8, J9, J12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barscope.functions.values import day_text
from barscope.operators import clean, concepts, quality, status
from barscope.plans import fixtures as fx
from barscope.plans.q_calendar import gaps
from barscope.plans.q_sources import plain_ranks, store
from barscope.plans.q_values import members
from barscope.plans.registry import CTES, R, T, WIN, lag, out_num, query, shown, with_
from barscope.sources import tables

IMPORT_RULES = quality.TableRules(
    ("code", "d", "o", "h", "l", "c", "v", "open_interest"),
    {"code": ("string",), "c": quality.NUMBER, "d": ("string",)},
    {"code": r"^S\d{8}[1-9]$", "v": ">= 10", "c": "> 0", "o": "< 5000"},
)


@query("q1_validate", with_("bars") + """
SELECT * FROM (SELECT 'missing_column' AS "check", 'open_interest' AS "column", 1::BIGINT AS rows UNION ALL SELECT 'wrong_type', 'd', 1
UNION ALL SELECT 'constraint', 'code', count(*) FROM bars WHERE NOT regexp_full_match(code, 'S\\d{8}[1-9]')
UNION ALL SELECT 'constraint', 'v', count(*) FROM bars WHERE NOT v >= 10
UNION ALL SELECT 'constraint', 'c', count(*) FROM bars WHERE NOT c > 0 UNION ALL SELECT 'constraint', 'o', count(*) FROM bars WHERE NOT o < 5000) WHERE rows > 0""")
def q1(spark, sf):
    return quality.validate(fx.bars(spark, sf), IMPORT_RULES)


# Given previous closes: right on most bars, off by one where the volume is small.
CTES["given"] = f"SELECT *, CASE WHEN v < 5 THEN pc + 1 WHEN v < 45 THEN pc END AS pre_close FROM (SELECT *, {lag('c')} AS pc FROM bars)"


def given(spark, sf):
    df = clean.fill_changes(fx.bars(spark, sf)).withColumnRenamed("pre_close", "pc").drop("change", "pct_chg")
    v = F.col("v")
    return df.withColumn("pre_close", F.when(v < 5, F.col("pc") + 1).when(v < 45, F.col("pc")))


@query("q2_preclose_mismatch", with_("given", "cal") + f"""
SELECT g.code, {T('g.d')} AS d, {R('g.pre_close')} AS pre_close, {R('p.c')} AS prev_c FROM (SELECT given.*, idx FROM given JOIN cal USING (d)) g
JOIN (SELECT bars.*, idx FROM bars JOIN cal USING (d)) p ON p.code = g.code AND p.idx = g.idx - 1 WHERE abs(g.pre_close - p.c) > 1e-6""")
def q2(spark, sf):
    b = given(spark, sf)
    return shown(quality.preclose_mismatch(b, fx.calendar(b)), ["d"], ["pre_close", "prev_c"], ["code"])


CTES["edge"] = """
SELECT n.code, n.d, n.pre_close, o.c FROM (SELECT code, min(d) AS d, arg_min({'p': pre_close}, d).p AS pre_close FROM given WHERE d >= DATE '2001-01-01' GROUP BY code) n
JOIN (SELECT code, arg_max(c, d) AS c FROM bars WHERE d < DATE '2001-01-01' GROUP BY code) o USING (code)"""


def boundary(spark, sf):
    b, cut = given(spark, sf), F.lit("2001-01-01").cast("date")
    new = b.where(F.col("d") >= cut)
    return new, quality.preclose_boundary(b.where(F.col("d") < cut), new)


@query("q3_preclose_boundary", with_("edge") + f"""
SELECT code, {T('d')} AS d, {R('pre_close')} AS pre_close, {R('c')} AS prev_c FROM edge WHERE abs(pre_close - c) > 1e-6""")
def q3(spark, sf):
    return shown(boundary(spark, sf)[1], ["d"], ["pre_close", "prev_c"], ["code"])


@query("q3_excluded", with_("edge") + f"""
SELECT code, count(*) AS n FROM given WHERE d >= DATE '2001-01-01' AND code NOT IN (SELECT code FROM edge WHERE abs(pre_close - c) > 1e-6) GROUP BY code""".replace("FROM given", "FROM given"))
def q3_excluded(spark, sf):
    new, bad = boundary(spark, sf)
    return quality.without_mismatches(new, bad).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("q4_completeness", with_("symbols", "bars") + """
SELECT count(*) AS expected, count(b.code) AS present, count(*) - count(b.code) AS missing FROM symbols s
LEFT JOIN (SELECT DISTINCT code FROM bars WHERE d = DATE '1999-03-10') b ON b.code = s.code""")
def q4(spark, sf):
    return quality.completeness(fx.symbols(spark, sf), fx.bars(spark, sf), "1999-03-10")


@query("j8_missing_codes", with_("symbols", "bars") + """
SELECT code FROM symbols EXCEPT SELECT code FROM bars WHERE d = DATE '1999-03-10'""")
def j8(spark, sf):
    return clean.missing_codes(fx.symbols(spark, sf), fx.bars(spark, sf), "1999-03-10")


def health(name: str, source: str, make):
    @query(name, with_(source, "symbols") + f"""
SELECT {T('first')} AS first, {T('last')} AS last, days, gap_cnt, latest_rows, expected_rows, CASE WHEN gap_cnt > 0 THEN 'WARN'
  WHEN latest_rows > 0 AND latest_rows < greatest(100, expected_rows * 0.6) THEN 'CRIT' ELSE 'OK' END AS status FROM (
SELECT min(d) AS first, max(d) AS last, count(*) AS days, count(*) FILTER (WHERE nd - d > 21) AS gap_cnt, arg_max(n, d) AS latest_rows,
  (SELECT count(DISTINCT code) FROM symbols) AS expected_rows
FROM (SELECT d, n, lead(d) OVER (ORDER BY d) AS nd FROM (SELECT d, count(*) AS n FROM {source} GROUP BY d)))""")
    def run(spark, sf):
        out = quality.health(make(spark, sf), fx.symbols(spark, sf))
        return shown(out, ["first", "last"], [], ["days", "gap_cnt", "latest_rows", "expected_rows", "status"])


health("q5_health", "bars", fx.bars)
health("q5_health_gaps", "gaps", gaps)

# Month bars of four kinds: whole, with an indicator that stops early, with few codes in the newest month, and without a year.
CTES["kinds"] = """
SELECT k.adj, m.* REPLACE (CASE WHEN k.adj <> 'late' OR m.d <= DATE '2000-06-01' THEN m.v END AS v) FROM (
  SELECT code, date_trunc('month', d)::DATE AS d, sum(v) AS v, max(h) AS h FROM bars WHERE d < DATE '2001-01-01' GROUP BY ALL) m
CROSS JOIN (VALUES ('whole'), ('late'), ('few'), ('gap')) k(adj)
WHERE (k.adj <> 'few' OR m.d < DATE '2000-12-01' OR m.code LIKE '%1') AND (k.adj <> 'gap' OR year(m.d) <> 1999)"""


@query("q5_health_by_kind", with_("kinds", "symbols") + f"""
SELECT adj, {T('first')} AS first, {T('last')} AS last, days, gap_cnt, latest_rows, ind_lag, CASE WHEN gap_cnt > 0 THEN 'WARN'
  WHEN latest_rows < greatest(5, 0.6 * (SELECT count(DISTINCT code) FROM symbols)) THEN 'CRIT' WHEN ind_lag < 0 THEN 'WARN' ELSE 'OK' END AS status FROM (
SELECT adj, min(d) AS first, max(d) AS last, count(*) AS days, count(*) FILTER (WHERE nd - d > 40) AS gap_cnt, arg_max(n, d) AS latest_rows,
  least(max(d) FILTER (WHERE nv > 0), max(d) FILTER (WHERE nh > 0)) - max(d) AS ind_lag
FROM (SELECT *, lead(d) OVER (PARTITION BY adj ORDER BY d) AS nd FROM (
  SELECT adj, d, count(*) AS n, count(v) AS nv, count(h) AS nh FROM kinds GROUP BY adj, d)) GROUP BY adj)""")
def q5_kinds(spark, sf):
    month = fx.bars(spark, sf).where("d < DATE '2001-01-01'").groupBy("code", F.trunc("d", "month").alias("d")).agg(F.sum("v").alias("v"), F.max("h").alias("h"))
    kinds = month.withColumn("adj", F.explode(F.array(*map(F.lit, ("whole", "late", "few", "gap")))))
    kinds = kinds.where("(adj <> 'few' OR d < DATE '2000-12-01' OR code LIKE '%1') AND (adj <> 'gap' OR year(d) <> 1999)")
    kinds = kinds.withColumn("v", F.when(F.expr("adj <> 'late' OR d <= DATE '2000-06-01'"), F.col("v")))
    out = quality.health(kinds, fx.symbols(spark, sf), 40, ("v", "h"), 5, "adj")
    return shown(out, ["first", "last"], [], ["adj", "days", "gap_cnt", "latest_rows", "ind_lag", "status"])


@query("q6_next_range", with_("bars", "symbols") + f"""
SELECT asked, {T('latest')} AS latest, missing, {T("CASE WHEN latest + 1 <= e THEN latest + 1 WHEN missing > 0 THEN latest END")} AS start,
  CASE WHEN latest + 1 <= e THEN 'append' WHEN missing > 0 THEN 'refill' ELSE 'skip' END AS action
FROM (SELECT max(d) AS latest FROM bars) CROSS JOIN (SELECT count(*) AS missing FROM symbols WHERE code NOT IN (
  SELECT code FROM bars WHERE d = (SELECT max(d) FROM bars))) CROSS JOIN (VALUES ('later', DATE '2002-01-01'), ('same', DATE '2001-11-01')) x(asked, e)""")
def q6(spark, sf):
    b, s = fx.bars(spark, sf), fx.symbols(spark, sf)
    parts = [quality.next_range(b, s, e).withColumn("asked", F.lit(n)) for n, e in (("later", "2002-01-01"), ("same", "2001-11-01"))]
    return shown(parts[0].unionByName(parts[1]), ["latest", "start"], [], ["asked", "missing", "action"])


# Concepts: brands as codes, part types as concepts.

@query("a6_concept_rollup", with_("members") + """
SELECT code, array_to_string(list_sort(list(DISTINCT concept_code)), ',') AS concepts_code,
  array_to_string(list_sort(list(DISTINCT concept_name)), ',') AS concepts_name, arg_min(name, seq) AS stock_name FROM members GROUP BY code""")
def a6(spark, sf):
    return concepts.concept_rollup(members(spark, sf))


CTES["sources3"] = """
SELECT DISTINCT p_brand AS code, CASE WHEN p_brand LIKE '%1' THEN 'manual,keep' END AS manual,
  CASE WHEN p_brand LIKE '%1%' THEN ' Economy, ' ELSE 'big, ' || p_brand END AS a, 'late,economy' AS b FROM part WHERE p_brand <> 'Brand#25'"""


def three(spark, sf):
    brand = F.col("p_brand")
    df = fx.load(spark, sf, "part").select(brand.alias("code")).distinct().where(F.col("code") != "Brand#25")
    code = F.col("code")
    manual = df.select("code", F.when(code.like("%1"), F.lit("manual,keep")).alias("concepts"))
    a = df.select("code", F.when(code.like("%1%"), F.lit(" Economy, ")).otherwise(F.concat(F.lit("big, "), code)).alias("concepts"))
    return manual, a, df.select("code", F.lit("late,economy").alias("concepts"))


@query("q7_concept_map", with_("sources3") + """
SELECT code, CASE WHEN code NOT LIKE '%1%' THEN 'big,' || code WHEN manual IS NOT NULL THEN manual ELSE 'late' END AS concepts FROM sources3""")
def q7(spark, sf):
    return concepts.concept_map(*three(spark, sf), blacklist=["ECONOMY"])


@query("q7_last_row", """
SELECT p_brand AS code, CASE WHEN p_brand LIKE '%1' THEN 'n' || max(p_partkey) FILTER (p_size > 5) WHEN p_brand LIKE '%2' THEN 'z' || min(p_partkey)
  ELSE 'a' || max(p_partkey) END AS concepts FROM part GROUP BY p_brand""")
def q7_rows(spark, sf):
    """Several rows of a code: the last one of the first sources wins, the first one of the source that fills in."""
    p = fx.load(spark, sf, "part")
    brand, key = F.col("p_brand").alias("code"), F.col("p_partkey").alias("seq")
    rows = lambda cond, head: p.where(cond).select(brand, F.concat(F.lit(head), F.col("p_partkey").cast("string")).alias("concepts"), key)
    one, two = F.col("p_brand").like("%1"), F.col("p_brand").like("%2")
    return concepts.concept_map(rows(one & (F.col("p_size") <= 5), "m"), rows(one & (F.col("p_size") > 5) | ~(one | two), "n")
                                .withColumn("concepts", F.when(F.col("code").like("%1"), F.col("concepts")).otherwise(F.regexp_replace("concepts", "^n", "a"))),
                                rows(F.lit(True), "z"))


@query("q8_dedupe_concepts", """
SELECT code, coalesce(arg_min(CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN p_type ELSE '' END, {'e': p_type NOT IN ('SMALL', 'ECONOMY'), 's': p_partkey}), '') AS concepts_name,
  arg_min(p_partkey, {'e': p_type NOT IN ('SMALL', 'ECONOMY'), 's': p_partkey}) AS seq FROM (SELECT p_name AS code, * FROM part) GROUP BY code""")
def q8(spark, sf):
    kept = F.col("p_type").isin("SMALL", "ECONOMY")
    df = fx.load(spark, sf, "part").select(
        F.col("p_name").alias("code"), F.when(kept, F.col("p_type")).alias("concepts_name"), F.col("p_partkey").alias("seq"))
    return concepts.dedupe_concepts(df)


@query("j12_add_concepts", with_("sources3", "brand_bars") + f"""
SELECT b.code, {T('b.d')} AS d, coalesce(s.a, '') AS concepts FROM brand_bars b LEFT JOIN sources3 s ON s.code = b.code""")
def j12(spark, sf):
    return shown(concepts.add_concepts(fx.brand_bars(spark, sf), three(spark, sf)[1]), ["d"], [], ["code", "concepts"])


# Status.
CTES["by_adj"] = """
SELECT adj_type, min(d) AS min_d, max(d) AS max_d, count(*) AS rows, count(DISTINCT code) AS codes FROM store GROUP BY adj_type
UNION ALL SELECT 'total', min(d), max(d), count(*), count(DISTINCT code) FROM store"""


@query("a1_bars_status", with_("by_adj") + f"SELECT adj_type, {T('min_d')} AS min_d, {T('max_d')} AS max_d, rows, codes FROM by_adj")
def a1(spark, sf):
    return shown(status.bars_status(spark.read.parquet(store(spark, sf))), ["min_d", "max_d"], [], ["adj_type", "rows", "codes"])


@query("a2_details_status", with_("plain_ranks") + f"""
SELECT count(*) AS rows, count(DISTINCT code) AS codes, count(DISTINCT d) AS dates, {T('min(d)')} AS first, {T('max(d)')} AS last FROM plain_ranks""")
def a2(spark, sf):
    return shown(status.details_status(plain_ranks(spark, sf)), ["first", "last"], [], ["rows", "codes", "dates"])


@query("a3_stock_summary", with_("plain_ranks") + f"""
SELECT code, count(*) AS total_days, {T('min(d)')} AS first_date, {T('max(d)')} AS last_date, {R('avg(score)')} AS avg_score, min(score) AS min_score,
  max(score) AS max_score, {R('avg(rank)')} AS avg_rank, min(rank) AS best_rank, max(rank) AS worst_rank FROM plain_ranks GROUP BY code""")
def a3(spark, sf):
    out = status.stock_summary(plain_ranks(spark, sf))
    return shown(out, ["first_date", "last_date"], ["avg_score", "avg_rank"], ["code", "total_days", "min_score", "max_score", "best_rank", "worst_rank"])


@query("a4_distinct_values", with_("store") + "SELECT DISTINCT code AS value FROM store UNION ALL SELECT DISTINCT adj_type FROM store")
def a4(spark, sf):
    df = spark.read.parquet(store(spark, sf))
    parts = [status.distinct_values(df, n).select(F.col(n).alias("value")) for n in ("code", "adj_type")]
    return parts[0].unionByName(parts[1])


@query("a5_latest_counts", with_("bars") + f"SELECT {T('d')} AS d, count(*) AS rows FROM bars GROUP BY bars.d ORDER BY bars.d DESC LIMIT 25")
def a5(spark, sf):
    return shown(quality.latest_counts(fx.bars(spark, sf), 25), ["d"], [], ["rows"])


# The table now against its state at the end of 1999.
CTES["was"] = CTES["by_adj"].replace("FROM store", "FROM (SELECT * FROM store WHERE d < DATE '2000-01-01' AND adj_type <> 'ind')")
_f = "SELECT adj_type, '{0}' AS field, CAST({0} AS VARCHAR) AS x FROM {1}"
for _n, _s in (("now_long", "by_adj"), ("was_long", "was")):
    CTES[_n] = " UNION ALL ".join(_f.format(c, _s) for c in ("min_d", "max_d", "rows", "codes"))


@query("a14_status_diff", with_("now_long", "was_long") + """
SELECT coalesce(s.adj_type, c.adj_type) AS adj_type, coalesce(s.field, c.field) AS field, s.x AS saved, c.x AS current
FROM was_long s FULL JOIN now_long c ON c.adj_type = s.adj_type AND c.field = s.field WHERE s.x IS DISTINCT FROM c.x""")
def a14(spark, sf):
    df = spark.read.parquet(store(spark, sf))
    old = df.where((F.col("d") < F.lit("2000-01-01").cast("date")) & (F.col("adj_type") != "ind"))
    return status.status_diff(status.bars_status(old), status.bars_status(df))


@query("j9_upsert_keys_only", with_("bars") + f"""
SELECT code, {T('d')} AS d, {R('max(v)')} AS v FROM (SELECT code, d, v FROM bars WHERE d < DATE '2000-01-01' UNION ALL SELECT code, d, NULL FROM bars WHERE d >= DATE '1999-01-01') GROUP BY code, d""")
def j9(spark, sf):
    b = fx.bars(spark, sf).select("code", "d", "v")
    keys = b.where(F.col("d") >= F.lit("1999-01-01").cast("date")).select("code", "d")
    return shown(tables.upsert(b.where(F.col("d") < F.lit("2000-01-01").cast("date")), keys, ["code", "d"]), ["d"], ["v"], ["code"])


@query("r10_series_breaks", with_("bars") + f"""
SELECT code, {T('d')} AS d, {T('n')} AS next_d, CAST(n - d AS INTEGER) AS days FROM (SELECT code, d, lead(d) OVER ({WIN}) AS n FROM bars) WHERE n - d > 21""")
def breaks(spark, sf):
    return shown(quality.series_breaks(fx.bars(spark, sf)), ["d", "next_d"], [], ["code", "days"])
