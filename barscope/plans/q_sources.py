"""Scans, loads and writes (S group), and the limits and set operations (L and U groups)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barscope.functions.values import day_text
from barscope.operators import clean, status
from barscope.operators.scoring import rank_scores
from barscope.plans import fixtures as fx
from barscope.plans.registry import CTES, R, T, query, shown, sql_shown, with_
from barscope.session import scratch_path
from barscope.sources import store as store_
from barscope.sources import tables
from barscope.streaming.ingest import read_days, stream_days

PX = ["o", "h", "l", "c", "v", "amount"]
BAR_SCHEMA = "code string, d date, o double, h double, l double, c double, v double, amount double"
_stored: dict[tuple, str] = {}

# A stored table with three kinds of series: raw, adjusted (half prices) and the index.
CTES["store"] = """
SELECT code, d, o, h, l, c, v, amount, 'raw' AS adj_type FROM bars
UNION ALL SELECT code, d, o / 2, h / 2, l / 2, c / 2, v, amount, 'qfq' FROM bars
UNION ALL SELECT 'ALL', d, o, h, l, c, v, amount, 'ind' FROM bench"""
CTES["plain_ranks"] = """
SELECT code, d, v AS score, c AS j,
  CAST(row_number() OVER (PARTITION BY d ORDER BY v DESC, c, code) AS INTEGER) AS rank,
  count(*) OVER (PARTITION BY d) AS total FROM bars"""


def store(spark, sf) -> str:
    """Path of the bar table, written once per session below the shared folder."""
    key = (spark.sparkContext.applicationId, sf, "bars")
    if key not in _stored:
        path = scratch_path(spark, "bars")
        raw = tables.write_folder(fx.bars(spark, sf), path, "adj_type", "raw")
        # Adjusted bars come from the stored raw ones, so the bars are aggregated once.
        half = spark.read.parquet(raw).withColumns({n: F.col(n) / 2 for n in "ohlc"})
        tables.write_folder(half, path, "adj_type", "qfq")
        index = fx.bench_bars(spark, sf)
        tables.write_folder(index.select("code", *[c for c in index.columns if c != "code"]), path, "adj_type", "ind")
        _stored[key] = path
    return _stored[key]


def plain_ranks(spark, sf):
    """Ranks by volume: a cheap stand-in for full scores."""
    s = fx.bars(spark, sf).select("code", "d", F.col("v").alias("score"), F.col("c").alias("j"))
    return rank_scores(s)


def rank_store(spark, sf) -> str:
    key = (spark.sparkContext.applicationId, sf, "ranks")
    if key not in _stored:
        path = scratch_path(spark, "ranks")
        tables.write_ranks(plain_ranks(spark, sf), path)
        _stored[key] = path
    return _stored[key]


def bars_out(df, *more):
    return shown(df, ["d"], PX, ["code", *more])


BARS_SQL = f"code, {sql_shown(['d'], PX)}"


@query("s1_read_bars", with_("store") + f"SELECT code, {T('d')} AS d, {R('c')} AS c, {R('v')} AS v FROM store "
       "WHERE adj_type = 'raw' AND d BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
def s1(spark, sf):
    df = tables.read_bars(spark, store(spark, sf), start="1997-01-01", end="1999-12-31", columns=["code", "d", "c", "v"], adj="raw")
    return shown(df, ["d"], ["c", "v"], ["code"])


@query("s1_read_newest", with_("store") + f"SELECT {BARS_SQL} FROM (SELECT * FROM store WHERE adj_type = 'raw' ORDER BY d DESC, code DESC LIMIT 500)")
def s1_newest(spark, sf):
    return bars_out(tables.read_bars(spark, store(spark, sf), adj="raw", limit=500, order="desc"))


@query("s2_count_bars", with_("store") + "SELECT count(*) AS n FROM store WHERE adj_type = 'qfq' AND d >= DATE '1998-01-01'")
def s2(spark, sf):
    return tables.count_bars(spark.read.parquet(store(spark, sf)), start="1998-01-01", adj="qfq")


@query("s3_read_codes", with_("store", "lists") + f"SELECT {BARS_SQL} FROM store WHERE adj_type = 'raw' AND code IN (SELECT code FROM lists WHERE list = 'white')")
def s3(spark, sf):
    white = fx.lists(spark, sf).where(F.col("list") == "white")
    return bars_out(tables.read_bars(spark, store(spark, sf), codes=white, adj="raw"))


@query("s4_read_market", with_("store") + f"SELECT {BARS_SQL}, adj_type FROM store")
def s4(spark, sf):
    return bars_out(tables.read_bars(spark, store(spark, sf)), "adj_type")


@query("s5_adj_filter", with_("store") + """
SELECT 'index' AS asked, adj_type, count(*) AS n FROM store WHERE adj_type = 'ind' GROUP BY adj_type
UNION ALL SELECT 'unknown', adj_type, count(*) FROM store WHERE adj_type IN ('qfq', 'raw') GROUP BY adj_type""")
def s5(spark, sf):
    df = spark.read.parquet(store(spark, sf))
    a = tables.select_bars(df, asset="index").withColumn("asked", F.lit("index"))
    b = tables.select_bars(df, adj="other").withColumn("asked", F.lit("unknown"))
    return a.unionByName(b).groupBy("asked", "adj_type").agg(F.count(F.lit(1)).alias("n"))


@query("s6_read_day", with_("store") + f"SELECT {BARS_SQL}, adj_type FROM store WHERE d = DATE '1998-06-15'")
def s6_day(spark, sf):
    return bars_out(tables.read_day(spark.read.parquet(store(spark, sf)), "1998-06-15"), "adj_type")


@query("s6_read_range", with_("bars") + f"""
SELECT 'head' AS part, {BARS_SQL} FROM (SELECT * FROM bars WHERE code = 'S000000003' AND d >= DATE '1996-01-01' ORDER BY d LIMIT 20)
UNION ALL SELECT 'tail', {BARS_SQL} FROM (SELECT * FROM bars WHERE code = 'S000000003' AND d >= DATE '1996-01-01' ORDER BY d DESC LIMIT 20)""")
def s6_range(spark, sf):
    b = spark.read.parquet(store(spark, sf)).where(F.col("adj_type") == "raw")
    head = tables.read_range(b, "S000000003", "1996-01-01", limit=20).withColumn("part", F.lit("head"))
    tail = tables.read_range(b, "S000000003", "1996-01-01", limit=-20).withColumn("part", F.lit("tail"))
    return bars_out(head.unionByName(tail), "part")


@query("s7_read_parquet", "SELECT o_orderkey, o_orderstatus FROM orders")
def s7(spark, sf):
    return tables.read_parquet_subset(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderstatus"])


@query("s8_describe", with_("bars") + """
SELECT x.pos, x.name AS "column", x.type, n.rows FROM (VALUES (0, 'code', 'string'), (1, 'd', 'date'), (2, 'o', 'double'),
 (3, 'h', 'double'), (4, 'l', 'double'), (5, 'c', 'double'), (6, 'v', 'double'), (7, 'amount', 'double')) x(pos, name, type)
CROSS JOIN (SELECT count(*) AS rows FROM bars) n""")
def s8(spark, sf):
    return status.describe_schema(fx.bars(spark, sf))


@query("s9_parquet_to_csv", with_("bars") + f"SELECT {BARS_SQL} FROM bars")
def s9(spark, sf):
    dst = scratch_path(spark, "csv")
    tables.parquet_to_csv(spark, f"{store(spark, sf)}/adj_type=raw", dst)
    return bars_out(tables.load_table(spark, dst, "csv", BAR_SCHEMA))


@query("s10_export_range", with_("bars") + f"SELECT {BARS_SQL} FROM bars WHERE code = 'S000000005' AND d >= DATE '1997-01-01'")
def s10(spark, sf):
    dst = scratch_path(spark, "export")
    tables.export_range(fx.bars(spark, sf), "S000000005", dst, start="1997-01-01")
    return bars_out(tables.load_table(spark, dst, "csv", BAR_SCHEMA))


@query("s11_read_ranks", with_("plain_ranks") + f"SELECT code, {T('d')} AS d, score, rank, total FROM plain_ranks WHERE d >= DATE '2000-01-01'")
def s11(spark, sf):
    df = tables.read_ranks(spark, rank_store(spark, sf), start="2000-01-01")
    return shown(df, ["d"], [], ["code", "score", "rank", "total"])


@query("s12_ranks_from_details", with_("plain_ranks") + f"SELECT code, {T('d')} AS d, score, rank, total FROM plain_ranks")
def s12(spark, sf):
    path = scratch_path(spark, "details")
    b = fx.bars(spark, sf)
    b.select("code", "d", F.col("v").alias("score"), F.col("c").alias("tiebreak")).write.json(path)
    records = tables.load_table(spark, path, "json", "code string, d date, score double, tiebreak double")
    return shown(tables.ranks_from_details(records), ["d"], [], ["code", "score", "rank", "total"])


@query("s13_load_json", with_("bars") + f"SELECT {BARS_SQL} FROM bars")
def s13(spark, sf):
    path = scratch_path(spark, "json")
    fx.bars(spark, sf).write.json(path)
    return bars_out(tables.load_table(spark, path, "json", BAR_SCHEMA))


OLD, NEW = "DATE '2000-01-01'", "DATE '1999-07-01'"


@query("s14_replace", with_("bars") + f"SELECT {BARS_SQL} FROM bars WHERE d < {OLD}")
def s14(spark, sf):
    path, b = scratch_path(spark, "replace"), fx.bars(spark, sf)
    tables.write(b, path)
    tables.write(b.where(F.col("d") < F.lit("2000-01-01").cast("date")), path, "replace")
    return bars_out(spark.read.parquet(path))


@query("s15_append", with_("bars") + f"""
SELECT {BARS_SQL} FROM (SELECT * FROM bars WHERE d < {OLD} UNION ALL
SELECT code, d, o, h, l, c, v, NULL AS amount FROM bars WHERE d >= {OLD})""")
def s15(spark, sf):
    path, b = scratch_path(spark, "append"), fx.bars(spark, sf)
    cut = F.lit("2000-01-01").cast("date")
    tables.write(b.where(F.col("d") < cut), path)
    extra = b.where(F.col("d") >= cut).drop("amount").withColumn("unknown", F.lit(1))
    tables.write(extra, path, "append")
    return bars_out(spark.read.schema(BAR_SCHEMA).parquet(path))


# Updates carry code, d, v and amount; some amounts are null on purpose.
CTES["ups"] = f"""
SELECT code, d, v + 1 AS v, CASE WHEN v > 25 THEN amount END AS amount FROM bars WHERE d >= {NEW}"""


@query("s16_upsert", with_("bars", "ups") + f"""
SELECT coalesce(b.code, u.code) AS code, {T('coalesce(b.d, u.d)')} AS d, {R('b.c')} AS c,
  {R('CASE WHEN u.code IS NULL THEN b.v ELSE u.v END')} AS v, {R('CASE WHEN u.code IS NULL THEN b.amount ELSE u.amount END')} AS amount
FROM (SELECT * FROM bars WHERE d < {OLD}) b FULL JOIN ups u ON u.code = b.code AND u.d = b.d""")
def s16(spark, sf):
    b = fx.bars(spark, sf)
    new = b.where(F.col("d") >= F.lit("1999-07-01").cast("date")).select(
        "code", "d", (F.col("v") + 1).alias("v"), F.when(F.col("v") > 25, F.col("amount")).alias("amount"))
    out = tables.upsert(b.where(F.col("d") < F.lit("2000-01-01").cast("date")), new, ["code", "d"])
    return shown(out, ["d"], ["c", "v", "amount"], ["code"])


@query("s16_stored_upsert", with_("bars") + f"""
SELECT code, {T('d')} AS d, {R(f"CASE WHEN d < {OLD} THEN c WHEN d >= DATE '2001-01-01' THEN 2 * c END")} AS c,
  {R(f'CASE WHEN d >= {NEW} THEN v + 1 ELSE v END')} AS v, {R(f'CASE WHEN d < {NEW} OR v > 25 THEN amount END')} AS amount
FROM bars""")
def s16_stored(spark, sf):
    """A stored table of the older bars: an upsert with nulls, a write broken off before its commit, keys only, then prices."""
    root = scratch_path(spark, "upserted")
    b = fx.bars(spark, sf).withColumn("ym", store_.month())
    old, late = F.col("d") < F.lit("2000-01-01").cast("date"), F.col("d") >= F.lit("2001-01-01").cast("date")
    first = store_.create(b.where(old), root, ["code", "d"], "ym")
    new = b.where(F.col("d") >= F.lit("1999-07-01").cast("date"))
    ups = new.select("code", "d", "ym", (F.col("v") + 1).alias("v"), F.when(F.col("v") > 25, F.col("amount")).alias("amount"))
    store_.upsert(ups, root)
    store_.stage(b.withColumn("c", F.lit(0.0)), root, first, list(first.folders))
    store_.upsert(b.select("code", "d", "ym"), root)
    store_.upsert(b.where(late).select("code", "d", "ym", (F.col("c") * 2).alias("c")), root)
    return shown(store_.read(spark, root), ["d"], ["c", "v", "amount"], ["code"])


@query("s16_rank_update", with_("plain_ranks") + f"""
SELECT code, {T('d')} AS d, CAST(min(rank) AS INTEGER) AS rank, max(total) AS total FROM plain_ranks GROUP BY code, d""")
def s16_rank(spark, sf):
    r = plain_ranks(spark, sf).select("code", "d", "rank", "total")
    twice = r.unionByName(r.withColumn("rank", F.col("rank") + 5))
    out = tables.upsert(r.withColumn("rank", F.lit(None).cast("int")), tables.lowest_rank(twice), ["code", "d"])
    return shown(out, ["d"], [], ["code", "rank", "total"])


@query("s17_lists", with_("lists") + "SELECT code, 'pass' AS reason, '20000103' AS period FROM lists WHERE list = 'white'")
def s17(spark, sf):
    path, day = scratch_path(spark, "lists"), F.lit("2000-01-03").cast("date")
    both = fx.lists(spark, sf).withColumns({"d": day, "period": F.lit("20000103"), "reason": F.lit("pass")})
    tables.write_lists(both, path)
    return tables.read_list(spark, path, "2000-01-03", "white").select("code", "reason", "period")


@query("s17_lists_by_date", """
WITH x AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS code, s_suppkey AS k FROM supplier)
SELECT code, '20000103' AS day, 'white' AS list, 'new' AS reason FROM x WHERE k % 3 = 0
UNION ALL SELECT code, '20000105', 'black', 'first' FROM x WHERE k % 2 = 1""")
def s17_dates(spark, sf):
    """Three dates one after another, the second without rows; then the first again. Other dates stay."""
    path = scratch_path(spark, "lists")
    k = F.col("s_suppkey")
    s = fx.load(spark, sf, "supplier").select(fx.code_of("s_suppkey").alias("code"), k)

    def listed(cond, day, name, reason):
        more = {"d": F.lit(day).cast("date"), "list": F.lit(name), "reason": F.lit(reason), "period": F.lit(day)}
        tables.write_lists(s.where(cond).withColumns(more), path, [day])

    listed(k % 2 == 0, "2000-01-03", "white", "first")
    listed(k < 0, "2000-01-04", "white", "none")
    listed(k % 2 == 1, "2000-01-05", "black", "first")
    listed(k % 3 == 0, "2000-01-03", "white", "new")
    return tables.read_list(spark, path).select("code", day_text("d").alias("day"), "list", "reason")


@query("s11_backfill", with_("plain_ranks") + f"SELECT code, {T('d')} AS d, rank, total FROM plain_ranks")
def s11_backfill(spark, sf):
    """A stored rank table lacks some dates and holds a wrong one; both are written into it."""
    r, path = plain_ranks(spark, sf), scratch_path(spark, "ranks")
    odd, bad = F.dayofmonth("d") % 5 == 0, F.col("d") == F.lit("1999-03-11").cast("date")
    tables.write_ranks(r.where(~odd).withColumn("rank", F.when(bad, F.lit(-1)).otherwise(F.col("rank"))), path)
    tables.add_ranks(r.where(odd | bad), path)
    return shown(tables.read_ranks(spark, path), ["d"], [], ["code", "rank", "total"])


@query("s18_save", with_("plain_ranks") + f"SELECT code, {T('d')} AS d, rank FROM plain_ranks")
def s18(spark, sf):
    path = tables.save(plain_ranks(spark, sf), scratch_path(spark, "results"), "all_ranks")
    return shown(spark.read.parquet(path), ["d"], [], ["code", "rank"])


@query("s19_ingest_day", with_("bars", "basics") + f"""
SELECT b.code, {T('b.d')} AS d, {R('b.c')} AS c, {R('t.tor')} AS tor FROM bars b LEFT JOIN basics t ON t.code = b.code AND t.d = b.d""")
def s19(spark, sf):
    b = fx.bars(spark, sf)
    return shown(clean.ingest_day(b, fx.basics(b, fx.calendar(b))), ["d"], ["c", "tor"], ["code"])


@query("s19_stream_days", with_("bars") + f"SELECT {BARS_SQL} FROM bars")
def s19_stream(spark, sf):
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "stream")
    b = fx.bars(spark, sf).withColumn("seq", F.lit(1))
    b.write.parquet(landing)
    stream_days(spark, landing, b.schema, out, scratch_path(spark, "offsets")).awaitTermination()
    return bars_out(read_days(spark, out))


CTES["latest_basics"] = "SELECT code, arg_max(tor, d) AS tor FROM basics GROUP BY code"


@query("s20_attach_basics", with_("symbols", "latest_basics") + f"SELECT s.code, s.name, {R('b.tor')} AS tor FROM symbols s LEFT JOIN latest_basics b ON b.code = s.code")
def s20(spark, sf):
    b = fx.bars(spark, sf)
    out = clean.attach_basics(fx.symbols(spark, sf), fx.basics(b, fx.calendar(b)))
    return shown(out, [], ["tor"], ["code", "name"])


@query("s21_partition_dates", with_("bars") + f"SELECT DISTINCT {T('d')} AS d FROM bars")
def s21(spark, sf):
    return shown(tables.partition_dates(spark.read.parquet(rank_store(spark, sf))), ["d"])


# Limits and set operations.

@query("l1_sort_ranked", with_("plain_ranks") + f"SELECT code, {T('d')} AS d, score, j FROM plain_ranks ORDER BY score DESC, j, code")
def l1(spark, sf):
    return clean.sort_ranked(plain_ranks(spark, sf)).select("code", day_text("d").alias("d"), "score", "j")


@query("l2_newest_per_symbol", with_("bars") + f"""
SELECT {BARS_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS k FROM bars) WHERE k <= 5""")
def l2(spark, sf):
    return bars_out(clean.newest(fx.bars(spark, sf), 5))


@query("l2_top_k", with_("bars") + f"SELECT {BARS_SQL} FROM (SELECT * FROM bars ORDER BY amount DESC, code, d LIMIT 50)")
def l2_top(spark, sf):
    return bars_out(clean.top_k(fx.bars(spark, sf), 50, F.col("amount").desc(), F.col("code"), F.col("d")))


@query("l3_head_tail", with_("bars") + f"""
SELECT 'head' AS part, {BARS_SQL} FROM (SELECT * FROM bars ORDER BY d, code LIMIT 40) UNION ALL
SELECT 'tail', {BARS_SQL} FROM (SELECT * FROM bars ORDER BY d DESC, code DESC LIMIT 40)""")
def l3(spark, sf):
    b = fx.bars(spark, sf)
    parts = [clean.head_tail(b, n).withColumn("part", F.lit(p)) for n, p in ((40, "head"), (-40, "tail"))]
    return bars_out(parts[0].unionByName(parts[1]), "part")


@query("u1_union_bars", with_("bars", "event_bars") + f"""
SELECT {BARS_SQL}, NULL AS tor FROM bars UNION ALL SELECT {BARS_SQL}, v AS tor FROM event_bars""")
def u1(spark, sf):
    e = fx.event_bars(spark, sf).withColumn("tor", F.col("v"))
    return bars_out(clean.union_bars(fx.bars(spark, sf), e), "tor")


@query("u3_code_sets", with_("symbols", "bars", "lists") + """
SELECT 'missing' AS kind, code FROM (SELECT code FROM symbols EXCEPT SELECT code FROM bars)
UNION ALL SELECT 'common', code FROM (SELECT code FROM bars INTERSECT SELECT code FROM lists WHERE list = 'white')""")
def u3(spark, sf):
    b, white = fx.bars(spark, sf), fx.lists(spark, sf).where(F.col("list") == "white")
    miss = clean.code_diff(fx.symbols(spark, sf), b).withColumn("kind", F.lit("missing"))
    return miss.unionByName(clean.code_common(b, white).withColumn("kind", F.lit("common")))
