"""Cross-sections, benchmark features, category and custom lists (W25 to W34, A7, A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barscope.functions.values import day_text
from barscope.operators import benchmark, category, crosssection as xs
from barscope.operators import calendar as cal
from barscope.operators.custom import Combination, custom_rank
from barscope.operators.ranking import average_ranks
from barscope.plans import fixtures as fx
from barscope.plans import q_rules  # noqa: F401  (defines the SQL of stored records)
from barscope.plans.q_sources import plain_ranks
from barscope.plans.q_values import half_bench
from barscope.plans.registry import CTES, R, T, WIN, lag, out_num, over, query, shown, sql_shown, with_
from barscope.session import scratch_path
from barscope.sources import tables


def finite(name):
    """Infinite ranks as a large number, so both engines print them alike."""
    return F.least(F.col(name), F.lit(1e9))


def avg_rank_sql(value: str, direction: str = "") -> str:
    return f"rank() OVER (PARTITION BY d ORDER BY {value} {direction}) + (count(*) OVER (PARTITION BY d, {value}) - 1) / 2.0"


CTES["rv"] = f"SELECT code, d, {avg_rank_sql('v')} AS r FROM bars"


def vol_rank(name, k, cut, size=None):
    @query(name, with_("rv") + f"SELECT code, {T('d')} AS d, {R(cut, 2)} AS rv FROM rv")
    def run(spark, sf):
        out = xs.rank_vol(fx.bars(spark, sf), k, size)
        return shown(out.withColumn("rv", finite("rv")), ["d"], ["rv"], ["code"], 2)


vol_rank("w25_rank_vol", None, "r")
vol_rank("w25_rank_vol_sorted", None, "r", 1.0)
vol_rank("w25_rank_vol_k", 10, "CASE WHEN r > 10 THEN 1e9 ELSE r END")

CTES["rets"] = f"""
SELECT code, d, idx, CASE WHEN pi = idx - 1 THEN c / nullif(pc, 0) - 1 END AS ret FROM (SELECT code, d, c, {lag('c')} AS pc, idx, {lag('idx')} AS pi FROM bars JOIN cal USING (d))"""
# Every code of a date: a missing return ranks after the last; the first date has no ranks.
CTES["in_all"] = "SELECT *, true AS inside FROM rets"
CTES["in_top5"] = "SELECT *, row_number() OVER (PARTITION BY d ORDER BY ret DESC NULLS LAST, code) <= 5 AS inside FROM rets"


def ret_rank_sql(source: str, direction: str) -> str:
    mean = (
        f"CASE WHEN ret IS NOT NULL THEN rank() OVER (PARTITION BY d, inside ORDER BY ret {direction} NULLS LAST)"
        " + (count(*) OVER (PARTITION BY d, inside, ret) - 1) / 2.0 END"
    )
    return (
        f"SELECT code, d, CASE WHEN inside AND idx > 1 THEN coalesce(m, floor(coalesce(max(m) OVER (PARTITION BY d, inside), 0)) + 1) END AS r"
        f" FROM (SELECT *, {mean} AS m FROM {source})"
    )


def ret_rank(name, side, k, source):
    inner = ret_rank_sql(source, "DESC" if side == "up" else "ASC")

    @query(name, with_(source) + f"SELECT code, {T('d')} AS d, {R(f'coalesce(CASE WHEN r > {k or 10**9} THEN 1e9 ELSE r END, 1e9)', 2)} AS r FROM ({inner})")
    def run(spark, sf):
        b = fx.bars(spark, sf)
        out = xs.rank_ret(b, fx.calendar(b), side, k)
        return shown(out.withColumn("r", finite("r")), ["d"], ["r"], ["code"], 2)


ret_rank("w26_rank_ret_up", "up", None, "in_all")
ret_rank("w26_rank_ret_down", "down", None, "in_all")
ret_rank("w26_rank_ret_top", "up", 5, "in_top5")
ret_rank("w26_rank_ret_top_down", "down", 5, "in_top5")


@query("w27_match_coef", with_("rv", "in_all") + f"""
SELECT v.code, {T('v.d')} AS d, {R("least(greatest(n / greatest(least(coalesce(u.r, 'inf'::DOUBLE) * greatest(1.0, n + 1 - v.r), coalesce(w.r, 'inf'::DOUBLE) * v.r), 1.0), 0.0), 1.0)", 4)} AS coef
FROM (SELECT *, count(*) OVER (PARTITION BY d) AS n FROM rv) v JOIN ({ret_rank_sql('in_all', 'DESC')}) u ON u.code = v.code AND u.d = v.d
JOIN ({ret_rank_sql('in_all', 'ASC')}) w ON w.code = v.code AND w.d = v.d""")
def w27(spark, sf):
    b = fx.bars(spark, sf)
    out = xs.rank_match_coef(b, fx.calendar(b))
    return shown(out, ["d"], ["coef"], ["code"], 4)


@query("n12_average_rank_missing", with_("rv") + f"""
SELECT code, {T('d')} AS d, {R('coalesce(r, floor(coalesce(max(r) OVER (PARTITION BY d), 0)) + 1)', 2)} AS r FROM (
SELECT code, d, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY d ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY d, x) - 1) / 2.0 END AS r
FROM (SELECT *, CASE WHEN v <= 40 THEN v END AS x FROM bars))""")
def n12(spark, sf):
    df = fx.bars(spark, sf).select("code", "d", F.when(F.col("v") <= 40, F.col("v")).alias("x"))
    return shown(average_ranks(df, ["d"], "x", up="r"), ["d"], ["r"], ["code"], 2)


# Benchmark features, with a benchmark that lacks a third of the dates.

def _bench(how: str, name: str):
    joined = "LEFT JOIN" if how == "ffill" else "JOIN"
    hold = (lambda x: f"last_value({x} IGNORE NULLS) {over()}") if how == "ffill" else (lambda x: x)
    CTES[f"{name}_a"] = f"SELECT b.code, b.d, b.c, i.idx_c, i.idx_ret FROM bars b {joined} half_bench i ON i.d = b.d"
    CTES[f"{name}_b"] = (
        f"SELECT code, d, c, {hold('idx_c')} AS idx_c, {hold('idx_ret')} AS idx_ret, c / nullif({lag('c')}, 0) - 1 AS ret FROM {name}_a"
    )
    CTES[f"{name}_c"] = (
        f"SELECT *, ret - idx_ret AS exret, c / nullif(idx_c, 0) AS ratio, "
        f"CASE WHEN idx_ret IS NOT NULL THEN ret END AS x, CASE WHEN ret IS NOT NULL THEN idx_ret END AS y FROM {name}_b"
    )
    w = over(20)
    text = with_(f"{name}_c") + f"""
SELECT code, {T('d')} AS d, {R('exret', 4)} AS exret, {R(f'CASE WHEN count(exret) {w} >= 6 THEN sum(exret) {w} END', 4)} AS exret_sum,
  {R(f'ratio / CASE WHEN count(ratio) {w} >= 6 THEN avg(ratio) {w} END', 4)} AS rs,
  {R(f'CASE WHEN count(x) {w} >= 20 THEN covar_samp(x, y) {w} END / CASE WHEN count(idx_ret) {w} >= 20 THEN nullif(var_samp(idx_ret) {w}, 0) END', 3)} AS beta,
  {R(f'CASE WHEN count(x) {w} >= 20 THEN covar_samp(x, y) {w} / nullif(stddev_samp(x) {w} * stddev_samp(y) {w}, 0) END', 4)} AS corr FROM {name}_c"""

    @query(f"w28_benchmark_{how}", text)
    def run(spark, sf):
        out = benchmark.benchmark_features(fx.bars(spark, sf), half_bench(spark, sf), 20, how)
        return out.select("code", day_text("d").alias("d"), *[out_num(n, 4).alias(n) for n in ("exret", "exret_sum", "rs", "corr")],
                          out_num("beta", 3).alias("beta"))


_bench("ffill", "bf")
_bench("drop", "bd")

# Two benchmarks that lack different dates; the second one sees what the first has left.
CTES["high_bench"] = "SELECT d, h AS idx_c, h / nullif(lag(h) OVER (ORDER BY d), 0) - 1 AS idx_ret FROM bench WHERE day(d) % 5 <> 1"
_FEATURES = {"exret": 4, "exret_sum": 4, "rs": 4, "beta": 3, "corr": 4}


def _two_benches(how: str):
    joined = "LEFT JOIN" if how == "ffill" else "JOIN"
    hold = (lambda x: f"last_value({x} IGNORE NULLS) {over()}") if how == "ffill" else (lambda x: x)
    source, kept, w = "bars", "", over(20)
    for tag, bench in (("close", "half_bench"), ("high", "high_bench")):
        at = f"two_{how}_{tag}"
        CTES[f"{at}_a"] = f"SELECT s.*, i.idx_c, i.idx_ret FROM (SELECT code, d, c{kept} FROM {source}) s {joined} {bench} i ON i.d = s.d"
        CTES[f"{at}_b"] = (
            f"SELECT * EXCLUDE (idx_c, idx_ret), {hold('idx_c')} AS idx_c, {hold('idx_ret')} AS idx_ret, c / nullif({lag('c')}, 0) - 1 AS ret FROM {at}_a"
        )
        CTES[f"{at}_c"] = (
            f"SELECT *, ret - idx_ret AS exret, c / nullif(idx_c, 0) AS ratio, "
            f"CASE WHEN idx_ret IS NOT NULL THEN ret END AS x, CASE WHEN ret IS NOT NULL THEN idx_ret END AS y FROM {at}_b"
        )
        CTES[f"{at}_d"] = f"""SELECT code, d, c{kept}, exret AS exret_{tag}, CASE WHEN count(exret) {w} >= 6 THEN sum(exret) {w} END AS exret_sum_{tag},
  ratio / CASE WHEN count(ratio) {w} >= 6 THEN avg(ratio) {w} END AS rs_{tag},
  CASE WHEN count(x) {w} >= 20 THEN covar_samp(x, y) {w} END / CASE WHEN count(idx_ret) {w} >= 20 THEN nullif(var_samp(idx_ret) {w}, 0) END AS beta_{tag},
  CASE WHEN count(x) {w} >= 20 THEN covar_samp(x, y) {w} / nullif(stddev_samp(x) {w} * stddev_samp(y) {w}, 0) END AS corr_{tag} FROM {at}_c"""
        source, kept = f"{at}_d", kept + "".join(f", {x}_{tag}" for x in _FEATURES)
    names = {f"{x}_{tag}": n for tag in ("close", "high") for x, n in _FEATURES.items()}
    text = with_(source) + f"SELECT code, {T('d')} AS d, {', '.join(f'{R(x, n)} AS {x}' for x, n in names.items())} FROM {source}"

    @query(f"w28_two_benchmarks_{how}", text)
    def run(spark, sf):
        high = fx.bench_bars(spark, sf).where(F.dayofmonth("d") % 5 != 1).select("d", F.col("h").alias("c"))
        out = benchmark.several_benchmarks(fx.bars(spark, sf), {"close": half_bench(spark, sf), "high": high}, 20, how)
        return out.select("code", day_text("d").alias("d"), *[out_num(x, n).alias(x) for x, n in names.items()])


_two_benches("ffill")
_two_benches("drop")

# Custom combinations over stored rule records.
COMBOS = {
    "any": Combination(rules=("golden", "streak"), agg_mode="OR"),
    "all": Combination(rules=("golden", "busy"), agg_mode="AND", exclude=("below",)),
    "groups": Combination(groups=(("OR", ("golden", "streak")), ("AND", ("below", "busy"))), group_mode="AND", exclude=("peak",)),
    "either": Combination(groups=(("AND", ("golden", "mixed")), ("AND", ("streak", "week_up"))), group_mode="OR"),
}
_HAS = {n: f"coalesce(bool_or(name = '{n}'), false)" for n in ("golden", "streak", "busy", "below", "peak", "mixed", "week_up")}
_LOGIC = {
    "any": (f"{_HAS['golden']} OR {_HAS['streak']}", ("golden", "streak")),
    "all": (f"{_HAS['golden']} AND {_HAS['busy']} AND NOT {_HAS['below']}", ("golden", "busy")),
    "groups": (f"({_HAS['golden']} OR {_HAS['streak']}) AND {_HAS['below']} AND {_HAS['busy']} AND NOT {_HAS['peak']}", ("golden", "streak", "below", "busy")),
    "either": (f"({_HAS['golden']} AND {_HAS['mixed']}) OR ({_HAS['streak']} AND {_HAS['week_up']})", ("golden", "mixed", "streak", "week_up")),
}


def combo(kind: str):
    cond, names = _LOGIC[kind]
    inside = f"name IN ({', '.join(repr(n) for n in names)})"
    text = with_("details") + f"""
SELECT x.code, {T('x.d')} AS d, b.v AS score, b.c AS j, x.triggered, x.dates FROM (
SELECT code, d, array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE {inside})), ',') AS triggered,
  array_to_string(list_transform(list_sort(list_distinct(flatten(list(dates) FILTER (WHERE {inside})))), lambda e: strftime(e, '%Y%m%d')), ',') AS dates
FROM details GROUP BY code, d HAVING {cond}) x JOIN bars b ON b.code = x.code AND b.d = x.d"""

    @query(f"w29_custom_{kind}", text)
    def run(spark, sf):
        s = fx.bars(spark, sf).select("code", "d", F.col("v").alias("score"), F.col("c").alias("j"))
        out = custom_rank(fx.details(spark, sf), s, COMBOS[kind])
        dates = F.array_join(F.transform("trigger_dates", lambda x: F.date_format(x, "yyyyMMdd")), ",")
        return out.select("code", day_text("d").alias("d"), "score", "j", F.array_join("triggered", ",").alias("triggered"), dates.alias("dates"))


for _kind in COMBOS:
    combo(_kind)

@query("w29_custom_top", with_("details", "lists") + f"""
SELECT code, {T('d')} AS d, score, j FROM (SELECT b.code, b.d, b.v AS score, CASE WHEN b.c < 50000 THEN b.c ELSE 999999.0 END AS j,
  row_number() OVER (PARTITION BY b.d ORDER BY b.v DESC, CASE WHEN b.c < 50000 THEN b.c ELSE 999999.0 END, b.code) AS n FROM bars b JOIN (
  SELECT code, d FROM details WHERE name IN ('golden', 'streak') GROUP BY code, d) x ON b.code = x.code AND b.d = x.d
  WHERE b.code IN (SELECT code FROM lists WHERE list = 'white')) WHERE n <= 2""")
def w29_top(spark, sf):
    """The first two of each date among the white-listed codes; some have no j."""
    s = fx.bars(spark, sf).select("code", "d", F.col("v").alias("score"), F.when(F.col("c") < 50000, F.col("c")).alias("j"))
    out = custom_rank(fx.details(spark, sf), s, COMBOS["any"], 2, "white", fx.lists(spark, sf))
    return out.select("code", day_text("d").alias("d"), "score", "j")


# Category lists.
CTES["span"] = "SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT d FROM cal ORDER BY d DESC LIMIT 60)"
CTES["weights"] = "SELECT d, i, w / avg(w) OVER () AS w FROM (SELECT d, i, pow(0.5, (59 - i) / 10.0) AS w FROM span)"
LIST_COLS = "code, strength, mean_strength, CAST(hits AS BIGINT) AS hits, best_rank, last_rank, first, last"


def strength_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, {R('sum((1.0 - (rank - 1.0) / total) * w)')} AS strength,
  {R('sum((1.0 - (rank - 1.0) / total) * w) / greatest(sum(w), 1e-9)')} AS mean_strength, count(*) AS hits, min(rank) AS best_rank,
  arg_max(rank, d) AS last_rank, min(d) AS first, max(d) AS last FROM {source} GROUP BY {keys}"""


CTES["weighted"] = "SELECT p.*, w FROM plain_ranks p JOIN weights USING (d)"
CTES["strength"] = strength_sql("weighted", "code")


def span(b):
    return cal.trade_span(fx.calendar(b), end="2001-11-04", n=60)


def list_out(df, *more):
    return shown(df, ["first", "last"], [], [*more, "code", "hits", *[c for c in ("strength", "mean_strength", "best_rank", "last_rank") if c in df.columns]])


@query("w31_strength", with_("strength") + f"""
SELECT code, hits, strength, mean_strength, best_rank, last_rank, {T('first')} AS first, {T('last')} AS last FROM strength
WHERE hits >= 3 ORDER BY strength DESC, strength.last DESC, best_rank, code LIMIT 50""")
def w31(spark, sf):
    days = span(fx.bars(spark, sf))
    return list_out(category.category_rank(plain_ranks(spark, sf), days, min_hits=3, top_n=50, weights="exp", half_life=10.0))


@query("w30_hits", with_("plain_ranks", "span") + f"""
SELECT code, hits, {T('first')} AS first, {T('last')} AS last FROM (
SELECT code, count(*) AS hits, min(d) AS first, max(d) AS last FROM plain_ranks JOIN span USING (d) WHERE rank <= 20 GROUP BY code)
WHERE hits >= 5 ORDER BY hits DESC, last DESC, code LIMIT 20""")
def w30(spark, sf):
    days = span(fx.bars(spark, sf))
    return list_out(category.category_rank(plain_ranks(spark, sf), days, "hits", min_hits=5, top_n=20))


@query("w30_list_hits", with_("plain_ranks", "span") + f"""
SELECT list, code, hits, {T('first')} AS first, {T('last')} AS last FROM (
SELECT list, code, count(*) AS hits, min(d) AS first, max(d) AS last FROM (
  SELECT code, d, unnest(list_filter([CASE WHEN rank <= 30 THEN 'white' END, CASE WHEN rank > total - 30 THEN 'black' END], lambda e: e IS NOT NULL)) AS list
  FROM plain_ranks JOIN span USING (d)) GROUP BY list, code) WHERE hits >= 3""")
def w30_lists(spark, sf):
    """White and black lists of a span's dates, stored and read again."""
    days, path = span(fx.bars(spark, sf)), scratch_path(spark, "lists")
    both = F.array_compact(F.array(F.when(F.col("rank") <= 30, F.lit("white")), F.when(F.col("rank") > F.col("total") - 30, F.lit("black"))))
    r = plain_ranks(spark, sf).join(F.broadcast(days.select("d")), "d", "left_semi").withColumn("list", F.explode(both))
    tables.write_lists(r.withColumns({"period": F.lit("x"), "reason": F.lit("rank")}), path)
    stored = tables.read_list(spark, path)
    hits = [list_out(category.list_hits(stored, days, n, 3).withColumn("list", F.lit(n)), "list") for n in tables.LISTS]
    return hits[0].unionByName(hits[1])


@query("w32_time_weights", with_("span") + f"""
SELECT {T('d')} AS d, {R("w1 / avg(w1) OVER ()")} AS w_exp, {R("w2 / avg(w2) OVER ()")} AS w_linear, 1.0::DOUBLE AS w_none
FROM (SELECT d, pow(0.5, (59 - i) / 5.0) AS w1, 0.3 + 0.7 * i / 59.0 AS w2 FROM span)""")
def w32(spark, sf):
    """The weight of every date of a span."""
    days = cal.trade_dates(span(fx.bars(spark, sf)))
    n = days.count()
    modes = [category.time_weights(n, m) for m in ("exp", "linear", "none")]
    table = spark.createDataFrame([(i + 1, *w) for i, w in enumerate(zip(*modes))], "idx int, w_exp double, w_linear double, w_none double")
    return shown(days.join(F.broadcast(table), "idx"), ["d"], ["w_exp", "w_linear", "w_none"])


# Every end date over its last 10 trading days, halving weights, ranks up to 15.
CTES["ends"] = """
SELECT e.d AS end_d, least(e.idx, 10) AS span, c.d, pow(0.5, (e.idx - c.idx) / 7.0) AS w0
FROM cal e JOIN cal c ON c.idx BETWEEN e.idx - 9 AND e.idx"""
CTES["ends_w"] = "SELECT *, w0 / avg(w0) OVER (PARTITION BY end_d) AS w FROM ends"
CTES["rolled"] = "SELECT x.end_d, x.span, x.w, p.* FROM plain_ranks p JOIN ends_w x USING (d) WHERE p.rank <= 15"
CTES["rolling"] = strength_sql("rolled", "end_d, span, code")
CTES["placed"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY end_d ORDER BY strength DESC, last DESC, best_rank, code) AS INTEGER) AS place
FROM rolling WHERE hits >= greatest(1, least(2, span))"""


def rolling(spark, sf):
    b = fx.bars(spark, sf)
    return category.category_rank_rolling(plain_ranks(spark, sf), fx.calendar(b), 10, min_hits=2, top_n=30, top_m=15,
                                          weights="exp", half_life=7.0)


@query("w33_rolling", with_("placed") + f"""
SELECT {T('end_d')} AS end_d, code, hits, strength, mean_strength, best_rank, last_rank, {T('first')} AS first, {T('last')} AS last, place
FROM placed WHERE place <= 30""")
def w33(spark, sf):
    return shown(rolling(spark, sf), ["end_d", "first", "last"], [], ["code", "hits", "strength", "mean_strength", "best_rank", "last_rank", "place"])


@query("w34_category_codes", with_("placed") + f"""
SELECT {T('end_d')} AS end_d, code FROM placed WHERE place <= 30 AND end_d = (SELECT max(end_d) FROM placed WHERE end_d <= DATE '1999-08-15')""")
def w34(spark, sf):
    return shown(category.category_codes(rolling(spark, sf), "1999-08-15"), ["end_d"], [], ["code"])


@query("a7_hit_counts", with_("plain_ranks") + f"""
SELECT code, count(*) AS hits, {T('min(d)')} AS first, {T('max(d)')} AS last FROM plain_ranks WHERE rank <= 3 GROUP BY code HAVING count(*) >= 40""")
def a7(spark, sf):
    return list_out(category.hit_counts(plain_ranks(spark, sf).where(F.col("rank") <= 3), 40))


CTES["unit"] = "SELECT *, 1.0 AS w FROM plain_ranks"
CTES["unit_strength"] = strength_sql("unit", "code")


@query("a8_rank_strength", with_("unit_strength") + f"""
SELECT code, hits, strength, mean_strength, best_rank, last_rank, {T('first')} AS first, {T('last')} AS last FROM unit_strength WHERE hits >= 10""")
def a8(spark, sf):
    return list_out(category.rank_strength(plain_ranks(spark, sf).withColumn("w", F.lit(1.0)), 10))
