"""Rule scopes, scoring, ranking and screens (W1 to W24, W35), and their aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from barscope.functions import scopes
from barscope.functions.values import day_text, rnd
from barscope.operators.ranking import rank_within, steps
from barscope.operators import research, rules as rl, scoring
from barscope.operators.calendar import missing_dates
from barscope.operators.clean import apply_universe
from barscope.operators.custom import trigger_span
from barscope.operators.indicators import with_indicators
from barscope.operators.rules import Clause, Rule
from barscope.plans import fixtures as fx
from barscope.plans.q_sources import plain_ranks
from barscope.plans.registry import CTES, R, T, WIN, over, out_num, query, shown, sql_shown, with_


@query("bars", with_("bars") + f"SELECT code, {sql_shown(['d'], ['o', 'h', 'l', 'c', 'v', 'amount'])} FROM bars")
def bars(spark, sf):
    return shown(fx.bars(spark, sf), ["d"], ["o", "h", "l", "c", "v", "amount"], ["code"])


@query("brand_bars", with_("brand_bars") + f"SELECT code, {sql_shown(['d'], ['o', 'h', 'l', 'c', 'v', 'amount'])} FROM brand_bars")
def brand_bars(spark, sf):
    return shown(fx.brand_bars(spark, sf), ["d"], ["o", "h", "l", "c", "v", "amount"], ["code"])


# Scopes over one signal: the bar closed above its open.
CTES["up"] = f"SELECT code, d, coalesce(c > o, false) AS s, CAST(row_number() OVER ({WIN}) AS INTEGER) AS rn FROM bars"
CTES["upruns"] = f"SELECT *, (sum(s::INT) {over(3)} = 3)::INT AS run3 FROM up"


def scoped(name: str, scope: str, n: int, sql: str, source: str = "up"):
    @query(name, with_(source) + f"SELECT code, {T('d')} AS d, {sql} AS hit FROM {source}")
    def run(spark, sf):
        df = fx.bars(spark, sf).withColumn("s", F.col("c") > F.col("o"))
        return df.select("code", day_text("d").alias("d"), scopes.scope_hit("s", scope, n).alias("hit"))


scoped("w1_scope_last", "LAST", 10, "s")
scoped("w2_scope_any", "ANY", 4, f"max(s::INT) {over(4)} = 1")
scoped("w3_scope_all", "ALL", 4, f"min(s::INT) {over(4)} = 1")
scoped("w4_scope_count", "COUNT>=3", 8, f"sum(s::INT) {over(8)} >= 3")
# The window starts at its first bar, so only runs that lie inside it count.
scoped("w5_scope_consec", "CONSEC>=3", 8, f"max(run3) {over(6)} = 1", "upruns")
scoped("w6_scope_any_n", "ANY_3", 5, f"max(s::INT) {over(5)} = 1 AND count(*) {over(5)} >= 3")
scoped("w7_scope_all_n", "ALL_3", 5, f"max(run3) {over(3)} = 1", "upruns")


def one_rule(name: str, rule: Rule, sql: str, more: str, cols):
    """A rule alone on every bar: verdict, add and what its scope reports."""
    @query(name, with_(*more.split()) + sql)
    def run(spark, sf):
        out = scoring.apply_rule(fx.bars(spark, sf), rule, fx.features)
        nullable = [F.col(c).cast("double").alias(c) if c == "lag" else c for c in cols]
        return shown(out, ["d"], ["add"], ["code", "ok", *nullable])


one_rule("w8_scope_each", Rule("each", None, 2, scope="EACH", window=6, clauses=(Clause("c > o", window=6), Clause("v > 10", window=6))),
         f"""SELECT code, {T('d')} AS d, {R('2 * n')} AS add, n > 0 AS ok, n AS cnt FROM (
SELECT code, d, CAST(sum((c > o AND v > 10)::INT) {over(6)} AS INTEGER) AS n FROM bars)""", "bars", ["cnt"])

_LAG = f"rn - max(CASE WHEN s THEN rn END) {over()}"
one_rule("w9_scope_recent", Rule("near", "c > o", scope="RECENT", bins=((0, 0, 5), (1, 2, 3), (4, 6, 1))),
         f"""SELECT code, {T('d')} AS d, ok, {R('CASE WHEN lag = 0 THEN 5 WHEN lag BETWEEN 1 AND 2 THEN 3 WHEN lag BETWEEN 4 AND 6 THEN 1 ELSE 0 END')} AS add,
CAST(lag AS DOUBLE) AS lag FROM (SELECT *, lag IS NOT NULL AS ok FROM (SELECT code, d, CASE WHEN {_LAG} < 7 THEN {_LAG} END AS lag FROM up))""",
         "up", ["lag"])


# Clauses of a recency rule: its own timeframe and window, and the first predicate.
one_rule("w9_recent_clauses", Rule("near", None, scope="RECENT", bins=((0, 0, 5), (1, 2, 3), (4, 6, 1)), clauses=(
    Clause("c > o", "W", 3), Clause("v > 10", "M", 2))),
         f"""SELECT code, {T('d')} AS d, ok, {R('CASE WHEN lag = 0 THEN 5 WHEN lag BETWEEN 1 AND 2 THEN 3 WHEN lag BETWEEN 4 AND 6 THEN 1 ELSE 0 END')} AS add,
CAST(lag AS DOUBLE) AS lag FROM (SELECT *, lag IS NOT NULL AS ok FROM (SELECT code, d, CASE WHEN {_LAG} < 7 THEN {_LAG} END AS lag FROM up))""",
         "up", ["lag"])


@query("w10_unknown_scope", with_("up") + f"SELECT code, {T('d')} AS d, max(s::INT) {over(4)} = 1 AS hit FROM up")
def w10(spark, sf):
    """A scope that is not known, from a file whose rules must not stop the run, counts as ANY."""
    df = fx.bars(spark, sf).withColumn("s", F.col("c") > F.col("o"))
    return df.select("code", day_text("d").alias("d"), scopes.scope_hit("s", scopes.scope_or_any("SOMETIMES"), 4).alias("hit"))


@query("w4_spellings", with_("upruns") + f"""
SELECT code, {T('d')} AS d, sum(s::INT) {over(8)} >= 3 AS counted, max(run3) {over(6)} = 1 AS run,
  max(s::INT) {over(5)} = 1 AND count(*) {over(5)} >= 3 AS some, max(run3) {over(3)} = 1 AS every FROM upruns""")
def w4_spellings(spark, sf):
    df = fx.bars(spark, sf).withColumn("s", F.col("c") > F.col("o"))
    hit = lambda scope, n: scopes.scope_hit("s", scope, n)
    return df.select("code", day_text("d").alias("d"), (hit("COUNT=3", 8) & hit("count ≥ 3", 8)).alias("counted"), hit("CONSEC = 3", 8).alias("run"),
                     (hit("ANY3", 5) & hit("ANY 3", 5)).alias("some"), hit("ALL-3", 5).alias("every"))


@query("w11_effective_window", with_("up") + f"""
SELECT code, {T('d')} AS d, sum(s::INT) {over(12)} >= 12 AS counted, CASE WHEN {_LAG} < 5 THEN 1 ELSE 0 END AS near, s AS last FROM up""")
def w11(spark, sf):
    """A count larger than the window widens it; recency bins set it; LAST looks at one bar."""
    df = fx.bars(spark, sf).withColumn("s", F.col("c") > F.col("o"))
    n = scopes.effective_window("RECENT", 30, ((0, 0, 1), (1, 4, 1)))
    near = scopes.bars_since("s", n).isNotNull().cast("int")
    return df.select("code", day_text("d").alias("d"), scopes.scope_hit("s", "COUNT>=12", 5).alias("counted"),
                     near.alias("near"), scopes.scope_hit("s", "LAST", 9).alias("last"))


one_rule("w12_gate", Rule("gated", "c > o", 3, window=5, scope="COUNT>=2", gate=Clause("v > 25", window=99, scope="ALL")),
         f"""SELECT code, {T('d')} AS d, ok, {R('CASE WHEN ok THEN 3 ELSE 0 END')} AS add FROM (
SELECT code, d, sum((c > o AND v > 25)::INT) {over(5)} >= 2 AS ok FROM bars)""", "bars", [])

one_rule("w12_gate_clauses", Rule("gated", None, 3, window=5, gate="v > 25", clauses=(
    Clause("c > o", window=5, scope="COUNT>=2"), Clause("c > o", window=5, scope="ANY", gate=Clause("v > 10")))),
         f"""SELECT code, {T('d')} AS d, ok, {R('CASE WHEN ok THEN 3 ELSE 0 END')} AS add FROM (
SELECT code, d, sum((c > o)::INT) {over(5)} >= 2 AND max((c > o AND v > 10)::INT) {over(5)} = 1 AND v > 25 AS ok FROM bars)""", "bars", [])

CTES["wkup"] = f"SELECT code, d, max(coalesce(c > o, false)::INT) {over(2)} = 1 AS s FROM weeks"
CTES["moup"] = "SELECT code, d, coalesce(v > 100, false) AS s FROM months"
CTES["labels"] = """
SELECT code, d, CASE WHEN dayofweek(d) = 5 THEN d ELSE d + CAST((5 - dayofweek(d) + 7) % 7 AS INTEGER) - 7 END AS w,
  CASE WHEN last_day(d) = d THEN d ELSE CAST(date_trunc('month', d) AS DATE) - 1 END AS m FROM bars"""
CTES["clauses"] = f"""
SELECT l.code, l.d, coalesce(u.day, false) AND coalesce(w.s, false) AND coalesce(m.s, false) AS ok FROM labels l
JOIN (SELECT code, d, sum(s::INT) {over(5)} >= 2 AS day FROM up) u ON u.code = l.code AND u.d = l.d
LEFT JOIN wkup w ON w.code = l.code AND w.d = l.w LEFT JOIN moup m ON m.code = l.code AND m.d = l.m"""
one_rule("w13_clauses", Rule("days_weeks_months", None, 4, clauses=(
    Clause("c > o", "D", 5, "COUNT>=2"), Clause("c > o", "W", 2, "ANY"), Clause("v > 100", "M", 1, "LAST"))),
    f"SELECT code, {T('d')} AS d, ok, {R('CASE WHEN ok THEN 4 ELSE 0 END')} AS add FROM clauses", "clauses", [])

one_rule("w14_week_rule", Rule("weekly", "c > o", 4, "W", 2, "ANY"),
         f"SELECT l.code, {T('l.d')} AS d, coalesce(w.s, false) AS ok, {R('CASE WHEN w.s THEN 4 ELSE 0 END')} AS add "
         "FROM labels l LEFT JOIN wkup w ON w.code = l.code AND w.d = l.w", "labels wkup", [])


@query("w15_hit_dates", with_("up") + f"""
SELECT code, {T('d')} AS d, array_to_string(list_transform(coalesce(list(d) FILTER (WHERE s) {over(6)}, []), lambda e: strftime(e, '%Y%m%d')), ',') AS dates,
  {T(f'max(CASE WHEN s THEN d END) {over(6)}')} AS last FROM up""")
def w15(spark, sf):
    df = fx.bars(spark, sf).withColumn("s", F.col("c") > F.col("o"))
    df = df.withColumns({"dates": scopes.hit_dates("s", 6), "last": scopes.last_hit("s", 6)})
    text = F.array_join(F.transform("dates", lambda x: F.date_format(x, "yyyyMMdd")), ",")
    return df.select("code", day_text("d").alias("d"), text.alias("dates"), day_text("last").alias("last"))


@query("w16_apply_rule", with_("hits", "lists") + f"""
SELECT code, {T('d')} AS d FROM hits WHERE r2 AND code IN (SELECT code FROM lists WHERE list = 'white')""")
def w16(spark, sf):
    b = apply_universe(fx.bars(spark, sf), "white", fx.lists(spark, sf))
    return shown(scoring.apply_rule(b, fx.RULES[2], fx.features).where("ok"), ["d"], [], ["code"])


# Stored rule records, one per rule that scored (per-bar rules: that counted).
_ANY10 = f"coalesce(list(d) FILTER (WHERE s0) {over(10)}, [])"
_EACH5 = f"coalesce(list(d) FILTER (WHERE s3) {over(5)}, [])"
CTES["dated"] = f"SELECT code, d, {_ANY10} AS l0, {_EACH5} AS l3, CASE WHEN min(d) {over(10)} = d THEN {T('d')} ELSE {T(f'min(d) {over(10)}')} || '-' || {T('d')} END AS p10 FROM sig"
_rec = "SELECT code, d, {pos} AS pos, '{name}' AS name, '{scope}' AS scope, '{tf}' AS timeframe, {windows} AS score_windows, CAST({pts} AS DOUBLE) AS points, {add} AS add, {cnt} AS cnt, {dates} AS dates FROM adds JOIN dated USING (code, d) WHERE {on}"


def _record(pos, on=None, dates="[d]", cnt="NULL::INTEGER"):
    r = fx.RULES[pos]
    return _rec.format(pos=pos, name=r.name, scope=r.scope, tf=r.timeframe, windows=scopes.effective_window(r.scope, r.window, r.bins), pts=r.points, add=f"a{pos}", cnt=cnt, dates=dates, on=on or f"a{pos} <> 0")


CTES["details"] = " UNION ALL ".join([
    _record(0, dates="l0"), _record(1), _record(2), _record(3, "n3 > 0", "l3", "n3"), _record(4), _record(5), _record(6)])
DETAIL_SQL = f"""
SELECT code, {T('d')} AS d, name, scope, points, add, CAST(cnt AS DOUBLE) AS cnt, len(dates)::INTEGER AS hit_count, {T('list_max(dates)')} AS hit_date FROM details"""


def _span(n: int) -> str:
    return f"CASE WHEN min(d) {over(n)} = d THEN {T('d')} ELSE {T(f'min(d) {over(n)}')} || '-' || {T('d')} END"


CTES["week_spans"] = f"SELECT code, d, {_span(3)} AS w3 FROM weeks"
CTES["spans"] = f"""
SELECT b.*, {T('l.w')} AS w1, s.w3 FROM (SELECT code, d, {_span(10)} AS p10, {_span(9)} AS p9, {_span(5)} AS p5 FROM bars) b
JOIN labels l ON l.code = b.code AND l.d = b.d LEFT JOIN week_spans s ON s.code = b.code AND s.d = l.w"""


@query("w17_rule_details", with_("details", "spans") + DETAIL_SQL.replace("FROM details", f""", timeframe, score_windows,
  array_to_string(list_transform(dates, lambda e: strftime(e, '%Y%m%d')), ',') AS hit_dates,
  CASE WHEN pos < 3 THEN p10 WHEN pos = 3 THEN p5 WHEN pos = 4 THEN p9 WHEN pos = 5 THEN w1 ELSE {T('d')} || coalesce(';' || w3, '') END AS period
FROM details JOIN spans USING (code, d)"""))
def w17(spark, sf):
    x = fx.details(spark, sf)
    return x.select("code", day_text("d").alias("d"), "name", "scope", "points", "add", F.col("cnt").cast("double").alias("cnt"),
                    "hit_count", day_text("hit_date").alias("hit_date"), "timeframe", "score_windows", "period",
                    F.array_join(F.transform("hit_dates", lambda e: F.date_format(e, "yyyyMMdd")), ",").alias("hit_dates"))


CTES["crash"] = f"""
SELECT code, d, max(coalesce(c < 0.2 * prev_c, false)::INT) {over(3)} = 1 AS crash,
  CASE WHEN min(d) {over(3)} = d THEN {T('d')} ELSE {T(f'min(d) {over(3)}')} || '-' || {T('d')} END AS p3 FROM feat"""
CTES["screened"] = f"""
SELECT l.code, l.d, CASE WHEN crash THEN 'fell by four fifths' WHEN m.v < 20 THEN 'thin month' END AS reason,
  CASE WHEN crash THEN p3 WHEN m.v < 20 THEN {T('m.d')} END AS period
FROM labels l JOIN crash USING (code, d) LEFT JOIN months m ON m.code = l.code AND m.d = l.m"""


@query("w18_prescreen", with_("screened") + f"SELECT code, {T('d')} AS d, reason, period FROM screened WHERE reason IS NOT NULL")
def w18(spark, sf):
    out = rl.prescreen(fx.bars(spark, sf), fx.BLACKLIST, fx.features).where(F.col("reason").isNotNull())
    return shown(out, ["d"], [], ["code", "reason", "period"])


@query("w20_score", with_("scores") + f"SELECT code, {T('d')} AS d, score, j FROM scores")
def w20(spark, sf):
    return shown(fx.scores(spark, sf), ["d"], [], ["code", "score", "j"])


@query("w20_score_prescreened", with_("scores", "screened") + f"""
SELECT s.code, {T('s.d')} AS d, s.score FROM scores s JOIN screened x ON x.code = s.code AND x.d = s.d WHERE x.reason IS NULL""")
def w20_pre(spark, sf):
    out = scoring.score(fx.bars(spark, sf), fx.RULES, fx.features, blacklist=fx.BLACKLIST, tiebreak=False)
    return shown(out, ["d"], [], ["code", "score"])


RANK_COLS = f"code, {T('d')} AS d, score, j, rank, total"


@query("w21_rank_scores", with_("ranks") + f"SELECT {RANK_COLS} FROM ranks")
def flagship(spark, sf):
    return shown(fx.ranks(spark, sf), ["d"], [], ["code", "score", "j", "rank", "total"])


@query("w21_rank_sorted", with_("ranks") + f"SELECT {RANK_COLS} FROM ranks")
def w21_sorted(spark, sf):
    """The same ranks with other steps: the result doesn't depend on how a date is cut."""
    fine = [-F.col("score"), steps(F.col("j"), 0.5)]
    out = rank_within(fx.scores(spark, sf), ["d"], scoring.rank_order(), fine, "rank", "total")
    out = out.withColumn("score", rnd("score", 3))
    return shown(out, ["d"], [], ["code", "score", "j", "rank", "total"])


@query("w22_missing_dates_ranked", with_("ranks") + f"SELECT {RANK_COLS} FROM ranks WHERE d >= DATE '2001-06-01'")
def w22(spark, sf):
    """Only dates without stored ranks are scored."""
    b = fx.bars(spark, sf)
    old = b.where(F.col("d") < F.lit("2001-06-01").cast("date"))
    todo = missing_dates(fx.calendar(b), old)
    s = scoring.score(b, fx.RULES, fx.features, dates=todo)
    return shown(scoring.rank_scores(s), ["d"], [], ["code", "score", "j", "rank", "total"])


CTES["rescored"] = """
SELECT coalesce(b.code, a.code) AS code, coalesce(b.d, a.d) AS d, greatest(coalesce(b.score, 50.0) + (a.a0 + a.a3), 0.0) AS score
FROM (SELECT code, d, CAST(v AS DOUBLE) AS score FROM bars WHERE v > 10) b FULL JOIN adds a ON a.code = b.code AND a.d = b.d"""


@query("w23_rescore", with_("rescored", "day_j") + f"""
SELECT code, {T('d')} AS d, {R('score', 3)} AS score, j, CAST(row_number() OVER (PARTITION BY d ORDER BY score DESC, j ASC NULLS LAST, code) AS INTEGER) AS rank
FROM rescored JOIN day_j USING (code, d)""")
def w23(spark, sf):
    b = fx.bars(spark, sf)
    old = b.where(F.col("v") > 10).select("code", "d", F.col("v").alias("score"), F.lit(None).cast("double").alias("j"))
    chosen = [fx.RULES[0], fx.RULES[3]]
    out = scoring.rescore(old, b, chosen, lambda df: with_indicators(fx.features(df), ["kdj"]))
    return shown(out, ["d"], [], ["code", "score", "j", "rank"])


CTES["picked"] = """
SELECT h.code, h.d, p.score, p.j, CAST(row_number() OVER (PARTITION BY h.d ORDER BY p.score DESC NULLS LAST, p.j NULLS LAST, h.code) AS INTEGER) AS rank
FROM hits h LEFT JOIN (SELECT * FROM plain_ranks WHERE rank <= 15) p ON p.code = h.code AND p.d = h.d
WHERE h.r1 AND h.code IN (SELECT code FROM lists WHERE list = 'white')"""


@query("w24_screen", with_("picked") + f"SELECT code, {T('d')} AS d, score, j, rank FROM picked")
def w24(spark, sf):
    ranks = plain_ranks(spark, sf).where(F.col("rank") <= 15)
    white = fx.lists(spark, sf).where(F.col("list") == "white")
    out = scoring.screen(fx.bars(spark, sf), fx.RULES[1], ranks, fx.features, universe=white)
    return shown(out, ["d"], [], ["code", "score", "j", "rank"])


@query("w24_screen_ref", with_("picked") + f"SELECT code, {T('d')} AS d, score, j, rank FROM picked WHERE d = DATE '2000-05-17'")
def w24_ref(spark, sf):
    """The screen of one date, from the bars that can matter for it."""
    ranks = plain_ranks(spark, sf).where(F.col("rank") <= 15)
    white = fx.lists(spark, sf).where(F.col("list") == "white")
    out = scoring.screen(fx.bars(spark, sf), fx.RULES[1], ranks, fx.features, "2000-05-17", white)
    return shown(out, ["d"], [], ["code", "score", "j", "rank"])


_SCREEN = f"D10:COUNT>=3::{fx.RULES[1].when}".replace("'", "''")


@query("w24_screen_lists", with_("hits", "screened") + f"""
SELECT h.code, {T('h.d')} AS d, CASE WHEN h.r1 AND x.reason IS NULL THEN 'white' ELSE 'black' END AS list, coalesce(x.period, {T('h.d')}) AS period,
  CASE WHEN h.r1 AND x.reason IS NULL THEN 'screen:{_SCREEN}' ELSE coalesce(x.reason, 'screen_fail:{_SCREEN}') END AS reason
FROM hits h JOIN screened x ON x.code = h.code AND x.d = h.d""")
def w24_lists(spark, sf):
    out = scoring.screen_lists(fx.bars(spark, sf), fx.RULES[1], fx.features, fx.BLACKLIST)
    return shown(out, ["d"], [], ["code", "list", "period", "reason"])


@query("w35_top_scores", with_("ranks") + f"SELECT {RANK_COLS} FROM ranks WHERE d = DATE '1999-03-10' ORDER BY rank LIMIT 10")
def w35(spark, sf):
    r = scoring.rank_scores(scoring.score(fx.bars(spark, sf), fx.RULES, fx.features, dates=["1999-03-10"]))
    return shown(r.orderBy("rank").limit(10), ["d"], [], ["code", "score", "j", "rank", "total"])


@query("a11_sum_scores", with_("details") + f"SELECT code, {T('d')} AS d, greatest(50.0 + sum(add), 0.0)::DOUBLE AS score FROM details GROUP BY code, d")
def a11(spark, sf):
    return shown(scoring.sum_scores(fx.details(spark, sf)), ["d"], [], ["code", "score"])


_high = [(0, "short average crossed the long one"), (3, "busy bars"), (4, "recent peak"), (5, "last week rose"), (6, "day and week agree")]


@query("a12_reasons", with_("adds") + f"""
SELECT code, {T('d')} AS d, concat_ws(';', {', '.join(f"CASE WHEN a{i} <> 0 THEN '{t}' END" for i, t in _high)}) AS highlights,
  CASE WHEN a1 <> 0 THEN 'often below the long average' ELSE '' END AS drawbacks,
  CASE WHEN a2 <> 0 THEN 'rose three bars in a row' ELSE '' END AS opportunities FROM adds""")
def a12(spark, sf):
    x = scoring.reasons(rl.evaluate(fx.bars(spark, sf), fx.RULES, fx.features), fx.RULES)
    return x.select("code", day_text("d").alias("d"),
                    *[F.array_join(n, ";").alias(n) for n in ("highlights", "drawbacks", "opportunities")])


@query("f9_f10_rules_json", with_("details") + f"""
SELECT code, {T('d')} AS d, name, points, add, len(dates)::INTEGER AS hit_count, {T('list_max(dates)')} AS hit_date FROM details""")
def f9(spark, sf):
    """Records to JSON text and back."""
    x = research.parse_rules(research.to_rules_json(fx.details(spark, sf)))
    return x.select("code", day_text("d").alias("d"), "name", "points", "add", "hit_count", "hit_date")


@query("f15_trigger_dates", with_("details") + f"""
SELECT code, n, first, last FROM (SELECT code, count(DISTINCT x) AS n, {T('min(x)')} AS first, {T('max(x)')} AS last FROM (
SELECT code, unnest(dates) AS x FROM details WHERE pos = 0) GROUP BY code)""")
def f15(spark, sf):
    x = trigger_span(fx.details(spark, sf).where(F.col("name") == "golden"), ["code"])
    return x.select("code", "n", day_text("first").alias("first"), day_text("last").alias("last"))


@query("j4_attach_scores", with_("hits", "plain_ranks") + f"""
SELECT h.code, {T('h.d')} AS d, p.score, p.j FROM hits h LEFT JOIN (SELECT * FROM plain_ranks WHERE rank <= 3) p ON p.code = h.code AND p.d = h.d WHERE h.r0""")
def j4(spark, sf):
    hits = scoring.apply_rule(fx.bars(spark, sf), fx.RULES[0], fx.features).where("ok")
    out = scoring.attach_scores(hits, plain_ranks(spark, sf).where(F.col("rank") <= 3))
    return shown(out, ["d"], [], ["code", "score", "j"])
