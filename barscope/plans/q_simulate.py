"""Simulated bars, reverse prices, predictions and positions (X group, W36, W37, A13, J13, F14)."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import functions as F

from barscope.functions import series as ts
from barscope.functions.values import day_text, scenario_id
from barscope.operators import simulate as sim
from barscope.operators import solver
from barscope.operators.clean import last_bars
from barscope.operators.indicators import with_indicators
from barscope.operators.simulate import Scenario
from barscope.plans import fixtures as fx
from barscope.plans.q_series import cents
from barscope.plans.q_sources import BARS_SQL, bars_out, plain_ranks
from barscope.plans.registry import CTES, R, T, WIN, ewm_sql, out_num, over, query, shown, sql_shown, strict, with_

CTES["final"] = "SELECT code, max(d) AS d, arg_max(o, d) AS o, arg_max(h, d) AS h, arg_max(l, d) AS l, arg_max(c, d) AS c, arg_max(v, d) AS v, arg_max(amount, d) AS amount FROM bars GROUP BY code"
CTES["simday"] = "SELECT max(d) + 1 AS d FROM bars"


@query("a13_last_bars", with_("final") + f"SELECT {BARS_SQL} FROM final")
def a13(spark, sf):
    return bars_out(last_bars(fx.bars(spark, sf)))


_follow = (
    "greatest(c, o) + CASE WHEN h > greatest(c, o) THEN h - greatest(c, o) ELSE 0.001 END",
    "least(c, o) - CASE WHEN l < least(c, o) THEN least(c, o) - l ELSE 0.001 END",
)
_atr = ("(c + o) / 2.0 + (h - l) * 1.5 / 2.0", "(c + o) / 2.0 - (h - l) * 1.5 / 2.0")
_range = ("(c + o) / 2.0 + greatest(c, o) * (3.0 / 100.0) / 2.0", "(c + o) / 2.0 - greatest(c, o) * (3.0 / 100.0) / 2.0")

# name: scenario, SQL of the new open, close, high, low, volume
CASES = {
    "flat": (Scenario("flat"), "c", "c", *_follow, "v"),
    "close": (Scenario("close_pct", 2.5, vol_mode="pct", vol_arg=10.0), "c", "c * (1.0 + 2.5 / 100.0)", *_follow, "v * (1.0 + 10.0 / 100.0)"),
    "open": (Scenario("open_pct", 3.0, hl_mode="atr_like", atr_mult=1.5), "c * (1.0 + 3.0 / 100.0)", "c", *_atr, "v"),
    "gap": (Scenario("gap_then_close_pct", -1.0, 2.0, hl_mode="range_pct", range_pct=3.0, vol_mode="mult", vol_arg=1.2),
            "c * (1.0 + 2.0 / 100.0)", "c * (1.0 + 2.0 / 100.0) * (1.0 + -1.0 / 100.0)", *_range, "v * 1.2"),
    "up": (Scenario("limit_up", vol_mode="mult"), "c * (1.0 + 9.9 / 100.0)", "c * (1.0 + 9.9 / 100.0)", *_follow, "v"),
    "down": (Scenario("limit_down", vol_mode="pct", vol_arg=-150.0), "c * (1.0 + -9.9 / 100.0)", "c * (1.0 + -9.9 / 100.0)", *_follow, "greatest(v * (1.0 + -150.0 / 100.0), 0.0)"),
}
_rows = " UNION ALL ".join(
    f"SELECT '{n}' AS kind, code, {o} AS o, {c} AS c, {h} AS h, {low} AS l, {v} AS v FROM final" for n, (_, o, c, h, low, v) in CASES.items())
SIM = ["o", "h", "l", "c", "v"]


@query("x1_scenarios", with_("final", "simday") + f"SELECT kind, code, {T('(SELECT d FROM simday)')} AS d, {', '.join(f'{R(n, 4)} AS {n}' for n in SIM)} FROM ({_rows})".replace("1.0 + ", "1.0::DOUBLE + "))
def x1(spark, sf):
    out = sim.scenario_bars(fx.bars(spark, sf), {name: scenario for name, (scenario, *_) in CASES.items()})
    return shown(out.withColumnRenamed("scenario", "kind"), ["d"], SIM, ["kind", "code"], 4)


@query("x2_locked_range", with_("final", "simday") + f"""
SELECT code, {R('o', 4)} AS o, {R('c', 4)} AS c, {R('greatest(h, o, c)', 4)} AS h, {R('least(l, o, c)', 4)} AS l FROM (
SELECT code, o2 AS o, greatest(c2, o2) AS c, h2 AS h, l2 AS l FROM (SELECT code, c * (1.0::DOUBLE + 12.0 / 100.0) AS o2, c AS c2,
  {_range[0]} AS h2, {_range[1]} AS l2 FROM final))""")
def x2(spark, sf):
    s = Scenario("open_pct", 12.0, hl_mode="range_pct", range_pct=-3.0, lock_inside_day=True, lock_higher_than_open=True)
    return shown(sim.next_bars(fx.bars(spark, sf), s), [], ["o", "c", "h", "l"], ["code"], 4)


CTES["override"] = f"SELECT {fx.CODE.format('s_suppkey')} AS code, CASE WHEN s_suppkey % 3 = 0 THEN 5.0::DOUBLE END AS pct, CASE WHEN s_suppkey % 3 = 1 THEN 'flat' END AS mode FROM supplier WHERE s_suppkey % 3 < 2"


@query("x4_overrides", with_("final", "override") + f"""
SELECT f.code, {R("CASE WHEN x.mode = 'flat' THEN f.c ELSE f.c * (1.0::DOUBLE + coalesce(x.pct, -2.0) / 100.0) END", 4)} AS c
FROM final f LEFT JOIN override x ON x.code = f.code""")
def x4(spark, sf):
    k = F.col("s_suppkey") % 3
    given = fx.load(spark, sf, "supplier").where(k < 2).select(
        fx.code_of("s_suppkey").alias("code"), F.when(k == 0, F.lit(5.0)).alias("pct"), F.when(k == 1, F.lit("flat")).alias("mode"))
    return shown(sim.next_bars(fx.bars(spark, sf), Scenario("close_pct", -2.0), given), [], ["c"], ["code"], 4)


CTES["own_target"] = f"""
SELECT {fx.CODE.format('s_suppkey')} AS code, s_suppkey % 4 AS k FROM supplier WHERE s_suppkey % 4 < 3"""


# History and simulated bar together, prices in cents.
CTES["cfinal"] = "SELECT code, arg_max(o, d) AS o, arg_max(h, d) AS h, arg_max(l, d) AS l, arg_max(c, d) AS c, arg_max(v, d) AS v FROM cents GROUP BY code"
CTES["longer"] = f"""
SELECT code, d, o, h, l, c, v, false AS sim FROM cents UNION ALL
SELECT code, (SELECT d FROM simday), c, {_follow[0]}, {_follow[1]}, c * (1.0::DOUBLE + 2.0 / 100.0), v, true FROM cfinal"""
CTES["longer_n"] = f"SELECT *, row_number() OVER ({WIN}) AS rn FROM longer"


@query("x5_simulate_indicators", with_("longer_n", "simday") + f"""
SELECT code, {T('d')} AS d, CASE WHEN rn > 20 THEN {R('vr', 4)} END AS vr, CASE WHEN rn > 24 THEN {R('bbi', 2)} END AS bbi FROM (
SELECT *, v / ({strict('avg', 'v', 20)} + 1e-12) AS vr,
  ({strict('avg', 'c', 3)} + {strict('avg', 'c', 6)} + {strict('avg', 'c', 12)} + {strict('avg', 'c', 24)}) / 4 AS bbi FROM longer_n)""")
def x5(spark, sf):
    df = sim.simulate_next(cents(spark, sf), Scenario("close_pct", 2.0), indicators=["volume_ratio", "bbi"])
    return shown(df, ["d"], [], ["code", "vr", "bbi"])


@query("x8_eval_on_date", with_("longer", "simday") + f"""
SELECT code, {T('d')} AS d, c > m AS above, c > pc AS rose FROM (
SELECT *, {strict('avg', 'c', 5)} AS m, lag(c) OVER ({WIN}) AS pc FROM longer) WHERE sim""")
def x8(spark, sf):
    df = sim.simulate_next(cents(spark, sf), Scenario("close_pct", 2.0))
    df = df.withColumns({"m": ts.ma("c", 5), "pc": ts.ref("c", 1)})
    return shown(sim.eval_on_date(df, {"above": "c > m", "rose": "c > pc"}), ["d"], [], ["code", "above", "rose"])


# Reverse prices: bbi on a grid, diff by bisection; SQL repeats the search.
CTES["tailed"] = f"SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS back FROM cents"
CTES["bbi_state"] = """
SELECT code, max(d) AS d, arg_max(c, d) AS c, CASE WHEN count(*) >= 23 THEN sum(c) FILTER (WHERE back <= 2) END AS s3,
  sum(c) FILTER (WHERE back <= 5) AS s6, sum(c) FILTER (WHERE back <= 11) AS s12, sum(c) FILTER (WHERE back <= 23) AS s24 FROM tailed GROUP BY code"""
CTES["tried"] = """
SELECT code, d, c, i, x, ((s3 + x) / 3 + (s6 + x) / 6 + (s12 + x) / 12 + (s24 + x) / 24) / 4 AS value FROM (
SELECT *, greatest(c * 0.5, c - c * 0.2) + i * ((least(c * 2.0, c + c * 0.2) - greatest(c * 0.5, c - c * 0.2)) / 49) AS x
FROM bbi_state CROSS JOIN range(50) t(i) WHERE s3 IS NOT NULL)"""


@query("x6_reverse_grid", with_("tried") + f"""
SELECT code, {T('max(d)')} AS d, {R("arg_min(x, {'e': abs(value - 250000.0), 'i': i})", 3)} AS price, {R("arg_min(value, {'e': abs(value - 250000.0), 'i': i})", 3)} AS value
FROM tried GROUP BY code""")
def x6(spark, sf):
    out = solver.reverse_price_grid(cents(spark, sf), "bbi", 250000.0)
    return shown(out, ["d"], ["price", "value"], ["code"], 3)


CTES["diff_state"] = "SELECT code, arg_max(d, rn) AS d, arg_max(c, rn) AS c, arg_max(e12, rn) AS e12, arg_max(e26, rn) AS e26 FROM e26 GROUP BY code"


@query("x7_reverse_bisect", "WITH RECURSIVE " + with_("diff_state")[5:] + f""",
steps AS (SELECT code, d, c, e12, e26, c * 0.5 AS lo, c * 2.0 AS hi, 0 AS n FROM diff_state UNION ALL
SELECT code, d, c, e12, e26, CASE WHEN hi - lo > 1e-6 AND f < 500.0 THEN mid ELSE lo END, CASE WHEN hi - lo > 1e-6 AND f >= 500.0 THEN mid ELSE hi END, n + 1
FROM (SELECT *, (lo + hi) / 2 AS mid, ((1 - 2.0::DOUBLE / 13) * e12 + 2.0::DOUBLE / 13 * ((lo + hi) / 2)) - ((1 - 2.0::DOUBLE / 27) * e26 + 2.0::DOUBLE / 27 * ((lo + hi) / 2)) AS f FROM steps) WHERE n < 60)
SELECT code, {T('d')} AS d, {R('(lo + hi) / 2', 1)} AS price FROM steps WHERE n = 60""")
def x7(spark, sf):
    return shown(solver.reverse_price_bisect(cents(spark, sf), "diff", 500.0), ["d"], ["price"], ["code"], 1)


def bisected(state: str, target: float, tolerance: float, out: str) -> str:
    """Recursive part that halves the bounds of the close until they are as near as asked, for the difference of two averages."""
    mid = "((1 - 2.0::DOUBLE / 13) * e12 + 2.0::DOUBLE / 13 * ((lo + hi) / 2)) - ((1 - 2.0::DOUBLE / 27) * e26 + 2.0::DOUBLE / 27 * ((lo + hi) / 2))"
    return f"""{out} AS (SELECT *, c * 0.5 AS lo, c * 2.0 AS hi, 0 AS n FROM {state} UNION ALL
SELECT * EXCLUDE (mid, f, lo, hi, n), CASE WHEN hi - lo > {tolerance} AND f < {target} THEN mid ELSE lo END AS lo, CASE WHEN hi - lo > {tolerance} AND f >= {target} THEN mid ELSE hi END AS hi, n + 1 AS n
FROM (SELECT *, (lo + hi) / 2 AS mid, {mid} AS f FROM {out}) WHERE n < 60)"""


CTES["own_n"] = f"SELECT *, row_number() OVER ({WIN}) AS rn FROM bars"
CTES["own12"] = ewm_sql("c", 2 / 13, False, "own_n", "e12")
CTES["own26"] = ewm_sql("c", 2 / 27, False, "own12", "e26")
CTES["own_state"] = f"SELECT * FROM own26 QUALIFY row_number() OVER (PARTITION BY code ORDER BY d DESC) = 1"
_AT = "(1 - 2.0::DOUBLE / 13) * e12 + 2.0::DOUBLE / 13 * p - ((1 - 2.0::DOUBLE / 27) * e26 + 2.0::DOUBLE / 27 * p)"


@query("x6_reverse_scenario", "WITH RECURSIVE " + with_("own_state", "simday")[5:] + ", " + bisected("own_state", 0.0, 1e-3, "steps") + f"""
SELECT code, {T('(SELECT d FROM simday)')} AS d, {R('CASE WHEN ok THEN o * p / c ELSE c END', 2)} AS o, {R('CASE WHEN ok THEN h * p / c ELSE ' + _follow[0] + ' END', 2)} AS h,
  {R('CASE WHEN ok THEN l * p / c ELSE ' + _follow[1] + ' END', 2)} AS l, {R('CASE WHEN ok THEN p ELSE c END', 2)} AS c, {R('v', 2)} AS v
FROM (SELECT *, coalesce(abs({_AT}) < 1e-3, false) AS ok FROM (SELECT *, (lo + hi) / 2 AS p FROM steps WHERE n = 60))""")
def x6_scenario(spark, sf):
    """Simulated bars whose close comes from the solver."""
    s = Scenario("reverse_indicator", reverse_indicator="diff", reverse_target_value=0.0, reverse_method="bisect", reverse_tolerance=1e-3)
    return shown(sim.next_bars(fx.bars(spark, sf), s), ["d"], SIM, ["code"], 2)


@query("x4_reverse_overrides", "WITH RECURSIVE " + with_("tried", "diff_state", "cfinal", "own_target")[5:] + ", " + bisected("diff_state", 500.0, 1e-6, "steps") + f"""
SELECT f.code, {R(f"CASE k WHEN 0 THEN x WHEN 1 THEN CASE WHEN abs({_AT} - 500.0) < 1e-6 THEN p ELSE f.c END WHEN 2 THEN f.c ELSE f.c * (1.0::DOUBLE + -2.0 / 100.0) END", 1)} AS c
FROM cfinal f LEFT JOIN own_target t ON t.code = f.code LEFT JOIN (SELECT *, (lo + hi) / 2 AS p FROM steps WHERE n = 60) s ON s.code = f.code
LEFT JOIN (SELECT code, arg_min(x, {{'e': abs(value - 250000.0), 'i': i}}) AS x FROM tried GROUP BY code) g ON g.code = f.code""")
def x4_reverse(spark, sf):
    """Symbols that solve for different indicators, by different methods, in one call; one that asks for an unknown one stays flat."""
    k = F.col("s_suppkey") % 4
    pick = lambda a, b, c: F.when(k == 0, F.lit(a)).when(k == 1, F.lit(b)).when(k == 2, F.lit(c))
    given = fx.load(spark, sf, "supplier").where(k < 3).select(
        fx.code_of("s_suppkey").alias("code"), F.lit("reverse_indicator").alias("mode"), pick("bbi", "diff", "nothing").alias("reverse_indicator"),
        pick(250000.0, 500.0, 1.0).alias("reverse_target_value"), pick("grid", "bisect", None).alias("reverse_method"),
        pick(1e12, 1e-6, 1.0).alias("reverse_tolerance"))
    out = sim.next_bars(cents(spark, sf), Scenario("close_pct", -2.0), given)
    return shown(out, [], ["c"], ["code"], 1)


@query("j13_candidate_prices", with_("final") + f"""
SELECT code, i, {R('x', 4)} AS x FROM (SELECT code, i, greatest(c * 0.5, c - c * 0.2) + i * ((least(c * 2.0, c + c * 0.2) - greatest(c * 0.5, c - c * 0.2)) / 49) AS x
FROM final CROSS JOIN range(50) t(i))""")
def j13(spark, sf):
    df = last_bars(fx.bars(spark, sf)).select("code", F.posexplode(solver.candidate_prices("c")).alias("i", "x"))
    return df.select("code", F.col("i").cast("bigint").alias("i"), out_num("x", 4).alias("x"))


# Predictions: checks under their own scenarios, with the scores of today.
GAIN, DROP = Scenario("close_pct", 5.0), Scenario("close_pct", -5.0, vol_mode="mult", vol_arg=2.0)
CHECKS = (("breaks_up", "c > ma5", GAIN), ("new_top", "c >= top20", GAIN), ("breaks_down", "c < ma5", DROP))


def _sim_sql(pct: str, vol: str) -> str:
    return f"""SELECT code, d, o, h, l, c, v, false AS sim FROM bars UNION ALL
SELECT code, (SELECT d FROM simday), c, {_follow[0]}, {_follow[1]}, c * (1.0::DOUBLE + {pct} / 100.0), {vol}, true FROM final"""


CTES["gain"], CTES["loss"] = _sim_sql("5.0", "v"), _sim_sql("-5.0", "v * 2.0")
CTES["gain_f"], CTES["loss_f"] = fx.feat_sql("gain"), fx.feat_sql("loss")
fx.kdj_sql("gain", "gk")
fx.kdj_sql("loss", "lk")
CTES["predicted"] = f"""
SELECT code, d, 'breaks_up' AS rule_name, '{scenario_id(asdict(GAIN))}' AS scenario_id FROM gain_f WHERE sim AND c > ma5 UNION ALL
SELECT code, d, 'new_top', '{scenario_id(asdict(GAIN))}' FROM gain_f WHERE sim AND c >= top20 UNION ALL
SELECT code, d, 'breaks_down', '{scenario_id(asdict(DROP))}' FROM loss_f WHERE sim AND c < ma5"""
CTES["sim_j"] = f"""
SELECT code, d, j, '{scenario_id(asdict(GAIN))}' AS scenario_id FROM gk_j UNION ALL SELECT code, d, j, '{scenario_id(asdict(DROP))}' FROM lk_j"""


@query("x9_run_prediction", with_("predicted", "sim_j", "plain_ranks", "simday") + f"""
SELECT p.code, p.rule_name, p.scenario_id, {T('p.d')} AS sim_date, {T('p.d - 1')} AS ref_date, k.j, r.score, r.j AS tiebreak_j, CAST(r.rank AS DOUBLE) AS rank
FROM predicted p JOIN sim_j k USING (code, d, scenario_id) LEFT JOIN plain_ranks r ON r.code = p.code AND r.d = p.d - 1""")
def x9(spark, sf):
    out = sim.run_prediction(fx.bars(spark, sf), CHECKS, plain_ranks(spark, sf), fx.features)
    return out.select("code", "rule_name", "scenario_id", day_text("sim_date").alias("sim_date"), day_text("ref_date").alias("ref_date"),
                      "j", "score", "tiebreak_j", F.col("rank").cast("double").alias("rank"))


@query("f14_scenario_id", f"""
SELECT {fx.CODE.format('s_suppkey')} AS code, substr(md5('{{"atr_mult":1.0,"gap_pct":0.0,"hl_mode":"follow","limit_dn_pct":-9.9,"limit_up_pct":9.9,"lock_higher_than_open":false,'
  || '"lock_inside_day":false,"mode":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'flat' ELSE 'close_pct' END || '","pct":' || CAST(s_suppkey % 5 AS VARCHAR)
  || '.0,"range_pct":1.5,"reverse_indicator":"","reverse_method":"grid","reverse_target_value":0.0,"reverse_tolerance":1e-06,"vol_arg":0.0,"vol_mode":"same"}}'), 1, 12) AS id
FROM supplier""")
def f14(spark, sf):
    """The id names the parameters, not the order they are given in; each supplier has its own scenario."""
    k, ids = F.col("s_suppkey"), F.lit(None).cast("string")
    for mode in ("flat", "close_pct"):
        for pct in range(5):
            shuffled = dict(reversed(asdict(Scenario(mode, float(pct))).items()))
            this = ((k % 2 == 0) == (mode == "flat")) & (k % 5 == pct)
            ids = F.when(this, F.lit(scenario_id(shuffled))).otherwise(ids)
    return fx.load(spark, sf, "supplier").select(fx.code_of("s_suppkey").alias("code"), ids.alias("id"))


MORE_CHECKS = (("all", None, GAIN), ("level", "C > O", Scenario("open_pct", 0.0)))


@query("x9_unconditional", with_("simday", "final") + f"""
SELECT code, rule_name, {T('(SELECT d FROM simday)')} AS sim_date FROM final, (SELECT unnest(['all', 'level']) AS rule_name)""")
def x9_all(spark, sf):
    """A check that is missing holds for every code; an open equal to the close counts as a rise where the scenario sets the open."""
    out = sim.run_prediction(fx.bars(spark, sf), MORE_CHECKS, plain_ranks(spark, sf), fx.features)
    return shown(out, ["sim_date"], [], ["code", "rule_name"])


PRED_RULES = (fx.RULES[1], fx.RULES[2], fx.RULES[4])
CTES["gain_s"] = f"""
SELECT *, CAST(row_number() OVER ({WIN}) AS INTEGER) AS rn, coalesce(c < ma20, false) AS s1, coalesce(c > prev_c, false) AS s2, coalesce(c >= top20, false) AS s4 FROM gain_f"""
CTES["gain_r"] = f"SELECT *, (sum(s2::INT) {over(3)} = 3)::INT AS run3 FROM gain_s"
CTES["gain_h"] = f"""
SELECT code, d, sim, sum(s1::INT) {over(10)} >= 3 AS r1, max(run3) {over(8)} = 1 AS r2, rn - max(CASE WHEN s4 THEN rn END) {over()} AS lag4 FROM gain_r"""
CTES["gain_score"] = """
SELECT h.code, h.d, k.j, greatest(50.0 + CASE WHEN r1 THEN -5.0 ELSE 0.0 END + CASE WHEN r2 THEN 4.0 ELSE 0.0 END
  + CASE WHEN lag4 = 0 THEN 6.0 WHEN lag4 BETWEEN 1 AND 3 THEN 3.0 WHEN lag4 BETWEEN 4 AND 8 THEN 1.0 ELSE 0.0 END, 0.0)::DOUBLE AS score
FROM gain_h h JOIN gk_j k USING (code, d) WHERE h.sim"""


@query("x10_predict_ranking", with_("gain_score", "simday") + f"""
SELECT code, {T('d')} AS d, score, j, CAST(row_number() OVER (ORDER BY score DESC, j NULLS LAST, code) AS INTEGER) AS rank, count(*) OVER () AS total FROM gain_score""")
def x10(spark, sf):
    out = sim.predict_ranking(fx.bars(spark, sf), GAIN, PRED_RULES, fx.features)
    return shown(out, ["d"], [], ["code", "score", "j", "rank", "total"])


@query("x11_last_j", with_("day_j") + "SELECT code, j FROM day_j WHERE d = DATE '1999-03-10'")
def x11(spark, sf):
    return sim.last_j(fx.bars(spark, sf), "1999-03-10")


# Positions opened at every 50th bar's close; policies on the last bar.
CTES["positions"] = f"SELECT code, d AS entry_date, c AS entry_price FROM (SELECT *, row_number() OVER ({WIN}) AS rn FROM bars) WHERE rn % 50 = 0"


def positions(b):
    return b.withColumn("_n", ts.bar_no()).where(F.col("_n") % 50 == 0).select("code", F.col("d").alias("entry_date"), F.col("c").alias("entry_price"))


POLICIES = (("take", "unreal_pnl > 0.3", "gain taken"), ("stop", "unreal_pnl < -0.1 or c < ma20", "loss cut"))


@query("w36_position_checks", with_("positions", "feat") + f"""
SELECT code, {T('entry_date')} AS entry_date, {R('pnl', 4)} AS unreal_pnl, {T('d')} AS ref_date, name, hit FROM (
SELECT p.*, f.d, (f.c - entry_price) / entry_price AS pnl, f.c, f.ma20 FROM positions p JOIN (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY code ORDER BY d DESC) = 1) f USING (code)) x
CROSS JOIN LATERAL (SELECT 'take' AS name, pnl > 0.3 AS hit UNION ALL SELECT 'stop', coalesce(pnl < -0.1 OR c < ma20, false)) y""")
def w36(spark, sf):
    b = fx.bars(spark, sf)
    out = sim.position_checks(fx.features(b), positions(b), POLICIES)
    return shown(out, ["entry_date", "ref_date"], [], ["code", out_num("unreal_pnl", 4).alias("unreal_pnl"), "name", "hit"])


@query("w36_position_scenario", with_("positions", "gain_f", "simday") + f"""
SELECT code, {T('entry_date')} AS entry_date, {R('pnl', 4)} AS unreal_pnl, {T('d - 1')} AS ref_date, {T('d')} AS sim_date, name, hit FROM (
SELECT p.*, f.d, (f.c - entry_price) / entry_price AS pnl, f.c, f.ma20 FROM positions p JOIN (SELECT * FROM gain_f WHERE sim) f USING (code)) x
CROSS JOIN LATERAL (SELECT 'take' AS name, pnl > 0.3 AS hit UNION ALL SELECT 'stop', coalesce(pnl < -0.1 OR c < ma20, false)
  UNION ALL SELECT 'lots', entry_price * 3 > c) y""")
def w36_scenario(spark, sf):
    """Positions under a scenario, with a variable of their own."""
    b = fx.bars(spark, sf)
    own = positions(b).withColumn("lots", F.lit(3))
    more = (*POLICIES, ("lots", "entry_price * lots > c", "large"))
    out = sim.position_checks(b, own, more, scenario=GAIN, features=fx.features)
    return shown(out, ["entry_date", "ref_date", "sim_date"], [], ["code", out_num("unreal_pnl", 4).alias("unreal_pnl"), "name", "hit"])


@query("w37_opportunity_prices", with_("holes") + f"""
SELECT code, {R('entry', 4)} AS entry, {R('tip', 4)} AS tip, c < entry AS below, c > tip AS above FROM (
SELECT code, d, c, last_value(CASE WHEN x > o THEN h END IGNORE NULLS) OVER ({WIN} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS entry,
  max(c) OVER ({WIN} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS tip FROM holes)
QUALIFY row_number() OVER (PARTITION BY code ORDER BY d DESC) = 1""")
def w37(spark, sf):
    """Entry prices from the price lookups, compared with the last close."""
    b = fx.bars(spark, sf).withColumn("x", F.when(F.col("v") <= 40, F.col("c")))
    b = b.withColumns({"entry": ts.get_last(F.col("x") > F.col("o"), "h", 20), "tip": F.max("c").over(ts.before(20))})
    out = last_bars(b.select("code", "d", "c", "entry", "tip"))
    return shown(out, [], ["entry", "tip"], ["code", (F.col("c") < F.col("entry")).alias("below"), (F.col("c") > F.col("tip")).alias("above")], 4)
