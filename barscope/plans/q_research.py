"""Rule hits against forward returns (M group, A9, A10, J7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barscope.functions.values import day_text
from barscope.operators import clean, research
from barscope.plans import fixtures as fx
from barscope.plans import q_rules  # noqa: F401  (defines the SQL of stored records)
from barscope.plans.registry import CTES, R, T, WIN, out_num, query, shown, with_
from barscope.session import written_once

NAMES = [r.name for r in fx.RULES]


@query("m1_rule_hits", with_("details") + f"SELECT name AS rule, code, {T('d')} AS d, add FROM details")
def m1(spark, sf):
    return shown(research.rule_hits(fx.details(spark, sf)), ["d"], [], ["rule", "code", "add"])


_rets = ", ".join(f"lead(c, {h}) OVER ({WIN}) / nullif(c, 0) - 1 AS ret_{h}d" for h in (1, 5, 10))
CTES["fwd"] = f"SELECT code, d, {_rets} FROM bars"


@query("m2_forward_returns", with_("fwd") + f"SELECT code, {T('d')} AS d, {', '.join(f'{R(f'ret_{h}d', 4)} AS ret_{h}d' for h in (1, 5, 10))} FROM fwd")
def m2(spark, sf):
    out = research.forward_returns(fx.bars(spark, sf), [1, 5, 10])
    return shown(out, ["d"], ["ret_1d", "ret_5d", "ret_10d"], ["code"], 4)


@query("m2_log_returns", with_("fwd") + f"SELECT code, {T('d')} AS d, {R('ln(ret_5d + 1)', 4)} AS ret_5d FROM fwd")
def m2_log(spark, sf):
    return shown(research.forward_returns(fx.bars(spark, sf), [5], log=True), ["d"], ["ret_5d"], ["code"], 4)


@query("j7_hits_prices", with_("details", "fwd") + f"""
SELECT x.code, {T('x.d')} AS d, x.name AS rule, x.add, {R('f.ret_5d', 4)} AS ret_5d FROM details x JOIN fwd f ON f.code = x.code AND f.d = x.d""")
def j7(spark, sf):
    hits = research.rule_hits(fx.details(spark, sf))
    out = clean.join_hits_prices(hits, research.forward_returns(fx.bars(spark, sf), [5]))
    return shown(out, ["d"], [], ["code", "rule", "add", out_num("ret_5d", 4).alias("ret_5d")])


CTES["often"] = "SELECT name FROM details GROUP BY name HAVING count(*) >= 20000"


@query("a9_keep_frequent", with_("details", "often") + f"SELECT name AS rule, code, {T('d')} AS d, add FROM details WHERE name IN (SELECT name FROM often)")
def a9(spark, sf):
    return shown(research.keep_frequent(research.rule_hits(fx.details(spark, sf)), 20000), ["d"], [], ["rule", "code", "add"])


_pivot = ", ".join(f"coalesce(sum(add) FILTER (WHERE name = '{n}'), 0)::DOUBLE AS {n}" for n in NAMES)
CTES["wide"] = f"SELECT code, d, {_pivot} FROM details GROUP BY code, d"


@query("a10_rule_features", with_("wide") + f"SELECT code, {T('d')} AS d, {', '.join(NAMES)} FROM wide")
def a10(spark, sf):
    out = research.rule_features(research.rule_hits(fx.details(spark, sf)), NAMES)
    return shown(out, ["d"], [], ["code", *NAMES])


CTES["kept_rules"] = "SELECT name FROM details GROUP BY name HAVING count(*) >= 5000"
CTES["wide_kept"] = f"SELECT code, d, {_pivot} FROM details WHERE name IN (SELECT name FROM kept_rules) GROUP BY code, d"
CTES["dataset"] = "SELECT w.*, f.ret_5d AS target FROM wide_kept w JOIN fwd f ON f.code = w.code AND f.d = w.d WHERE f.ret_5d IS NOT NULL"
_DATASET_SQL = with_("dataset") + f"SELECT code, {T('d')} AS d, {', '.join(NAMES)}, {R('target', 4)} AS target FROM dataset"


def dataset(spark, sf):
    return research.rule_dataset_in_row(fx.bars(spark, sf), fx.RULES, fx.features, 5, min_hits=5000)


def shown_dataset(df):
    return shown(research.require_rows(df), ["d"], [], ["code", *NAMES, out_num("target", 4).alias("target")])


@query("m3_dataset", _DATASET_SQL)
def m3(spark, sf):
    return shown_dataset(dataset(spark, sf))


@query("m3_dataset_records", _DATASET_SQL)
def m3_records(spark, sf):
    """The same from stored records of hits."""
    hits = research.rule_hits(fx.details(spark, sf))
    return shown_dataset(research.rule_dataset(hits, fx.bars(spark, sf), NAMES, [1, 5], 5, min_hits=5000))


CTES["placed_rows"] = "SELECT code, d, row_number() OVER (ORDER BY d, code) - 1 AS pos, count(*) OVER () AS n FROM bars"


@query("m4_split_time", with_("placed_rows") + f"""
SELECT code, {T('d')} AS d, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM placed_rows""")
def m4(spark, sf):
    b = fx.bars(spark, sf).select("code", "d")
    return shown(research.split_time(b, 0.2), ["d"], [], ["code", "part"])


@query("m4_split_time_sorted", with_("placed_rows") + f"""
SELECT code, {T('d')} AS d, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM placed_rows""")
def m4_sorted(spark, sf):
    """The same split with each date cut into finer parts."""
    b = fx.bars(spark, sf).select("code", "d")
    return shown(research.split_time(b, 0.2, prefix=9), ["d"], [], ["code", "part"])


@query("m5_folds", with_("placed_rows") + f"""
SELECT code, {T('d')} AS d, fold, CASE WHEN pos < s THEN 'train' ELSE 'test' END AS part FROM (
SELECT p.*, i AS fold, n - (2 - i) * size AS e, n - (2 - i) * size - size AS s FROM (
  SELECT *, greatest(1, floor(n * 0.2::DOUBLE))::BIGINT AS size FROM placed_rows) p CROSS JOIN (SELECT unnest([0, 1, 2]) AS i)) WHERE s > 0 AND pos < e""")
def m5(spark, sf):
    b = fx.bars(spark, sf).select("code", "d")
    return shown(research.split_folds(b, 0.2, 3), ["d"], [], ["code", "fold", "part"])


@query("m6_rule_importance")
def m6(spark, sf):
    """Boosted trees have no SQL form; the tests check that an informative rule comes first."""
    parts = written_once(research.split_time(dataset(spark, sf), 0.2))
    train, test = (parts.where(F.col("part") == p) for p in ("train", "test"))
    return research.rule_importance(train, test, NAMES, rounds=3)


# One tree of depth one over all rows: the split of a rule's adds with the least squared error, and the means of its sides.
CTES["parts"] = """
SELECT w.*, CASE WHEN row_number() OVER (ORDER BY w.d, w.code) - 1 < floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part
FROM dataset w"""
CTES["long"] = "SELECT * FROM (UNPIVOT (SELECT code, d, part, target, " + ", ".join(f"{n}::DOUBLE AS {n}" for n in NAMES) + " FROM parts) ON " + ", ".join(NAMES) + " INTO NAME rule VALUE x)"
CTES["by_value"] = "SELECT rule, x, count(*) AS n, sum(target) AS s FROM long WHERE part = 'train' GROUP BY rule, x"
CTES["sides"] = """
SELECT rule, x, sum(n) OVER w AS n0, sum(s) OVER w AS s0, sum(n) OVER (PARTITION BY rule) AS n1, sum(s) OVER (PARTITION BY rule) AS s1
FROM by_value WINDOW w AS (PARTITION BY rule ORDER BY x ROWS UNBOUNDED PRECEDING)"""
CTES["best_split"] = """
SELECT rule, x, s0 / n0 AS low, (s1 - s0) / (n1 - n0) AS high FROM sides WHERE n0 < n1
ORDER BY s0 * s0 / n0 + (s1 - s0) * (s1 - s0) / (n1 - n0) DESC LIMIT 1"""
CTES["fitted"] = """
SELECT l.part, l.target, CASE WHEN l.x <= b.x THEN b.low ELSE b.high END AS y FROM long l JOIN best_split b USING (rule)"""
_PARTS = ("train", "test")
_measures = ", ".join(
    f"{R(e.format(p=p))} AS {p}_{n}" for p in _PARTS for n, e in (
        ("rmse", "sqrt(avg((y - target) * (y - target)) FILTER (WHERE part = '{p}'))"), ("mae", "avg(abs(y - target)) FILTER (WHERE part = '{p}')"),
        ("mean", "avg(y) FILTER (WHERE part = '{p}')"), ("target", "avg(target) FILTER (WHERE part = '{p}')")))


@query("m6_one_split", with_("fitted") + f"""
SELECT {_measures}, count(*) FILTER (WHERE part = 'train') AS train_size, count(*) FILTER (WHERE part = 'test') AS test_size, 0 AS best_round,
  (SELECT rule FROM best_split) AS rule, 1.0::DOUBLE AS gain FROM fitted""")
def m6_one(spark, sf):
    """The same fit with one tree of depth one and nothing drawn has a closed form."""
    parts = written_once(research.split_time(dataset(spark, sf), 0.2))
    train, test = (parts.where(F.col("part") == p) for p in _PARTS)
    out = research.rule_importance(train, test, NAMES, rounds=1, depth=1, rows=1.0, columns=1.0)
    # One rule has all the gain. Without a split, as for rules that are the same in all rows, there is no fit to measure.
    split = F.col("gain") > 0
    out = out.orderBy(F.desc("gain")).limit(1).withColumnsRenamed({"rmse": "test_rmse", "mae": "test_mae"})
    out = out.withColumns({c: F.when(split, F.col(c)) for c in out.columns if c not in ("gain", "best_round")})
    out = out.na.fill(0, [f"{p}_size" for p in _PARTS]).withColumn("gain", F.when(split, F.col("gain")).otherwise(1.0))
    nums = [f"{p}_{n}" for p in _PARTS for n in ("rmse", "mae", "mean", "target")]
    return shown(out, [], nums, ["train_size", "test_size", "best_round", "rule", "gain"])
