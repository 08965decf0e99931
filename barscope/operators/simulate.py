"""Hypothetical next bars and what rules say about them."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscope.functions.values import next_day, scenario_id
from barscope.operators.clean import last_bars, newest, union_bars
from barscope.operators.indicators import REGISTRY, with_indicators
from barscope.operators.reach import Reach, as_given, bars_for, features_back, indicators_back
from barscope.operators.rules import Rule, merge_gate, predicate
from barscope.operators.scoring import rank_scores, score, score_reach

MIN_WICK = 0.001  # fixed value: shadow given where the last bar has none


@dataclass(frozen=True)
class Scenario:
    """Assumptions about the next bar; percentages are in percent."""

    mode: str = "close_pct"  # flat, close_pct, open_pct, gap_then_close_pct, limit_up, limit_down, reverse_indicator
    pct: float = 0.0
    gap_pct: float = 0.0
    hl_mode: str = "follow"  # follow, atr_like, range_pct
    range_pct: float = 1.5
    atr_mult: float = 1.0
    vol_mode: str = "same"  # same, pct, mult
    vol_arg: float = 0.0
    limit_up_pct: float = 9.9
    limit_dn_pct: float = -9.9
    lock_higher_than_open: bool = False
    lock_inside_day: bool = False
    reverse_indicator: str = ""
    reverse_target_value: float = 0.0
    reverse_method: str = "grid"  # grid, bisect
    reverse_tolerance: float = 1e-6


def _struct(scenario: Scenario) -> Column:
    return F.struct(*[F.lit(getattr(scenario, f.name)).alias(f.name) for f in fields(scenario)])


def _fields(overridden: Sequence[str]) -> dict[str, Column]:
    """A scenario's fields from the row's ``_sc``; one given per symbol replaces it where present."""
    base = {f.name: F.col(f"_sc.{f.name}") for f in fields(Scenario)}
    return base | {n: F.coalesce(F.col(f"_ov.{n}"), base[n]) for n in overridden}


def _prices(s: dict[str, Column]) -> dict[str, Column]:
    prev_o, prev_c, prev_h, prev_l = (F.col(n) for n in "ochl")
    mode = s["mode"]

    def moved(base: Column, pct: Column) -> Column:
        return base * (1.0 + pct / 100.0)

    limit = moved(prev_c, F.when(mode == "limit_up", s["limit_up_pct"]).otherwise(s["limit_dn_pct"]))
    at_limit = mode.isin("limit_up", "limit_down")
    o = (
        F.when(mode == "open_pct", moved(prev_c, s["pct"]))
        .when(mode == "gap_then_close_pct", moved(prev_c, s["gap_pct"]))
        .when(at_limit, limit)
        .otherwise(prev_c)
    )
    c = (
        F.when(mode.isin("flat", "open_pct"), prev_c)
        .when(mode == "gap_then_close_pct", moved(o, s["pct"]))
        .when(at_limit, limit)
        .otherwise(moved(prev_c, s["pct"]))
    )
    c = F.when(s["lock_higher_than_open"], F.greatest(c, o)).otherwise(c)
    # The range comes from the last bar, whatever the new open and close are.
    top, bottom = F.greatest(prev_o, prev_c), F.least(prev_o, prev_c)
    wick = F.lit(MIN_WICK)
    upper = F.when(prev_h > top, prev_h - top).otherwise(wick)
    lower = F.when(prev_l < bottom, bottom - prev_l).otherwise(wick)
    mid = (prev_c + prev_o) / 2.0
    span = F.when(
        s["hl_mode"] == "atr_like", (prev_h - prev_l) * F.greatest(s["atr_mult"], F.lit(0.1))
    ).otherwise(top * (F.abs(s["range_pct"]) / 100.0))
    follow = s["hl_mode"] == "follow"
    return {
        "o": o, "c": c,
        "h": F.when(follow, top + upper).otherwise(mid + span / 2.0),
        "l": F.when(follow, bottom - lower).otherwise(mid - span / 2.0),
    }


def _volume(s: dict[str, Column]) -> Column:
    prev, arg = F.coalesce("v", F.lit(0.0)), s["vol_arg"]
    v = (
        F.when(s["vol_mode"] == "same", prev)
        .when(s["vol_mode"] == "pct", prev * (1.0 + arg / 100.0))
        .otherwise(prev * F.when(arg != 0, arg).otherwise(F.lit(1.0)))
    )
    return F.greatest(v, F.lit(0.0))


def next_bars(bars: DataFrame, scenario: Scenario, overrides: DataFrame | None = None,
              sim_date=None) -> DataFrame:
    """One simulated bar per code, from its last bar.

    ``overrides`` has code and any scenario fields; where a field is null the default holds.
    ``sim_date`` defaults to the day after the newest bar.
    """
    return scenario_bars(bars, {"": scenario}, overrides, sim_date).drop("scenario")


def scenario_bars(bars: DataFrame, scenarios: dict[str, Scenario], overrides: DataFrame | None = None,
                  sim_date=None) -> DataFrame:
    """Simulated bars of every code under named scenarios, all from the row of its last bar.

    The scenarios are an array in that row, so any number of them takes one pass over the bars. What is given in ``overrides`` holds for
    a code under all of them.
    """
    last = last_bars(bars.select("code", "d", "o", "h", "l", "c", "v"))
    if sim_date is None:
        last = last.join(F.broadcast(last.agg(next_day(F.max("d")).alias("_sim"))), F.col("_sim").isNotNull())  # one row
    else:
        last = last.withColumn("_sim", F.lit(sim_date).cast("date"))
    given = [c for c in overrides.columns if c != "code"] if overrides is not None else []
    if given:
        packed = overrides.select("code", F.struct(*given).alias("_ov"))
        last = last.join(packed, "code", "left")
    each = F.array(*[F.struct(F.lit(n).alias("scenario"), _struct(s).alias("_sc")) for n, s in scenarios.items()])
    last = last.select("*", F.inline(each))
    s = _fields(given)
    moved = last.withColumns({f"_{n}": e for n, e in _prices(s).items()} | {"_v": _volume(s)})
    out = _locked(moved, s)
    if "mode" in given or any(x.mode == "reverse_indicator" for x in scenarios.values()):
        solved = s["mode"] == "reverse_indicator"
        names = ["code", "scenario", "_sim", *[f"_{n}" for n in "ohlcv"]]
        indicators = None if "reverse_indicator" in given else sorted({x.reverse_indicator for x in scenarios.values() if x.reverse_indicator})
        if indicators is None or indicators:
            reverse = _reverse(bars, last.where(solved), indicators, s)
            out = out.where(~solved).select(*names).unionByName(reverse.select(*names))
    return out.select(
        "scenario", "code", F.col("_sim").alias("d"),
        *[F.col(f"_{n}").alias(n) for n in ("o", "h", "l", "c", "v")],
    )


def _locked(out: DataFrame, s: dict[str, Column]) -> DataFrame:
    inside = s["lock_inside_day"]
    return out.withColumns({
        "_h": F.when(inside, F.greatest("_h", "_o", "_c")).otherwise(F.col("_h")),
        "_l": F.when(inside, F.least("_l", "_o", "_c")).otherwise(F.col("_l")),
    })


def _reverse(bars: DataFrame, last: DataFrame, indicators: Sequence[str] | None, s: dict[str, Column]) -> DataFrame:
    """Prices that bring an indicator to its target; codes that do not converge stay flat.

    Indicator, target, tolerance and method are the row's own, like all other fields.
    """
    from barscope.operators import solver

    names = list(solver.NEXT if indicators is None else indicators)
    state = solver.last_state(bars, names)
    keep = [c for c in state.columns if c not in last.columns]
    want = {"indicator": s["reverse_indicator"], "target": s["reverse_target_value"], "tolerance": s["reverse_tolerance"], "method": s["reverse_method"]}
    rows = last.withColumns(want).join(state.select("code", *keep), "code")
    found = solver.solved(rows, names, ["scenario"]).withColumnRenamed("code", "_code").withColumnRenamed("scenario", "_scenario")
    flat = _prices(s | {"mode": F.lit("flat")})
    same = (F.col("code") == F.col("_code")) & (F.col("scenario") == F.col("_scenario"))
    out = last.join(found.select("_code", "_scenario", "price", "converged"), same, "left")
    ok = F.coalesce("converged", F.lit(False))
    ratio = F.col("price") / F.col("c")
    out = out.withColumns(
        {f"_{n}": F.when(ok, F.col(n) * ratio).otherwise(flat[n]) for n in "ohlc"} | {"_v": _volume(s)}
    )
    c = F.when(ok & s["lock_higher_than_open"], F.greatest("_c", "_o")).otherwise(F.col("_c"))
    return _locked(out.withColumn("_c", c), s)


def simulate_next(bars: DataFrame, scenario: Scenario, overrides: DataFrame | None = None,
                  indicators: Sequence[str] = (), sim_date=None) -> DataFrame:
    """History with the simulated bar appended and the indicators recomputed; ``sim`` marks it."""
    new = next_bars(bars, scenario, overrides, sim_date).withColumn("sim", F.lit(True))
    both = union_bars(bars.withColumn("sim", F.lit(False)), new)
    return with_indicators(both, indicators) if indicators else both


def eval_on_date(df: DataFrame, exprs: dict[str, Column | str], date=None) -> DataFrame:
    """Named predicates on the bars of one date (or the simulated ones)."""
    df = df.withColumns({f"_{n}": predicate(e) for n, e in exprs.items()})
    at = F.col("sim") if date is None else F.col("d") == F.lit(date).cast("date")
    return df.where(at).select("code", "d", *[F.col(f"_{n}").alias(n) for n in exprs])


def last_j(df: DataFrame, date) -> DataFrame:
    """The indicator j of every code on a date, computed if the table does not have it."""
    if "j" not in df.columns:
        df = with_indicators(df, ["kdj"])
    return df.where(F.col("d") == F.lit(date).cast("date")).select("code", "j")


def _check(check, scenario: Scenario) -> Column:
    if check is None:
        return F.lit(True)
    if scenario.mode == "open_pct" and isinstance(check, str):
        check = re.sub(r"(?i)\bc\s*>\s*o\b", "c >= o", check)
    return predicate(check)


def run_prediction(bars: DataFrame, checks: Sequence[tuple[str, Column | str | None, Scenario]],
                   ranks: DataFrame, features: Callable[[DataFrame], DataFrame] = as_given) -> DataFrame:
    """Codes whose simulated bar satisfies a check, each under its own scenario, with today's scores.

    A check of None holds for every code.  Under a scenario that sets the open and leaves the close, a check ``c > o``
    given as text also holds where they are equal.  Only the newest bars of each code, as many as the features and the indicator look back, go
    through the scenarios: each scenario is a series of its own made of them and its simulated bar, so all take one scan.
    """
    ref, sim = bars.agg(F.max("d"), next_day(F.max("d"))).first()
    scenarios = list(dict.fromkeys(s for _, _, s in checks))
    back = features_back(features)
    reach = Reach(None if back is None else max(back, indicators_back(["kdj"]), *[scenario_back(s) for s in scenarios]))
    kept = bars if ref is None else bars_for(bars, sim, sim, reach, every_code=True)
    if reach.bars is not None:
        # A bar more, so that what counts bars knows that there are enough.
        kept = newest(kept, reach.bars + 1)
    names = {f"{i:04d}": s for i, s in enumerate(scenarios)}
    new = scenario_bars(kept, names, sim_date=sim).withColumn("sim", F.lit(True))
    old = kept.select(F.explode(F.array(*map(F.lit, names))).alias("scenario"), *kept.columns, F.lit(False).alias("sim"))
    series = F.concat_ws("\x00", "code", "scenario")
    df = union_bars(old, new).withColumn("_own", F.col("code")).withColumn("code", series)
    df = features(with_indicators(df, ["kdj"]))
    wanted = [(n, (F.col("scenario") == f"{scenarios.index(s):04d}") & _check(c, s)) for n, c, s in checks]
    df = df.withColumns({f"_c{i}": c for i, (_, c) in enumerate(wanted)}).where("sim")
    found = F.filter(F.array(*[F.when(F.col(f"_c{i}"), F.lit(n)) for i, (n, _) in enumerate(wanted)]), lambda x: x.isNotNull())
    ids = F.create_map(*[x for n, s in names.items() for x in (F.lit(n), F.lit(scenario_id(asdict(s))))])
    out = df.select(
        F.col("_own").alias("code"), F.explode(found).alias("rule_name"), "j", F.lit(ref).alias("ref_date"),
        F.lit(sim).alias("sim_date"), ids[F.col("scenario")].alias("scenario_id"),
    )
    today = ranks.where(F.col("d") == F.lit(ref)).select(
        "code", "score", F.col("j").alias("tiebreak_j"), "rank"
    )
    return out.join(today, "code", "left")


def scenario_back(scenario: Scenario, overrides: DataFrame | None = None) -> int:
    """Bars that a simulated bar depends on: the last one, and what a solved indicator looks back."""
    if overrides is not None and {"mode", "reverse_indicator"} & set(overrides.columns):
        return indicators_back(list(REGISTRY))
    solved = scenario.mode == "reverse_indicator" and scenario.reverse_indicator
    return indicators_back([scenario.reverse_indicator]) if solved else 1


def predict_ranking(bars: DataFrame, scenario: Scenario, rules: Sequence[Rule],
                    features: Callable[[DataFrame], DataFrame] = as_given,
                    overrides: DataFrame | None = None) -> DataFrame:
    """Scores and ranks of the simulated date, from the bars that can matter for it."""
    sim = bars.agg(next_day(F.max("d"))).first()[0]
    reach = score_reach([merge_gate(r) for r in rules], features) | Reach(scenario_back(scenario, overrides))
    df = simulate_next(bars_for(bars, sim, sim, reach, every_code=True), scenario, overrides, ["kdj"], sim)
    return rank_scores(score(df, rules, features).where(F.col("d") == F.lit(sim)))


def position_checks(bars: DataFrame, positions: DataFrame, policies: Sequence[tuple[str, Column | str, str]],
                    ref=None, scenario: Scenario | None = None,
                    features: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Policies on many open positions.

    ``positions`` has code, entry_date, entry_price and further variables; a policy is (name, predicate,
    explanation) over the columns of the code's last bar up to ``ref``, the position's and unreal_pnl.  With a
    scenario the bar is the simulated one after it, with the features computed again.
    """
    past = bars if ref is None else bars.where(F.col("d") <= F.lit(ref).cast("date"))
    if scenario is None:
        at = last_bars(features(past)).withColumns({"ref_date": F.col("d"), "sim_date": F.col("d")})
    else:
        days = past.agg(F.max("d").alias("ref_date"), next_day(F.max("d")).alias("sim_date"))
        at = features(simulate_next(past, scenario, indicators=["kdj"])).where("sim")
        at = at.join(F.broadcast(days), F.col("d") == F.col("sim_date"))  # one row
    taken = [c for c in at.columns if c == "code" or c not in positions.columns]
    df = positions.join(at.select(*taken), "code")
    df = df.withColumn("unreal_pnl", (F.col("c") - F.col("entry_price")) / F.col("entry_price"))
    rows = [
        F.struct(F.lit(n).alias("name"), predicate(p).alias("hit"), F.lit(x).alias("explain"))
        for n, p, x in policies
    ]
    return df.select(
        "code", "entry_date", "entry_price", "unreal_pnl", "ref_date", "sim_date",
        F.inline(F.array(*rows)),
    )
