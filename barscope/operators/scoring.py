"""Scores per code and date, ranks per date, recalculation and ad-hoc screens."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscope.functions.scopes import PER_BAR, RECENCY, effective_window, parse_scope
from barscope.functions.values import rnd
from barscope.operators.indicators import with_indicators
from barscope.operators.ranking import LAST, letters, rank_within, steps
from barscope.operators.clean import apply_universe
from barscope.operators.reach import Reach, as_given, bars_for, day, indicators_back, rules_reach
from barscope.operators.rules import Rule, evaluate, first_reason, when_text, with_blacklist

BASE_SCORE, MIN_SCORE = 50.0, 0.0
NO_J = 999999.0  # fixed value: missing tiebreak in combination lists


def total_add(rules: Sequence[Rule]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"r{i}_add") for i in range(len(rules))])


def score(
    bars: DataFrame,
    rules: Sequence[Rule],
    features: Callable[[DataFrame], DataFrame] = as_given,
    base: float = BASE_SCORE,
    floor: float = MIN_SCORE,
    blacklist: Sequence[Rule] = (),
    dates=None,
    tiebreak: bool = True,
) -> DataFrame:
    """Score of every code on every date: base plus the adds of all rules, floored.

    The adds of a bar are summed in its row; no join or aggregation takes part.  ``blacklist`` rules
    remove bars and are evaluated in the same pass; ``dates`` (dates, or a DataFrame of ``d``) keeps chosen
    dates only, and only the bars that can matter for them are read.  The tiebreak is the indicator ``j``, computed
    if the features do not hold it.
    """
    both = with_blacklist(rules, blacklist)
    if dates is not None:
        # A date column has at most as many values as the calendar.
        days = [r.d for r in dates.select("d").distinct().collect()] if isinstance(dates, DataFrame) else [day(d) for d in dates]
        days = sorted({d for d in days if d is not None})
        bars = bars_for(bars, days[0], days[-1], score_reach(both, features, tiebreak)) if days else bars.limit(0)
    seen = evaluate(bars, both, features, gates=False)
    if tiebreak and "j" not in seen.columns:
        seen = with_indicators(seen, ["kdj"])
    for i in range(len(rules), len(both)):
        seen = seen.where(~F.col(f"r{i}_ok"))
    j = F.col("j") if tiebreak else F.lit(None).cast("double")
    out = seen.withColumn("score", F.greatest(F.lit(base) + total_add(rules), F.lit(floor)))
    if dates is not None and days:
        out = out.where(F.col("d").isin(days))
    return out.select("code", "d", "score", j.alias("j"))


def score_reach(rules: Sequence[Rule], features: Callable[[DataFrame], DataFrame], tiebreak: bool = True) -> Reach:
    """How far back scores look: the rules (gates merged) over the features, and the tiebreak."""
    reach = rules_reach(rules, features, gates=False)
    return reach | Reach(indicators_back(["kdj"])) if tiebreak else reach


def recent_history(bars: DataFrame, calendar: DataFrame, first, rows: int) -> DataFrame:
    """Bars from ``rows`` trading days before the first wanted date on.

    The cut is a literal date, so it reaches the scan.  ``rows`` must cover the longest window;
    averages over the full history need the full history instead.
    """
    past = calendar.where(F.col("d") <= F.lit(first).cast("date")).orderBy(F.col("d").desc())
    start = past.limit(rows + 1).agg(F.min("d")).first()[0]
    return bars if start is None else bars.where(F.col("d") >= F.lit(start))


def sum_scores(details: DataFrame, base: float = BASE_SCORE, floor: float = MIN_SCORE) -> DataFrame:
    """Scores from stored rule records."""
    out = details.groupBy("code", "d").agg(F.sum("add").alias("_add"))
    return out.select("code", "d", F.greatest(F.lit(base) + F.col("_add"), F.lit(floor)).alias("score"))


def reasons(evaluated: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Texts of the rules that scored, in rule order: highlights, drawbacks, opportunities."""
    def bucket(i: int, rule: Rule) -> Column:
        tag = (rule.tag or "auto").lower()
        if tag != "auto":
            return F.lit(tag if tag in ("opportunity", "highlight") else "drawback")
        return F.when(F.col(f"r{i}_add") >= 0, F.lit("highlight")).otherwise(F.lit("drawback"))

    shown = [(i, r) for i, r in enumerate(rules) if r.explain and r.show]
    def texts(name: str) -> Column:
        hit = [F.when((F.col(f"r{i}_add") != 0) & (bucket(i, r) == name), F.lit(r.explain)) for i, r in shown]
        return F.filter(F.array(*hit), lambda x: x.isNotNull())

    return evaluated.select(
        "code", "d", texts("highlight").alias("highlights"), texts("drawback").alias("drawbacks"),
        texts("opportunity").alias("opportunities"),
    )


def rank_order() -> list[Column]:
    return [F.col("score").desc(), F.col("j").asc_nulls_last(), F.col("code")]


def coarse_order() -> list[Column]:
    """The rank order in buckets: the score itself, as rules add up to few values, then the tiebreak in steps.

    Only where the tiebreak is missing does the code come next, so only there its first letters count.
    """
    score = F.coalesce(-F.col("score").cast("double"), F.lit(LAST))
    return [score, steps(F.col("j"), 20), F.when(F.col("j").isNull(), letters(F.col("code"))).otherwise(F.lit(""))]


def rank_scores(scores: DataFrame) -> DataFrame:
    """Rank per date by score, tiebreak (missing last) and code; the score is rounded afterwards."""
    out = rank_within(scores, ["d"], rank_order(), coarse_order(), "rank", "total")
    return out.withColumn("score", rnd("score", 3))


def rescore(ranks: DataFrame, bars: DataFrame, rules: Sequence[Rule], features=as_given,
            floor: float = MIN_SCORE, blacklist: Sequence[Rule] = ()) -> DataFrame:
    """Add the adds of chosen rules to existing scores and rank again.

    Codes without an earlier score start from the base score; black-listed bars keep what they had.
    """
    both = with_blacklist(rules, blacklist)
    seen = evaluate(bars, both, features, gates=False).withColumn("_add", total_add(rules))
    for i in range(len(rules), len(both)):
        seen = seen.where(~F.col(f"r{i}_ok"))
    j = F.col("j") if "j" in seen.columns else F.lit(None).cast("double")
    fresh = seen.select("code", "d", "_add", j.alias("_j"))
    both = ranks.select("code", "d", "score", "j").join(fresh, ["code", "d"], "full_outer")
    start = F.coalesce(F.col("score"), F.lit(BASE_SCORE))
    new = F.when(F.col("_add").isNull(), F.col("score")).otherwise(
        F.greatest(start + F.col("_add"), F.lit(floor))
    )
    both = both.select("code", "d", new.alias("score"), F.coalesce("_j", "j").alias("j"))
    return rank_scores(both.where(F.col("score").isNotNull()))


def apply_rule(bars: DataFrame, rule: Rule, features=as_given, dates: bool = False) -> DataFrame:
    """One rule on every bar, with plain column names: ok, add, and cnt or lag by scope."""
    kind = parse_scope(rule.scope)[0]
    seen = evaluate(bars, [rule], features, dates=dates)
    more = {"cnt": kind in PER_BAR, "lag": kind in RECENCY, "dates": dates, "label": dates}
    return seen.select(
        "code", "d", F.col("r0_ok").alias("ok"), F.col("r0_add").alias("add"),
        *[F.col(f"r0_{n}").alias(n) for n, wanted in more.items() if wanted],
    )


def screen(bars: DataFrame, rule: Rule, ranks: DataFrame, features=as_given, ref=None,
           universe: DataFrame | None = None, blacklist: Sequence[Rule] = ()) -> DataFrame:
    """Codes a rule selects, with their scores, ranked among the selected ones per date; for a reference date only the
    bars that can matter for it are read."""
    both = with_blacklist([rule], blacklist)
    if ref is not None:
        bars = bars_for(bars, ref, ref, rules_reach(both, features, gates=False))
    hits = evaluate(bars, both, features, gates=False).where("r0_ok")
    for i in range(1, len(both)):
        hits = hits.where(~F.col(f"r{i}_ok"))
    hits = hits.select("code", "d")
    if ref is not None:
        day = F.lit(ref).cast("date")
        hits, ranks = hits.where(F.col("d") == day), ranks.where(F.col("d") == day)
    if universe is not None:
        hits = apply_universe(hits, universe)
    out = attach_scores(hits, ranks)
    order = [F.col("score").desc_nulls_last(), F.col("j").asc_nulls_last(), F.col("code")]
    return rank_within(out, ["d"], order, coarse_order())


def screen_lists(bars: DataFrame, rule: Rule, features=as_given, blacklist: Sequence[Rule] = ()):
    """White and black lists of a screen: selected codes, and the rest with the reason.

    Codes that the black list rules out carry its reason and period; the others the screen's own text, with the window it
    looks at and its condition, and the reference date.
    """
    both = with_blacklist([rule], blacklist)
    seen = evaluate(bars, both, features, dates=True, gates=False)
    seen = seen.withColumn("_first", first_reason(both[1:], 1) if both[1:] else F.lit(None))
    reason, period = (
        (F.col("_first.reason"), F.col("_first.period")) if both[1:] else (F.lit(None), F.lit(None))
    )
    text = f"{rule.timeframe}{effective_window(rule.scope, rule.window, rule.bins)}:{rule.scope}::{when_text(rule)}"
    white = F.col("r0_ok") & reason.isNull()
    return seen.select(
        "code", "d", F.when(white, F.lit("white")).otherwise(F.lit("black")).alias("list"),
        F.coalesce(period, F.date_format("d", "yyyyMMdd")).alias("period"),
        F.when(white, F.lit(f"screen:{text}")).otherwise(F.coalesce(reason, F.lit(f"screen_fail:{text}"))).alias("reason"),
    )


def attach_scores(hits: DataFrame, ranks: DataFrame) -> DataFrame:
    """Scores of the hits where there are any."""
    return hits.join(ranks.select("code", "d", "score", "j"), ["code", "d"], "left")
