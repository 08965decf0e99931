"""Custom combinations: select codes by which rules were triggered."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscope.operators.clean import apply_universe
from barscope.operators.ranking import rank_within
from barscope.operators.scoring import NO_J, coarse_order


@dataclass(frozen=True)
class Combination:
    """Rules joined by OR or AND, or groups ``(mode, rules)`` joined by ``group_mode``."""

    rules: Sequence[str] = ()
    agg_mode: str = "OR"
    groups: Sequence[tuple[str, Sequence[str]]] = ()
    group_mode: str = "AND"
    exclude: Sequence[str] = ()

    def targets(self) -> list[str]:
        return sorted({*self.rules, *[r for _, g in self.groups for r in g]})

    def collected(self) -> list[str]:
        """Rules whose dates are reported."""
        return list(self.rules) or self.targets()


def _matches(names: Column, mode: str, rules: Sequence[str]) -> Column:
    wanted = F.array(*[F.lit(r) for r in rules])
    if mode.upper() == "AND":
        return F.size(F.array_except(wanted, names)) == 0
    return F.arrays_overlap(names, wanted)


def selects(combo: Combination, names: Column) -> Column:
    """Whether the set of triggered rule names satisfies the combination."""
    if combo.groups:
        parts = [_matches(names, mode, rules) for mode, rules in combo.groups if rules]
        out = parts[0]
        for p in parts[1:]:
            out = (out | p) if combo.group_mode.upper() == "OR" else (out & p)
        return out
    return _matches(names, combo.agg_mode, combo.rules)


def custom_rank(details: DataFrame, scores: DataFrame, combo: Combination, top_n: int | None = None,
                universe=None, lists: DataFrame | None = None) -> DataFrame:
    """Codes and dates the combination selects, with the triggered rules and their dates; ``top_n`` of each date.

    ``universe`` and ``lists`` are as for ``apply_universe``.

    Grouped per code and date over at most as many records as there are rules.
    """
    if universe is not None:
        details = apply_universe(details, universe, lists)
    hit = details.where((F.col("ok") | (F.col("add") > 0)) & F.col("name").isin(*combo.targets(), *combo.exclude))
    target, dated = F.col("name").isin(combo.targets()), F.col("name").isin(combo.collected())
    out = hit.groupBy("code", "d").agg(
        F.array_sort(F.collect_set(F.when(target, F.col("name")))).alias("triggered"),
        trigger_dates(F.when(dated, F.col("hit_dates"))).alias("trigger_dates"),
        F.max(F.col("name").isin(*combo.exclude) if combo.exclude else F.lit(False)).alias("_out"),
    )
    out = out.where(~F.col("_out") & selects(combo, F.col("triggered"))).drop("_out")
    out = out.join(scores.select("code", "d", "score", "j"), ["code", "d"])
    out = out.withColumn("j", F.coalesce("j", F.lit(NO_J)))
    if top_n:
        out = rank_within(out, ["d"], custom_order(), coarse_order(), "_place").where(F.col("_place") <= top_n).drop("_place")
    return out


def custom_order() -> list[Column]:
    return [F.col("score").desc(), F.col("j"), F.col("code"), F.col("d")]


def trigger_span(details: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of distinct trigger dates of each group, the first and the last; no list of dates is gathered."""
    dates = details.where("ok").select(*by, F.explode("hit_dates").alias("_d")).distinct()
    return dates.groupBy(*by).agg(F.count("_d").alias("n"), F.min("_d").alias("first"), F.max("_d").alias("last"))


def trigger_dates(dates: Column) -> Column:
    """Sorted distinct dates over lists of dates."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(dates))))
