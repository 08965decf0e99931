"""Rules: boolean signals, window scopes, gates and clauses, evaluated for all codes and dates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscope.functions import scopes
from barscope.functions.scopes import PER_BAR, RECENCY, effective_window, parse_scope
from barscope.functions.values import all_of, sig
from barscope.operators.reach import condition_back
from barscope.operators.resample import resample

@dataclass(frozen=True)
class Clause:
    """One condition: a predicate over feature columns, looked at through a window and a scope.

    ``gate`` is a further predicate, or several, that must hold on the same bar. ``back`` says how many bars before its own the
    condition sees; a condition with a window of its own that doesn't say so is taken to see them all.
    """

    when: Column | str
    timeframe: str = "D"
    window: int = 60
    scope: str = "ANY"
    gate: Column | str | Sequence | None = None
    back: int | None = None


@dataclass(frozen=True)
class Rule:
    """A clause (or several) with points.

    ``bins`` are ``(lo, hi, points)`` by bars since the last hit, for the recency scopes; ``gate``
    is a further predicate; ``tag`` names the reason bucket and the published signal.  The scope is ``ANY``
    unless given, but a gate of a rule with clauses is then looked at on the last bar alone. ``back`` holds
    for the condition and the gate, as in ``Clause``.
    """

    name: str
    when: Column | str | None = None
    points: float = 0.0
    timeframe: str = "D"
    window: int = 60
    scope: str | None = None
    bins: tuple = ()
    gate: Column | str | Sequence | None = None
    clauses: tuple[Clause, ...] = ()
    tag: str | None = None
    explain: str | None = None
    show: bool = True
    reason: str | None = None
    hard: bool = True
    scope_given: bool | None = None
    back: int | None = None

    def __post_init__(self):
        if self.scope_given is None:
            object.__setattr__(self, "scope_given", self.scope is not None)
        object.__setattr__(self, "scope", self.scope or "ANY")
        if self.timeframe not in ("D", "W", "M"):
            raise ValueError(f"unknown timeframe {self.timeframe!r}")
        parse_scope(self.scope)
        if self.when is None and not self.clauses:
            raise ValueError(f"rule {self.name!r} has no condition")
        if parse_scope(self.scope)[0] in PER_BAR and len(
            {(c.timeframe, c.window) for c in self.clauses}
        ) > 1:
            raise ValueError("clauses of a per-bar rule must share timeframe and window")


def predicate(when) -> Column:
    return sig(F.expr(when) if isinstance(when, str) else when)


def _gates(gate) -> list:
    gates = list(gate) if isinstance(gate, (list, tuple)) else [gate]
    return [g.when if isinstance(g, Clause) else g for g in gates]


def _gated(x):
    """A rule or clause whose gate has become part of its predicate."""
    return replace(x, gate=None, when=all_of(*[predicate(p) for p in [*_gates(x.gate), x.when]]))


def merge_gate(rule: Rule) -> Rule:
    """The gate becomes part of the predicate, or a further clause; so do gates of clauses."""
    if any(c.gate is not None for c in rule.clauses):
        rule = replace(rule, clauses=tuple(_gated(c) if c.gate is not None else c for c in rule.clauses))
    if rule.gate is None:
        return rule
    if rule.clauses:
        scope = rule.scope if rule.scope_given else "LAST"
        more = tuple(Clause(g, rule.timeframe, rule.window, scope, back=rule.back) for g in _gates(rule.gate))
        return replace(rule, gate=None, clauses=rule.clauses + more)
    return _gated(rule)


def when_text(rule: Rule) -> str:
    """The rule's condition as text, where it was given as text; else its name."""
    parts = [rule.when] if rule.when is not None else [c.when for c in rule.clauses]
    return " AND ".join(parts) if all(isinstance(p, str) for p in parts) else rule.name


def _ungated(rule: Rule) -> Rule:
    """The rule without its gate; a gate of a black-list rule does not count."""
    return replace(rule, gate=None)


@dataclass(frozen=True)
class _Unit:
    """One signal of a rule, with the names of its result columns."""

    key: str
    timeframe: str
    window: int
    scope: str
    when: Column


def _units(i: int, rule: Rule) -> list[_Unit]:
    kind = parse_scope(rule.scope)[0]
    if kind in RECENCY:
        # The rule's own timeframe and window, and the first clause's predicate.
        when = predicate(rule.clauses[0].when if rule.clauses else rule.when)
        n = effective_window(rule.scope, rule.window, rule.bins)
        return [_Unit(f"u{i}_0", rule.timeframe, n, rule.scope, when)]
    if kind in PER_BAR:
        parts = [predicate(c.when) for c in rule.clauses] or [predicate(rule.when)]
        head = rule.clauses[0] if rule.clauses else rule
        n = effective_window(rule.scope, head.window, rule.bins)
        return [_Unit(f"u{i}_0", head.timeframe, n, rule.scope, all_of(*parts))]
    clauses = rule.clauses or (Clause(rule.when, rule.timeframe, rule.window, rule.scope),)
    return [
        _Unit(f"u{i}_{k}", c.timeframe, effective_window(c.scope, c.window), c.scope, predicate(c.when))
        for k, c in enumerate(clauses)
    ]


def units_of(rule: Rule, gates: bool = True) -> list[tuple[_Unit, int | None]]:
    """The signals of a rule, each with the bars that its condition sees before its own."""
    parts = rule.clauses or (rule,)
    backs = [condition_back(x, c.back) for c in parts for x in [c.when, *_gates(c.gate)] if x is not None]
    if gates and rule.gate is not None and rule.clauses:
        backs += [condition_back(x, rule.back) for x in _gates(rule.gate)]
    back = None if None in backs else max(backs)
    return [(u, back) for u in _units(0, merge_gate(rule) if gates else _ungated(rule))]


def _results(df: DataFrame, units: Sequence[_Unit], dates: bool) -> DataFrame:
    """Signals first, then their scopes: two window layers over one sort."""
    df = df.withColumns({f"{u.key}_s": u.when for u in units})
    cols = {}
    for u in units:
        s, kind = F.col(f"{u.key}_s"), parse_scope(u.scope)[0]
        if kind in PER_BAR:
            cols[f"{u.key}_cnt"] = scopes.true_count(s, u.window)
        elif kind in RECENCY:
            cols[f"{u.key}_lag"] = scopes.bars_since(s, u.window)
        else:
            cols[f"{u.key}_ok"] = scopes.scope_hit(s, u.scope, u.window)
        if dates:
            cols[f"{u.key}_dates"] = scopes.hit_dates(s, u.window)
            cols[f"{u.key}_label"] = scopes.period_label(u.window)
    return df.withColumns(cols).drop(*[f"{u.key}_s" for u in units])


def evaluate(
    bars: DataFrame,
    rules: Sequence[Rule],
    features: Callable[[DataFrame], DataFrame] = lambda df: df,
    dates: bool = False,
    gates: bool = True,
) -> DataFrame:
    """Every rule on every bar as the reference bar.

    Adds per rule ``i``: ``r{i}_ok``, ``r{i}_add`` and, by scope, ``r{i}_cnt`` or ``r{i}_lag``; with
    ``dates`` also ``r{i}_dates`` and ``r{i}_label``.  ``features`` adds the columns the predicates
    read; it is applied to day bars and to the week or month bars that rules ask for.  Week and
    month rules see finished periods only.
    """
    rules = [merge_gate(r) if gates else _ungated(r) for r in rules]
    units = {i: _units(i, r) for i, r in enumerate(rules)}
    flat = [u for us in units.values() for u in us]
    daily = features(bars)
    keep = daily.columns
    day_units = [u for u in flat if u.timeframe == "D"]
    out = _results(daily, day_units, dates) if day_units else daily
    for freq in sorted({u.timeframe for u in flat} - {"D"}):
        own = [u for u in flat if u.timeframe == freq]
        periods = features(resample(bars, freq))
        before = set(periods.columns)
        periods = _results(periods, own, dates)
        cols = [c for c in periods.columns if c not in before]
        out = _attach_finished(out, periods, cols)
    verdicts = {}
    for i, rule in enumerate(rules):
        verdicts |= _verdict(f"r{i}", rule, units[i], dates)
    return out.select(*keep, *[e.alias(n) for n, e in verdicts.items()])


def _attach_finished(days: DataFrame, periods: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns of the newest period that ended on or before each day.

    Periods are put between the days of their series, so both sides keep their partitioning by code
    and nothing is joined.
    """
    # A struct per column: null values of a period count, and what nobody reads is pruned.
    held = {f"_v_{c}": F.struct(F.col(c).alias("x")) for c in cols}
    marks = periods.select("code", "d", *[v.alias(n) for n, v in held.items()], F.lit(0).alias("_day"))
    both = days.withColumn("_day", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("code").orderBy("d", "_day").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in held}).where(F.col("_day") == 1)
    return both.select(*days.columns, *[F.col(f"_v_{c}.x").alias(c) for c in cols])


def _verdict(r: str, rule: Rule, units: Sequence[_Unit], dates: bool) -> dict[str, Column]:
    kind, first = parse_scope(rule.scope)[0], units[0].key
    if kind in PER_BAR:
        cnt = F.coalesce(F.col(f"{first}_cnt"), F.lit(0))
        cols = {f"{r}_cnt": cnt, f"{r}_ok": cnt > 0, f"{r}_add": cnt * F.lit(float(rule.points))}
    elif kind in RECENCY:
        lag = F.col(f"{first}_lag")
        cols = {f"{r}_lag": lag, f"{r}_ok": lag.isNotNull(), f"{r}_add": scopes.bin_points(lag, rule.bins)}
    else:
        ok = all_of(*[F.col(f"{u.key}_ok") for u in units])
        cols = {f"{r}_ok": ok, f"{r}_add": F.when(ok, F.lit(float(rule.points))).otherwise(F.lit(0.0))}
    if dates:
        none = F.array().cast("array<date>")
        cols[f"{r}_dates"] = F.coalesce(F.col(f"{first}_dates"), none)
        labels = [F.col(f"{u.key}_label") for u in units]
        cols[f"{r}_label"] = F.coalesce(F.concat_ws(";", *labels), F.date_format("d", "yyyyMMdd"))
    return cols


def _stored_dates(i: int, rule: Rule) -> Column:
    # Single-bar scopes are stored with the reference date; the others keep the dates they saw.
    kind = parse_scope(rule.scope)[0]
    if kind in PER_BAR or kind == "ANY":
        return F.col(f"r{i}_dates")
    return F.array(F.col("d"))


def rule_details(evaluated: DataFrame, rules: Sequence[Rule], hits_only: bool = True) -> DataFrame:
    """One row per code, date and rule, as stored: only rules that hit, unless asked otherwise.

    ``evaluated`` must carry dates.  Only the rules' numbers are exploded, those that hit, before any shuffle; the
    fields are chosen by number afterwards, so what a reader doesn't select is never computed.
    """
    hits, fields = [], {}
    for i, rule in enumerate(rules):
        kind = parse_scope(rule.scope)[0]
        cnt = F.col(f"r{i}_cnt") if kind in PER_BAR else F.lit(None)
        ok = F.col(f"r{i}_ok") if kind in PER_BAR else F.col(f"r{i}_add") != 0
        stored = _stored_dates(i, rule)
        hits.append(F.when(ok, F.lit(i)) if hits_only else F.lit(i))
        record = {
            "name": F.lit(rule.name),
            "scope": F.lit(rule.scope),
            "timeframe": F.lit(rule.timeframe),
            "score_windows": F.lit(effective_window(rule.scope, rule.window, rule.bins)),
            "period": F.col(f"r{i}_label"),
            "points": F.lit(float(rule.points)),
            "ok": ok,
            "cnt": cnt.cast("int"),
            "add": F.col(f"r{i}_add"),
            "hit_date": F.when(ok, F.array_max(stored)),
            "hit_dates": F.when(ok, stored).otherwise(F.array().cast("array<date>")),
            "hit_count": F.when(ok, F.size(stored)).otherwise(F.lit(0)),
        }
        for name, value in record.items():
            # The last rule is what remains, so that a field is null only where a rule's own is.
            last = i == len(rules) - 1
            fields.setdefault(name, []).append(value if last else F.when(F.col("_pos") == i, value))
    out = evaluated.withColumn("_pos", F.explode(F.array(*hits))).where("_pos IS NOT NULL")
    return out.select("code", "d", F.col("_pos").alias("pos"), *[_chosen(v).alias(n) for n, v in fields.items()])


def _chosen(values: list[Column]) -> Column:
    """The value of the row's rule: conditions for all rules but the last."""
    return reduce(lambda rest, when: when.otherwise(rest), reversed(values[:-1]), values[-1])


def rule_tags(bars: DataFrame, rules: Sequence[Rule], features=lambda df: df) -> DataFrame:
    """Signals of the tagged day rules as a long table (code, d, bucket, name), true bars only."""
    df, tags = tag_columns(features(bars), rules)
    names = F.array(*[
        F.when(F.col(f"`{t}`"), F.struct(F.lit(t.split("::", 1)[0]).alias("bucket"), F.lit(t.split("::", 1)[1]).alias("name")))
        for t in tags
    ])
    out = df.select("code", "d", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("x"))
    return out.select("code", "d", "x.bucket", "x.name")


def tag_columns(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, list[str]]:
    """The same signals as boolean columns named ``bucket::name``; a rule's clauses must all hold.

    They are added in rule order, so a rule's predicate may read the tags before it.
    """
    names = []
    for r in rules:
        if r.tag and r.timeframe == "D":
            parts = [r.when] if r.when is not None else [c.when for c in r.clauses]
            names.append(f"{r.tag}::{r.name}")
            df = df.withColumn(names[-1], all_of(*map(predicate, parts)))
    return df, names


def prescreen(
    bars: DataFrame, rules: Sequence[Rule], features=lambda df: df, merge_gates: bool = False
) -> DataFrame:
    """First hard rule that holds puts the bar on the black list, with its reason and period.

    Gates are ignored unless asked for.
    """
    hard = [r for r in rules if r.hard]
    seen = evaluate(bars, hard, features, dates=True, gates=merge_gates)
    out = seen.withColumn("_first", first_reason(hard, 0))
    base = [c for c in seen.columns if not (c.startswith("r") and c[1:2].isdigit())]
    return out.select(*base, "_first.reason", "_first.period")


def first_reason(rules: Sequence[Rule], at: int) -> Column:
    """Reason and period of the first rule that holds, for rules evaluated from place ``at`` on."""
    return F.coalesce(*[
        F.when(F.col(f"r{at + i}_ok"), F.struct(
            F.lit(r.reason or r.name).alias("reason"), F.col(f"r{at + i}_label").alias("period")))
        for i, r in enumerate(rules)
    ])


def with_blacklist(rules: Sequence[Rule], blacklist: Sequence[Rule]) -> list[Rule]:
    """Both kinds of rules in one list, to be evaluated in one pass without further gate merging."""
    return [*map(merge_gate, rules), *[_ungated(r) for r in blacklist if r.hard]]
