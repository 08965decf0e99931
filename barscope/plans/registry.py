"""Registry of queries: a Spark callable and, where SQL can say it, the equivalent statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barscope.functions.values import day_text, rnd


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(run, sql)
        return run

    return add


def out_num(x, n: int = 6) -> Column:
    """Number for comparison: rounded, without a negative zero."""
    return rnd(x, n)


def shown(df: DataFrame, days=(), nums=(), plain=(), digits: int = 6) -> DataFrame:
    """Result columns: dates as text, numbers rounded, the rest as they are."""
    return df.select(
        *[day_text(c).alias(c) for c in days],
        *[out_num(F.col(c).cast("double"), digits).alias(c) for c in nums],
        *plain,
    )


# SQL side -------------------------------------------------------------------------------------

def R(expr: str, n: int = 6) -> str:
    return f"(round_even(CAST(({expr}) AS DOUBLE) * 1e{n}, 0) / 1e{n} + 0.0)"


def T(expr: str) -> str:
    return f"strftime({expr}, '%Y%m%d')"


def sql_shown(days=(), nums=(), plain=(), digits: int = 6) -> str:
    cols = [f"{T(c)} AS {c}" for c in days]
    cols += [f"{R(c, digits)} AS {c}" for c in nums]
    return ", ".join([*cols, *plain])


WIN = "PARTITION BY code ORDER BY d"


def over(n: int | None = None) -> str:
    """The last ``n`` bars, or all so far."""
    back = "UNBOUNDED" if n is None else str(n - 1)
    return f"OVER ({WIN} ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)"


def strict(fn: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) {over(n)} = {n} THEN {fn}({x}) {over(n)} END)"


def lag(x: str, n: int = 1) -> str:
    return f"(lag({x}, {n}) OVER ({WIN}))"


CTES: dict[str, str] = {}


def with_(*names: str) -> str:
    """WITH clause holding the named parts and, before them, what they read."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in CTES:
            if other != name and _reads(CTES[name], other):
                visit(other)
        order.append(name)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n"


def _reads(body: str, name: str) -> bool:
    import re

    return re.search(rf"\b(FROM|JOIN)\s+{name}\b", body) is not None


def ewm_sql(x: str, alpha: float, adjust: bool, source: str, out: str, mask: bool = True) -> str:
    """Recursive average as a fold over each row's history (source must have code, d, rn)."""
    w = f"({1.0 - alpha!r})"
    if adjust:
        elem = f"{{'t': rn, 'a': {x}, 'b': 1.0::DOUBLE}}"
        step = (
            f"{{'t': e.t, 'a': s.a * pow({w}, e.t - s.t) + e.a, 'b': s.b * pow({w}, e.t - s.t) + e.b}}"
        )
        value = "f.a / f.b"
    else:
        elem = f"{{'t': rn, 'a': {x}}}"
        p = f"pow({w}, e.t - s.t)"
        step = f"{{'t': e.t, 'a': ({p} * s.a + {alpha!r} * e.a) / ({p} + {alpha!r})}}"
        value = "f.a"
    seen = f"{x} IS NOT NULL" if mask else "f IS NOT NULL"
    return (
        f"SELECT * EXCLUDE (f, hist), CASE WHEN {seen} THEN {value} END AS {out} FROM ("
        f"SELECT *, CASE WHEN len(hist) > 0 THEN list_reduce(hist, lambda s, e: {step}) END AS f FROM ("
        f"SELECT *, list({elem}) FILTER (WHERE {x} IS NOT NULL) {over()} AS hist FROM {source}))"
    )
