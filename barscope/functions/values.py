"""Row-wise column functions.

A signal is a boolean column that is never null: a comparison with a missing operand is false,
and its negation is therefore true.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, is_dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Divisor guard, limit-up fractions by board.
EPS = 1e-12
LIMIT_BJ, LIMIT_GROWTH, LIMIT_MAIN, LIMIT_ST = 0.295, 0.195, 0.095, 0.05


def col(x) -> Column:
    """A column from a name, a column or a number."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def sig(cond) -> Column:
    """Boolean signal: missing is false."""
    return F.coalesce(col(cond), F.lit(False))


def gt(a, b) -> Column:
    return sig(col(a) > col(b))


def ge(a, b) -> Column:
    return sig(col(a) >= col(b))


def lt(a, b) -> Column:
    return sig(col(a) < col(b))


def le(a, b) -> Column:
    return sig(col(a) <= col(b))


def eq(a, b) -> Column:
    return sig(col(a) == col(b))


def ne(a, b) -> Column:
    """Unlike the other comparisons, inequality with a missing operand is true."""
    return F.coalesce(col(a) != col(b), F.lit(True))


def all_of(*conds) -> Column:
    return reduce(lambda a, b: a & b, [sig(c) for c in conds])


def any_of(*conds) -> Column:
    return reduce(lambda a, b: a | b, [sig(c) for c in conds])


def not_(cond) -> Column:
    return ~sig(cond)


def finite(x) -> Column:
    """NaN and infinities become null, so nothing compares high by accident."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def to_number(x) -> Column:
    """Text to double; text that does not parse becomes missing."""
    return finite(col(x).try_cast("double"))


def rnd(x, decimals: int) -> Column:
    """Round half to even on the binary value, as numpy does."""
    scale = F.lit(float(10**decimals))
    return F.rint(col(x) * scale) / scale + F.lit(0.0)  # no negative zero


def max2(a, b) -> Column:
    """Row-wise maximum; missing if either side is missing."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def min2(a, b) -> Column:
    """Row-wise minimum; missing if either side is missing."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def if_(cond, a, b) -> Column:
    """``a`` where the condition holds, else ``b`` (a missing condition takes ``b``)."""
    return F.when(sig(cond), col(a)).otherwise(col(b))


def safe_div(a, b) -> Column:
    """Division with a tiny constant added to the divisor."""
    return col(a) / (col(b) + F.lit(EPS))


def div(a, b) -> Column:
    """Plain division whose zero divisor gives a missing value."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def slope_angle(ratio, scale: float = 0.5) -> Column:
    """Angle in degrees of a relative change, with ``scale`` as the 45-degree slope."""
    return F.degrees(F.atan(col(ratio) / F.lit(scale)))


def parse_day(x) -> Column:
    """Strict YYYYMMDD text to a date; anything else becomes null."""
    text = F.trim(col(x).cast("string"))
    return F.when(text.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd"))))


def day_text(d) -> Column:
    return F.date_format(col(d), "yyyyMMdd")


def next_day(d) -> Column:
    """The following calendar day (the date of a simulated bar)."""
    return F.date_add(col(d), 1)


def normalize_code(code, asset: str = "stock") -> Column:
    """Bring symbol spellings to ``600000.SH`` form; stocks without suffix get one by prefix."""
    s = F.upper(F.trim(F.coalesce(col(code), F.lit(""))))
    s = F.regexp_replace(F.translate(s, "_", "."), r"\s+", "")
    lead, tail = r"^(SH|SZ|BJ)[.-]?(\d{6})$", r"^(\d{6})[.-]?(SH|SZ|BJ)$"
    out = F.when(
        s.rlike(lead),
        F.concat_ws(".", F.regexp_extract(s, lead, 2), F.regexp_extract(s, lead, 1)),
    ).when(
        s.rlike(tail),
        F.concat_ws(".", F.regexp_extract(s, tail, 1), F.regexp_extract(s, tail, 2)),
    )
    if asset == "stock":
        board = (
            F.when(s.rlike(r"^(8|920)"), F.lit("BJ"))
            .when(s.rlike(r"^[569]"), F.lit("SH"))
            .otherwise(F.lit("SZ"))
        )
        out = out.when(s.rlike(r"^\d{6}$"), F.concat_ws(".", s, board))
    return out.otherwise(s)


def pad_code(code) -> Column:
    """Numeric codes that lost their leading zeros, padded and given an exchange suffix."""
    s = F.trim(F.coalesce(col(code), F.lit("")))
    padded = F.when(F.length(s) < 6, F.lpad(s, 6, "0")).otherwise(s)
    return F.when(s == "", s).otherwise(normalize_code(padded))


def market_label(code) -> Column:
    """Market segment by code prefix; the first matching prefix decides."""
    s = F.split_part(F.coalesce(col(code), F.lit("")), F.lit("."), F.lit(1))
    # Prefix pattern and label, in the order they are tried.
    return (
        F.when(s.rlike("^2"), F.lit("B股"))
        .when(s.rlike("^60"), F.lit("沪A"))
        .when(s.rlike("^00"), F.lit("深A"))
        .when(s.rlike("^3"), F.lit("创业板"))
        .when(s.rlike("^68"), F.lit("科创板"))
        .when(s.rlike("^[489]"), F.lit("北交所"))
        .otherwise(F.lit("其他"))
    )


def limit_up_pct(code, any_st=None) -> Column:
    """Limit-up fraction by board; ``any_st`` marks series whose name ever contained ST."""
    s = F.upper(F.trim(F.coalesce(col(code), F.lit(""))))
    board = (
        F.when(s.rlike(r"\.BJ$"), F.lit(LIMIT_BJ))
        .when(s.rlike(r"^(300|301|688|689)"), F.lit(LIMIT_GROWTH))
        .otherwise(F.lit(LIMIT_MAIN))
    )
    return board if any_st is None else F.when(sig(any_st), F.lit(LIMIT_ST)).otherwise(board)


def mark_st(df: DataFrame, name: str, key: str = "code", out: str = "any_st") -> DataFrame:
    """Add whether any row of the key carries ST in its name."""
    hit = F.coalesce(col(name).rlike(r"(?i)\*?ST"), F.lit(False))
    return df.join(df.groupBy(key).agg(F.max(hit).alias(out)), key)


def filter_concepts(text, blacklist: Sequence[str] = ()) -> Column:
    """Drop blacklisted names from comma-joined text; nothing left gives null."""
    banned = sorted({b.strip().lower() for b in blacklist if b.strip()})
    parts = F.transform(F.split(col(text), ","), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(banned) if banned else p != "")
    return F.nullif(F.array_join(kept, ","), F.lit(""))


def scenario_id(params) -> str:
    """Twelve hex digits of the md5 of the canonical parameters (all fields take part)."""
    data = asdict(params) if is_dataclass(params) else dict(params)
    text = json.dumps(data, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.md5(text.encode()).hexdigest()[:12]


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinity to null in every floating column."""
    bad = {f: finite(F.col(f)) for f, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(bad) if bad else df


def round_columns(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """Round the named columns that exist, half to even."""
    return df.withColumns({n: rnd(n, k) for n, k in decimals.items() if n in df.columns})


def round_display(df: DataFrame) -> DataFrame:
    """Two decimals for every floating column, for display."""
    return round_columns(df, {n: 2 for n, t in df.dtypes if t in ("double", "float")})
