"""Cross-section ranks of volume and return, and their match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscope.functions.series import W
from barscope.functions.values import div
from barscope.operators.ranking import average_ranks, letters, rank_within, steps

INF = float("inf")


def cut(rank, k: int | None):
    """Ranks beyond ``k`` count as infinite; so does a missing rank."""
    r = F.coalesce(F.col(rank), F.lit(INF))
    return F.when(r > k, F.lit(INF)).otherwise(r) if k else r


def rank_vol(bars: DataFrame, k: int | None = None, size: float | None = None) -> DataFrame:
    """Average rank of volume per date, smallest first; ``size`` is the width of a bucket of volumes."""
    out = average_ranks(bars.select("code", "d", "v"), ["d"], "v", up="_r", size=size)
    return out.select("code", "d", cut("_r", k).alias("rv"))


def day_return(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Return against the calendar's previous date; missing if the code did not trade then."""
    b = bars.join(F.broadcast(calendar.select("d", "idx")), "d")
    near = F.lag("idx").over(W()) == F.col("idx") - 1
    return b.withColumn("ret", F.when(near, div("c", F.lag("c").over(W())) - 1))


def _ret_ranks(df: DataFrame, k: int | None) -> DataFrame:
    """Add ``_up`` and ``_down``: average ranks of ``ret`` per date, best and worst first.

    Every code of the date takes part, a missing return comes last on either side. With ``k`` the ``k`` highest
    returns take part, missing ones if there are fewer; the others have no rank, nor has any on the first date.
    """
    later = F.col("idx") > 1
    if k:
        order = [F.col("ret").desc_nulls_last(), F.col("code")]
        alike = F.when(F.col("ret").isNull(), letters(F.col("code"))).otherwise(F.lit(""))
        df = rank_within(df, ["d"], order, [steps(F.col("ret"), ascending=False), alike], "_place")
        inside = F.col("_place") <= k
        df = average_ranks(df.withColumn("_ret", F.when(inside, F.col("ret"))), ["d"], "_ret", up="_down", down="_up")
        return df.withColumns({n: F.when(inside & later, F.col(n)) for n in ("_up", "_down")})
    df = average_ranks(df, ["d"], "ret", up="_down", down="_up")
    return df.withColumns({n: F.when(later, F.col(n)) for n in ("_up", "_down")})


def rank_ret(bars: DataFrame, calendar: DataFrame, side: str = "up", k: int | None = None) -> DataFrame:
    """Average rank of the return per date, best first (or worst first for ``side='down'``).

    Codes without a return share the rank after the last. Infinite are ranks on the first date, which no
    return reaches, and with ``k`` those of codes outside the ``k`` highest returns.
    """
    out = _ret_ranks(day_return(bars.select("code", "d", "c"), calendar), k)
    return out.select("code", "d", cut("_up" if side == "up" else "_down", k).alias("r"))


def rank_match_coef(bars: DataFrame, calendar: DataFrame, k: int | None = None) -> DataFrame:
    """Match of price and volume ranks, 0 to 1: gainers should trade much, losers little.

    Volumes and returns are ranked along one lineage. Without ranks of returns, as on the first date, the
    product of ranks is infinite and the coefficient 0.
    """
    b = day_return(bars.select("code", "d", "c", "v"), calendar)
    out = _ret_ranks(average_ranks(b, ["d"], "v", up="_rv", total="_total"), k)
    n = F.lit(float(k)) if k else F.col("_total").cast("double")
    rv, r_up, r_dn = (cut(c, k) for c in ("_rv", "_up", "_down"))
    large = F.greatest(F.lit(1.0), n + 1 - rv)
    product = F.greatest(F.least(r_up * large, r_dn * rv), F.lit(1.0))
    return out.select("code", "d", F.least(F.greatest(n / product, F.lit(0.0)), F.lit(1.0)).alias("coef"))
