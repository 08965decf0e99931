"""Rank aggregation over periods: hit counts and rank strength, for one window or every end date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barscope.functions.values import rnd
from barscope.operators.ranking import rank_within, steps, top_within


def time_weights(n: int, mode: str = "none", half_life: float = 5.0, linear_min: float = 0.3) -> list[float]:
    """Weights from oldest to newest with mean 1."""
    if mode in ("", "none"):
        raw = [1.0] * n
    elif mode.startswith("exp"):
        raw = [0.5 ** ((n - 1 - i) / max(half_life, 1e-6)) for i in range(n)]
    else:
        low = min(max(linear_min, 0.0), 1.0)
        raw = [low + (1.0 - low) * i / (n - 1) if n > 1 else low for i in range(n)]
    mean = sum(raw) / n if n else 0.0
    return [w / mean for w in raw] if mean > 0 else raw


def hit_counts(listed: DataFrame, min_hits: int, by: tuple[str, ...] = ()) -> DataFrame:
    """How often and from when to when a code was listed."""
    out = listed.groupBy(*by, "code").agg(
        F.count(F.lit(1)).alias("hits"), F.min("d").alias("first"), F.max("d").alias("last")
    )
    return out.where(F.col("hits") >= min_hits)


def rank_strength(weighted: DataFrame, min_hits: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted sum and mean of the rank's place in the cross-section (1 is the top).

    ``weighted`` has code, d, rank, total and the weight ``w`` of the date.
    """
    p = 1.0 - (F.col("rank") - 1.0) / F.col("total")
    out = weighted.groupBy(*by, "code").agg(
        F.sum(p * F.col("w")).alias("_s"),
        F.sum("w").alias("_w"),
        F.count(F.lit(1)).alias("hits"),
        F.min("rank").alias("best_rank"),
        F.max_by("rank", "d").alias("last_rank"),
        F.min("d").alias("first"),
        F.max("d").alias("last"),
    )
    out = out.where(F.col("hits") >= min_hits)
    return out.select(
        *by, "code", rnd("_s", 6).alias("strength"),
        rnd(F.col("_s") / F.greatest(F.col("_w"), F.lit(1e-9)), 6).alias("mean_strength"),
        "hits", "best_rank", "last_rank", "first", "last",
    )


def hits_order():
    return [F.col("hits").desc(), F.col("last").desc(), F.col("code")]


def strength_order():
    return [F.col("strength").desc(), F.col("last").desc(), F.col("best_rank"), F.col("code")]


def _weights(spark, values: list[float], name: str) -> DataFrame:
    return spark.createDataFrame([(i, w) for i, w in enumerate(values)], f"{name} int, w double")


def category_rank(ranks: DataFrame, span: DataFrame, mode: str = "strength", min_hits: int = 1,
                  top_n: int | None = None, top_m: int | None = None, weights: str = "none",
                  half_life: float = 5.0, linear_min: float = 0.3) -> DataFrame:
    """Aggregate the ranks of the span's dates into one list, whole or its first ``top_n`` places.

    Weights run over all dates of the span, with ranks or without.
    """
    from barscope.operators.calendar import trade_dates

    days = trade_dates(span)
    n = days.count()
    need = max(1, min(min_hits, n))
    inside = ranks.join(F.broadcast(days), "d")
    if mode == "hits":
        out = hit_counts(inside.where(F.col("rank") <= top_n) if top_n else inside, need).orderBy(*hits_order())
        return out.limit(top_n) if top_n else out
    if top_m:
        inside = inside.where(F.col("rank") <= top_m)
    w = _weights(ranks.sparkSession, time_weights(n, weights, half_life, linear_min), "_i")
    inside = inside.withColumn("_i", F.col("idx") - 1).join(F.broadcast(w), "_i")
    out = rank_strength(inside, need).orderBy(*strength_order())
    return out.limit(top_n) if top_n else out


def list_hits(lists: DataFrame, span: DataFrame, name: str = "white", min_hits: int = 1, top_n: int | None = None) -> DataFrame:
    """How often and from when to when a code was on the white or black list of the span's dates.

    ``lists`` has code, d and list, as ``sources.tables.read_list`` gives them: dates outside the span are not read. Each row counts.
    """
    from barscope.operators.calendar import trade_dates
    from barscope.sources.tables import LISTS

    if name not in LISTS:
        raise ValueError(f"unknown list {name!r}")
    days = trade_dates(span)
    need = max(1, min(min_hits, days.count()))  # dates of a span, as in category_rank
    inside = lists.where((F.col("list") == name) & F.col("code").isNotNull()).join(F.broadcast(days), "d")
    out = hit_counts(inside, need).orderBy(*hits_order())
    return out.limit(top_n) if top_n else out


def _decay(mode: str, half_life: float) -> float:
    return 0.5 ** (1.0 / max(half_life, 1e-6)) if mode.startswith("exp") else 1.0


def _rolled(rows: DataFrame, n: int, weights: str, half_life: float) -> DataFrame:
    """For each code the state of its window after every date on which a rank enters or leaves it.

    Rows have code, d, idx, rank, total. The sums are over the ranks in the window: of their places ``p``, of ones, and both again times
    the date's index (``pi``, ``i1``), all halved by age for exponential weights. ``until`` is the last index before the state changes.
    """
    q = _decay(weights, half_life)
    # Powers count from the start of blocks of n dates, so they stay in range; a window touches two blocks.
    place, block = F.col("idx") % n, F.floor(F.col("idx") / n)
    grown = F.pow(F.lit(1.0 / q), place.cast("double"))
    known = F.col("rank").isNotNull()
    p = F.when(known, 1.0 - (F.col("rank") - 1.0) / F.col("total"))
    # A rank enters at its date and leaves n dates later, both made from its row.
    kinds = dict(rows.dtypes)
    enters = F.struct("idx", "d", "rank", "total")
    leaves = F.struct((F.col("idx") + n).alias("idx"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("d", "rank", "total")])
    events = rows.select("code", F.inline(F.array(enters, leaves))).withColumns({"_p": p, "_one": F.when(known, F.lit(1.0)), "_g": grown, "_even": block % 2 == 0, "_place": place})
    line = Window.partitionBy("code").orderBy("idx")
    inside = line.rangeBetween(-(n - 1), 0)
    by_date = F.struct("d", "rank")
    events = events.withColumns({
        "hits": F.count("rank").over(inside), "best_rank": F.min("rank").over(inside),
        "_newest": F.max(F.when(known, by_date)).over(inside), "first": F.min("d").over(inside),
        **{f"_{name}_{side}": F.sum(F.when(F.col("_even") == (side == "even"), F.col(x) * F.col("_g") * (F.col("idx") if name in ("pi", "i1") else 1))).over(inside)
           for name, x in (("p", "_p"), ("one", "_one"), ("pi", "_p"), ("i1", "_one")) for side in ("even", "odd")
           if weights.startswith("linear") or name in ("p", "one")},
        "until": F.lead("idx").over(line) - 1,
    })
    events = events.where((F.col("until") >= F.col("idx")) & (F.col("hits") > 0))

    def total(name):
        # The own block's powers count from its start, the other block is the one before.
        here = F.when(F.col("_even"), F.col(f"_{name}_even")).otherwise(F.col(f"_{name}_odd"))
        past = F.when(F.col("_even"), F.col(f"_{name}_odd")).otherwise(F.col(f"_{name}_even"))
        age = F.col("_place").cast("double")
        return F.coalesce(here, F.lit(0.0)) * F.pow(F.lit(q), age) + F.coalesce(past, F.lit(0.0)) * F.pow(F.lit(q), age + n)

    names = ("p", "one", "pi", "i1") if weights.startswith("linear") else ("p", "one")
    return events.select(
        "code", "idx", "until", "hits", "best_rank", "first", F.col("_newest.d").alias("last"), F.col("_newest.rank").alias("last_rank"),
        *[total(x).alias(f"s_{x}") for x in names],
    )


def _weighted(state: DataFrame, n: int, weights: str, half_life: float, low: float) -> DataFrame:
    """Strength and mean strength of a state at end index ``e``: the window's weights have mean 1 over its ``span`` dates."""
    span, age = F.col("span").cast("double"), (F.col("e") - F.col("idx")).cast("double")
    if weights.startswith("exp"):
        q = _decay(weights, half_life)
        mean = (1.0 - F.pow(F.lit(q), span)) / ((1.0 - q) * span) if q < 1 else F.lit(1.0)
        scale = F.pow(F.lit(q), age) / mean
        s, w = F.col("s_p") * scale, F.col("s_one") * scale
    elif weights in ("", "none"):
        s, w = F.col("s_p"), F.col("s_one")
    else:
        low = min(max(low, 0.0), 1.0)
        # low + (1 - low) * (place in the window) / (span - 1), the place of index i being span - 1 - (e - i).
        step = F.when(span > 1, (1.0 - low) / (span - 1.0)).otherwise(F.lit(0.0))
        base = low + step * (span - 1.0 - F.col("e"))
        mean = F.when(span > 1, F.lit((1.0 + low) / 2.0)).otherwise(F.lit(low))
        flat = mean <= 0
        s, w = (F.when(flat, F.lit(0.0)).otherwise((base * F.col(x) + step * F.col(y)) / mean) for x, y in (("s_p", "s_pi"), ("s_one", "s_i1")))
    return state.withColumns({"strength": rnd(s, 6), "mean_strength": rnd(s / F.greatest(w, F.lit(1e-9)), 6)})


def category_rank_rolling(ranks: DataFrame, calendar: DataFrame, n: int, min_hits: int = 1,
                          top_n: int | None = None, top_m: int | None = None, mode: str = "strength",
                          weights: str = "none", half_life: float = 5.0, linear_min: float = 0.3) -> DataFrame:
    """The list of every end date over its last ``n`` trading days, with the place in the list.

    A rank counts from its date until it leaves the window. What a code's window holds only changes on these dates, so it is summed up there,
    in one pass over the code's ranks, and carried to the end dates in between; weights follow from the sums and the
    end date. Neither ranks nor weights are copied.
    """
    weights = weights or "none"
    if not weights.startswith("exp") and weights != "none":
        weights = "linear"
    limit = top_n if mode == "hits" else top_m
    rows = ranks.where(F.col("rank") <= limit) if limit else ranks
    days = calendar.select("d", "idx")  # one row per date
    state = _rolled(rows.select("code", "d", "rank", "total").join(F.broadcast(days), "d"), n, weights, half_life)
    need = F.greatest(F.lit(1), F.least(F.lit(min_hits), F.col("span")))
    state = state.withColumn("e", F.explode(F.sequence("idx", "until"))).withColumn("span", F.least(F.col("e"), F.lit(n)))
    state = state.where(F.col("hits") >= need)
    ends = days.select(F.col("d").alias("end_d"), F.col("idx").alias("e"))
    state = state.join(F.broadcast(ends), "e")
    if mode == "hits":
        out = state.select("end_d", "code", "hits", "first", "last")
        order, head = hits_order(), steps(F.col("hits"), 1, ascending=False)
    else:
        out = _weighted(state, n, weights, half_life, linear_min)
        out = out.select("end_d", "code", "strength", "mean_strength", "hits", "best_rank", "last_rank", "first", "last")
        order, head = strength_order(), steps(F.col("strength"), 0.25, ascending=False)
    if top_n:
        return top_within(out, ["end_d"], order, [head], top_n, "place")
    return rank_within(out, ["end_d"], order, [head], "place")


def category_codes(lists: DataFrame, ref) -> DataFrame:
    """Codes of the newest list that ends on or before the reference date."""
    ref = F.lit(ref).cast("date")
    past = lists.where(F.col("end_d") <= ref)
    newest = past.agg(F.max("end_d").alias("end_d"))
    return past.join(F.broadcast(newest), "end_d", "left_semi").select("end_d", "code")
