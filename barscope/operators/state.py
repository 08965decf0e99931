"""Indicators carried on from a stored state, without the history.

The state has one row per code: how many bars there were, the last date, the newest bars (as many as the longest warm-up), and
for each average its value, the total weight behind it and how long ago its last input was. An average over all earlier bars
enters the next batch as one input with that weight, so the averages of the new bars equal those of the full run, whatever
the size of the batches. Work and reads grow with the batch and its codes, not with what came before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscope.functions.series import W
from barscope.functions.smoothing import Ewm, block_size, place, smooth
from barscope.functions.values import rnd
from barscope.operators.indicators import REGISTRY
from barscope.session import written_once

BUCKETS = 64


def bucket(code: str = "code", n: int = BUCKETS) -> Column:
    """Partition column of a stored state."""
    return F.pmod(F.xxhash64(code), F.lit(n)).cast("int")


def _averages(names: Sequence[str]) -> list[Ewm]:
    return [a for n in names for a in (*REGISTRY[n].first, *REGISTRY[n].second)]


def _seed(a: Ewm) -> str:
    return f"seed{a.out}"


def _with_ring(state: DataFrame | None, batch: DataFrame, averages: Sequence[Ewm]) -> DataFrame:
    """The batch's bars after the newest stored ones of their codes; the seeds lie in the last stored bar."""
    new = batch.withColumns({"_new": F.lit(True), "_tail": F.lit(False), "_shift": F.lit(None).cast("long")})
    new = new.withColumns({_seed(a): F.lit(None).cast("struct<y: double, wt: double, lag: bigint>") for a in averages})
    if state is None:
        return new
    own = state.join(batch.select("code").distinct(), "code", "left_semi")
    bars = own.select("code", "n", F.size("ring").alias("_len"), *[_seed(a) for a in averages], F.posexplode("ring").alias("_pos", "_bar"))
    tail = F.col("_pos") == F.col("_len") - 1
    old = bars.select(
        "code", *[F.col(f"_bar.{c}") for c in batch.columns if c != "code"], F.lit(False).alias("_new"), tail.alias("_tail"),
        (F.col("n") - F.col("_len")).alias("_shift"), *[F.when(tail, F.col(_seed(a))).alias(_seed(a)) for a in averages],
    )
    both = old.unionByName(new)
    whole = Window.partitionBy("code")
    both = both.withColumn("_last", F.max(F.when(~F.col("_new"), F.col("d"))).over(whole))
    return both.where(~F.col("_new") | F.col("_last").isNull() | (F.col("d") > F.col("_last"))).drop("_last")


def _inputs(averages: Sequence[Ewm]) -> dict[str, Column]:
    """Input, weight and lag of each average: stored bars count only through the seed."""
    out = {}
    for a in averages:
        seed = F.col(_seed(a))
        out[f"_in_{a.out}"] = F.when(F.col("_new"), F.col(a.x)).otherwise(seed["y"])
        out[f"_wt_{a.out}"] = F.coalesce(seed["wt"], F.lit(1.0))
        out[f"_lag_{a.out}"] = F.coalesce(seed["lag"], F.lit(0).cast("long"))
    return out


def _with_seeds(rows: DataFrame, averages: Sequence[Ewm]) -> DataFrame:
    """The state of each average as a column of a code's last row, missing in all others."""
    back, whole = F.col("_end") - F.col("_rn"), Window.partitionBy("code")
    found, seeds = {}, {}
    for a in averages:
        seen = F.col(f"_in_{a.out}").isNotNull()
        left = F.pow(F.lit(1.0 - a.alpha), back.cast("double")) * F.col(f"_wt_{a.out}")
        last = F.max_by(F.struct(F.col(a.out).alias("y"), (back + F.col(f"_lag_{a.out}")).alias("lag")), F.when(seen, F.col("_rn")))
        found[f"_found{a.out}"] = last.over(whole)
        if a.adjust:
            found[f"_left{a.out}"] = F.sum(F.when(seen, left)).over(whole)
        last = F.col(f"_found{a.out}")
        # Seeded recursions start each bar anew with weight 1, decayed since the last input.
        weight = F.col(f"_left{a.out}") if a.adjust else F.pow(F.lit(1.0 - a.alpha), last["lag"].cast("double"))
        seed = F.struct(last["y"].alias("y"), weight.alias("wt"), last["lag"].alias("lag"))
        seeds[f"_next{a.out}"] = F.when((back == 0) & last.isNotNull(), seed)
    return rows.withColumns(found).withColumns(seeds) if averages else rows


def _new_state(rows: DataFrame, columns: Sequence[str], averages: Sequence[Ewm], depth: int) -> DataFrame:
    """One row per code of the rows, which are its newest stored bars and all later ones."""
    bar = F.struct("d", *[c for c in columns if c not in ("code", "d")])
    late = F.col("_end") - F.col("_rn") < depth
    return rows.groupBy("code").agg(
        F.max(F.col("_at") + 1).alias("n"), F.max("d").alias("d"), F.sort_array(F.collect_list(F.when(late, bar))).alias("ring"),
        *[F.first(f"_next{a.out}", ignorenulls=True).alias(_seed(a)) for a in averages],
    )


def advance(state: DataFrame | None, batch: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Indicators of the batch's bars, and the new state of the batch's codes.

    ``state`` is what earlier calls gave, None at first (the batch may be a whole history then). Bars that are not later than
    the state of their code are left out: see ``late`` and ``rebuild``.
    """
    chosen = [REGISTRY[n] for n in names]
    averages, outs = _averages(names), {i.out for i in chosen}
    batch = batch.select(*[c for c in batch.columns if c not in outs])
    depth = max(1, *[i.warmup for i in chosen])
    size = block_size(averages)
    out = _with_ring(state, batch, averages)
    early = {n: fn() for i in chosen for n, fn in i.inputs.items()}
    early |= {f"_raw_{i.out}": i.value() for i in chosen if not i.first}
    out = place(out.withColumns(early) if early else out, size)
    for level in ("first", "second"):
        step = [a for i in chosen for a in getattr(i, level)]
        if step:
            out = smooth(out.withColumns(_inputs(step)), [replace(a, x=f"_in_{a.out}") for a in step], size, seeded=True)
    first = F.first("_shift", ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumns({"_at": F.col("_rn") + F.coalesce(first, F.lit(0)), "_end": F.max("_rn").over(Window.partitionBy("code"))})
    values = {i.out: F.when(F.col("_at") >= i.warmup, rnd(i.value() if i.first else F.col(f"_raw_{i.out}"), i.decimals)) for i in chosen}
    kept = [f"_next{a.out}" for a in averages]
    # Values and state both read these rows; what the state takes of the averages lies in a code's last row.
    out = _with_seeds(out, averages)
    rows = written_once(out.select(*batch.columns, "_new", "_rn", "_at", "_end", *kept, *[e.alias(n) for n, e in values.items()]))
    return rows.where("_new").select(*batch.columns, *values), _new_state(rows, batch.columns, averages, depth)


def late(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The codes of the batch with bars the state has already passed, and the first date of these."""
    passed = batch.join(state.select("code", F.col("d").alias("_last")), "code").where(F.col("d") <= F.col("_last"))
    return passed.groupBy("code").agg(F.min("d").alias("since"))


def rebuild(history: DataFrame, codes: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Values from ``since`` on and new states of some codes, from their whole corrected histories."""
    values, state = advance(None, history.join(codes.select("code"), "code", "left_semi"), names)
    return values.join(codes, "code").where(F.col("d") >= F.col("since")).drop("since"), state
