"""Rule hits against forward returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barscope.functions.scopes import PER_BAR, parse_scope
from barscope.functions.series import W
from barscope.functions.values import div
from barscope.operators.clean import join_hits_prices
from barscope.operators.ranking import letters, rank_within
from barscope.operators.rules import Rule, evaluate
from barscope.session import written_once

RULE_SCHEMA = (
    "array<struct<name:string,scope:string,timeframe:string,score_windows:int,period:string,"
    "points:double,ok:boolean,cnt:int,add:double,hit_date:string,hit_dates:array<string>,hit_count:int>>"
)
MIN_ROWS = 100  # fixed value: fewer samples are refused
TASK_ROWS = 1 << 18  # rows of a fit in a task, some hundred bytes each once unpacked


def to_rules_json(details: DataFrame) -> DataFrame:
    """Rule records of a code and date as JSON text, in rule order (at most one per rule)."""
    fields = ["name", "scope", "timeframe", "score_windows", "period", "points", "ok", "cnt", "add"]
    record = F.struct(
        "pos", *fields, F.date_format("hit_date", "yyyyMMdd").alias("hit_date"),
        F.transform("hit_dates", lambda x: F.date_format(x, "yyyyMMdd")).alias("hit_dates"), "hit_count",
    )
    rows = F.array_sort(F.collect_list(record))
    return details.groupBy("code", "d").agg(
        F.to_json(F.transform(rows, lambda x: x.dropFields("pos"))).alias("rules")
    )


def parse_rules(df: DataFrame) -> DataFrame:
    """Stored JSON text back to one row per rule."""
    out = df.withColumn("_r", F.explode(F.from_json("rules", RULE_SCHEMA)))
    return out.select("code", "d", "_r.*")


def rule_hits(details: DataFrame) -> DataFrame:
    """Hits as (rule, code, d, add); takes records or their JSON text."""
    rows = parse_rules(details) if "rules" in details.columns else details
    add = F.coalesce("add", "points", F.lit(0.0))
    return rows.where("ok").select(F.coalesce("name", F.lit("unknown")).alias("rule"), "code", "d", add.alias("add"))


def forward_returns(bars: DataFrame, horizons: Sequence[int], log: bool = False) -> DataFrame:
    """Return from each bar's close to the close ``h`` bars later."""
    def ret(h):
        ratio = div(F.lead("c", h).over(W()), "c")
        return F.log(ratio) if log else ratio - 1.0

    return bars.select("code", "d", *[ret(h).alias(f"ret_{h}d") for h in horizons])


def keep_frequent(hits: DataFrame, min_hits: int) -> DataFrame:
    """Hits of rules with at least ``min_hits`` hits."""
    often = hits.groupBy("rule").count().where(F.col("count") >= min_hits)
    # One row per rule, so the kept names are broadcast.
    return hits.join(F.broadcast(often.select("rule")), "rule", "left_semi")


def rule_features(hits: DataFrame, rules: Sequence[str], *more) -> DataFrame:
    """One column per rule with its summed add, zero where it did not hit.

    The rules are known, so this is one aggregation of conditional sums.
    """
    sums = [
        F.coalesce(F.sum(F.when(F.col("rule") == n, F.col("add"))), F.lit(0.0)).alias(n) for n in rules
    ]
    return hits.groupBy("code", "d").agg(*sums, *more)


def rule_dataset(hits: DataFrame, bars: DataFrame, rules: Sequence[str], horizons: Sequence[int], target: int,
                 min_hits: int = 1, log: bool = False) -> DataFrame:
    """Feature rows with their label ``target``; rows without a label are dropped."""
    name = f"ret_{target}d"
    merged = join_hits_prices(hits, forward_returns(bars, horizons, log).select("code", "d", name))
    # Read twice: once to count the rules, once to keep the frequent ones.
    merged = written_once(merged)
    feat = rule_features(keep_frequent(merged, min_hits), rules, F.max(name).alias("target"))
    return feat.where(F.col("target").isNotNull())


def rule_dataset_in_row(bars: DataFrame, rules: Sequence[Rule], features, target: int, min_hits: int = 1,
                        log: bool = False) -> DataFrame:
    """The same rows as ``rule_dataset`` straight from the bars: one column per rule, and ``target``.

    Adds and forward returns lie in the row of their bar, so nothing is exploded, joined or written; the hits of each
    rule are counted in one row, which is joined to all.
    """
    seen = evaluate(bars, rules, features)
    ahead = F.lead("c", target).over(W()) / F.nullif(F.col("c"), F.lit(0.0))
    seen = seen.withColumn("target", F.log(ahead) if log else ahead - 1.0)
    hits = {}
    for i, r in enumerate(rules):
        hit = F.col(f"r{i}_cnt") > 0 if parse_scope(r.scope)[0] in PER_BAR else F.col(f"r{i}_add") != 0
        hits[r.name] = F.when(hit, F.col(f"r{i}_add"))
    own = seen.select("code", "d", "target", *[h.alias(n) for n, h in hits.items()])
    counts = own.agg(F.struct(*[F.count(n).alias(n) for n in hits]).alias("_hits"))
    one = F.lit(1).alias("_one")
    own = own.select("*", one).join(F.broadcast(counts.select("*", one)), "_one")
    kept = {n: F.when(F.col(f"_hits.{n}") >= min_hits, F.col(n)) for n in hits}
    own = own.select("code", "d", "target", *[c.alias(n) for n, c in kept.items()])
    some = F.coalesce(*[F.col(n) for n in hits]).isNotNull()
    return own.where(some & F.col("target").isNotNull()).na.fill(0.0, list(hits)).select("code", "d", *hits, "target")


def require_rows(df: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """Refuse a dataset too small to learn from."""
    if df.limit(least).count() < least:
        raise ValueError(f"fewer than {least} samples")
    return df


def time_position(df: DataFrame, prefix: int = 7) -> DataFrame:
    """0-based place by (d, code) over the whole table, and the number of rows.

    The rows before a date come from counts per date; only the place within a date is ranked.
    """
    days = df.groupBy("d").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumns({
        "_before": F.coalesce(before, F.lit(0)),
        "n": F.sum("_n").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    placed = rank_within(df, ["d"], [F.col("code")], [letters(F.col("code"), prefix)], "_k")
    out = placed.join(F.broadcast(days.drop("_n")), "d")
    return out.withColumn("pos", F.col("_before") + F.col("_k") - 1).drop("_before", "_k")


def split_time(df: DataFrame, ratio: float = 0.2, prefix: int = 7) -> DataFrame:
    """Mark rows as train or test by time: the newest ``ratio`` of rows is the test part."""
    out = time_position(df, prefix)
    cut = F.floor(F.col("n") * F.lit(1.0 - ratio))
    part = F.when(F.col("pos") < cut, F.lit("train")).otherwise(F.lit("test"))
    return out.withColumn("part", part).drop("pos", "n")


def split_folds(df: DataFrame, ratio: float, folds: int) -> DataFrame:
    """Expanding folds: each trailing test block with all rows before it as its train part."""
    out = time_position(df)
    k = max(1, folds)
    size = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(ratio)))
    marks = []
    for i in range(k):
        end = F.col("n") - (k - 1 - i) * size
        start = end - size
        part = F.when(F.col("pos") < start, F.lit("train")).when(F.col("pos") < end, F.lit("test"))
        marks.append(F.when((start > 0) & part.isNotNull(), F.struct(F.lit(i).alias("fold"), part.alias("part"))))
    out = out.withColumn("_m", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())))
    return out.select(*[c for c in out.columns if c not in ("pos", "n", "_m")], "_m.fold", "_m.part")


def spread(df: DataFrame, most: int) -> DataFrame:
    """The rows in tasks of about ``most`` rows at most; where the files already give that, as they are.

    Feature rows compress to a few bytes, so a task would read files of tens of millions of them, which a fit unpacks and keeps.
    """
    tasks = -(-df.count() // most)
    return df if tasks <= df.rdd.getNumPartitions() else df.repartition(tasks)


def best_round(losses: Sequence[float], patience: int | None) -> int:
    """The round with the smallest loss before ``patience`` rounds have gone by without a smaller one; without patience the last."""
    if not patience:
        return len(losses) - 1
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best


def rule_model(train: DataFrame, test: DataFrame, rules: Sequence[str], rounds: int = 50, patience: int | None = 20, depth: int = 5,
               rate: float = 0.05, rows: float = 0.8, columns: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Boosted trees over the rules: gains by rule, and one row of metrics of the best round.

    The test part's loss after each round tells the best one, stopping early after ``patience`` rounds without a better one; as
    later trees don't change earlier ones, a fit of that many rounds with the same seed is the stopped model. ``rows`` are drawn for
    each tree, ``columns`` for each node. The first tree counts whole, later ones by ``rate``.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    pack = VectorAssembler(inputCols=list(rules), outputCol="features")
    packed = [written_once(pack.transform(part).select("features", F.col("target").cast("double").alias("target"))) for part in (train, test)]
    packed = [spread(part, TASK_ROWS) for part in packed]

    def fit(n: int):
        return GBTRegressor(labelCol="target", maxDepth=depth, stepSize=rate, subsamplingRate=rows, featureSubsetStrategy="all" if columns >= 1 else str(columns),
                            maxIter=n, seed=seed).fit(packed[0])

    model = fit(rounds)
    best = best_round(model.evaluateEachIteration(packed[1], "squared"), patience)
    if best + 1 < rounds:
        model = fit(best + 1)
    error = F.col("prediction") - F.col("target")

    def measures(part: str, df: DataFrame) -> DataFrame:
        return model.transform(df).agg(
            F.sqrt(F.avg(error * error)).alias(f"{part}_rmse"), F.avg(F.abs(error)).alias(f"{part}_mae"), F.avg("prediction").alias(f"{part}_mean"),
            F.avg("target").alias(f"{part}_target"), F.count(F.lit(1)).alias(f"{part}_size"))

    one = F.lit(1).alias("_one")
    metrics = measures("train", packed[0]).select("*", one).join(measures("test", packed[1]).select("*", one), "_one").drop("_one")
    gains = [(n, float(g)) for n, g in zip(rules, model.featureImportances.toArray())]
    return train.sparkSession.createDataFrame(gains, "rule string, gain double"), metrics.withColumn("best_round", F.lit(best))


def rule_importance(train: DataFrame, test: DataFrame, rules: Sequence[str], rounds: int = 50,
                    seed: int = 42, **options) -> DataFrame:
    """Gain importance of each rule from boosted trees, with the errors and means of the best round."""
    gains, metrics = rule_model(train, test, rules, rounds, seed=seed, **options)
    named = metrics.withColumnsRenamed({"test_rmse": "rmse", "test_mae": "mae"})
    return gains.withColumn("_one", F.lit(1)).join(F.broadcast(named.withColumn("_one", F.lit(1))), "_one").drop("_one")
