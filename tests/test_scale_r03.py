"""What the third round's findings asked for: work that is done once, and what nobody reads is not done."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barscope.functions import series
from barscope.operators import benchmark, clean, research
from barscope.operators.ranking import previous
from barscope.operators.rules import Clause, Rule, evaluate, rule_details
from barscope.session import written_once
from barscope.sources import tables

RULES = (
    Rule("up", "c > o", 2, window=3, scope="ANY"), Rule("each", "c > 2", 1, window=2, scope="EACH"),
    Rule("week", "c > o", 3, timeframe="W", window=1, scope="LAST"),
    Rule("both", None, 4, clauses=(Clause("c > 2", window=1, scope="LAST"), Clause("c > o", "W", 2, "ANY"))),
)


def _bars(spark):
    rows = [(code, dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0 + i % 3, float(i % 5)) for code in "ab" for i in range(12)]
    return spark.createDataFrame(rows, "code string, d date, o double, c double")


def test_details_compute_only_what_is_read(spark):
    out = rule_details(evaluate(_bars(spark), RULES, dates=True), RULES)
    plan = out.select("code", "d", "name", "add")._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" not in plan and "collect_list" not in plan


def test_details_hold_the_fields_of_each_rule(spark):
    seen = evaluate(_bars(spark), RULES, dates=True)
    all_rows = rule_details(seen, RULES, hits_only=False).collect()
    assert len(all_rows) == 24 * len(RULES) and {r.pos for r in all_rows} == {0, 1, 2, 3}
    by = {(r.code, r.d, r.name): r for r in all_rows}
    for x in seen.collect():
        for i, rule in enumerate(RULES):
            r = by[x.code, x.d, rule.name]
            assert (r.ok, r.add, r.period) == (x[f"r{i}_ok"], x[f"r{i}_add"], x[f"r{i}_label"])
            stored = x[f"r{i}_dates"] if rule.scope in ("ANY", "EACH") else [x.d]
            assert r.hit_dates == (stored if r.ok else []) and r.hit_count == len(r.hit_dates)
    hits = rule_details(seen, RULES).collect()
    assert sorted((r.code, r.d, r.pos) for r in hits) == sorted((r.code, r.d, r.pos) for r in all_rows if r.ok)


def test_a_folder_is_written_without_a_shuffle(spark, tmp_path):
    root = str(tmp_path / "bars")
    for value in ("raw", "qfq"):
        path = tables.write_folder(spark.range(3).withColumn("adj_type", F.lit(value)), root, "adj_type", value)
        assert path == f"{root}/adj_type={value}"
    tables.write_folder(spark.range(0), root, "adj_type", "ind")
    got = spark.read.parquet(root).groupBy("adj_type").count().collect()
    assert {tuple(r) for r in got} == {("raw", 3), ("qfq", 3)}


def test_added_ranks_are_computed_once(spark, tmp_path):
    path, seen = str(tmp_path / "ranks"), spark.sparkContext.accumulator(0)
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    ranks = spark.createDataFrame([("a", d, 1) for d in days], "code string, d date, rank int")
    tables.write_ranks(ranks, path)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x + 6

    tables.add_ranks(ranks.where(F.col("d") == F.lit(days[1])).withColumn("rank", counted.asNondeterministic()("rank")), path)
    assert seen.value == 1
    assert {(r.d, r.rank) for r in tables.read_ranks(spark, path).collect()} == {(days[0], 1), (days[1], 7)}


def test_rows_written_once_lie_in_columnar_files(spark):
    df = spark.range(5).withColumn("x", F.when(F.col("id") > 2, F.array(F.col("id"))))
    out = written_once(df)
    assert out.inputFiles() and out.dtypes == df.dtypes and sorted(out.collect()) == sorted(df.collect())
    empty = written_once(df.where("id < 0"))
    assert empty.dtypes == df.dtypes and empty.count() == 0


def test_a_fit_has_a_bounded_number_of_rows_in_a_task(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor

    sizes, fit = [], GBTRegressor.fit
    monkeypatch.setattr(research, "TASK_ROWS", 50)
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df: sizes.append(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) or fit(self, df))
    df = spark.range(1000).select((F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("target")).coalesce(1)
    _, metrics = research.rule_model(df, df.limit(100), ["a"], rounds=1, depth=1, rows=1.0, columns=1.0)
    assert sum(sizes[0]) == 1000 and max(sizes[0]) <= 100 and metrics.first()["train_size"] == 1000


def test_rows_that_lie_in_enough_tasks_stay_there(spark):
    df = spark.range(100, numPartitions=4)
    assert research.spread(df, 25) is df and research.spread(df.where("id < 0"), 25).count() == 0
    assert research.spread(df, 10).rdd.getNumPartitions() == 10


def test_toxicity_takes_some_text_at_a_time():
    import pyarrow as pa

    from barscope.llm import toxicity

    texts = [f"w{i} " * 150_000 for i in range(8)]
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string()), "toxic": pa.array([i % 2 for i in range(8)], pa.int32())})
    parts = list(toxicity._term_classes([batch]))
    assert len(parts) >= 3
    assert sum(sum(p.column("pos").to_pylist()) for p in parts) == sum(sum(p.column("neg").to_pylist()) for p in parts) == 4


def test_benchmark_features_add_no_whole_window_per_bar(spark):
    bars = _bars(spark)
    bench = bars.where("code = 'a'").select("d", "c")
    for out in (benchmark.benchmark_features(bars, bench), benchmark.several_benchmarks(bars, {"x": bench, "y": bench.where("c > 1")}, how="drop")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "specifiedwindowframe(RowFrame, -19," not in plan and "lag(" in plan


@pytest.mark.parametrize("n", [1, 2, 7, 20])
def test_merged_sums_are_those_of_each_window(spark, n):
    """Codes of other lengths, missing values, a column that does not change, and one infinite value that must leave again."""
    rng, rows = random.Random(4), []
    for code, size in (("a", 1), ("b", 19), ("c", 70)):
        for i in range(size):
            y = None if i == 30 else 0.1 if i > 32 else rng.uniform(-1, 1)
            rows.append((code, dt.date(2024, 1, 1) + dt.timedelta(i), rng.uniform(-1, 1) if i != 5 else None, y, float("inf") if i == 25 else float(i)))
    df = spark.createDataFrame(rows, "code string, d date, x double, y double, z double")
    sums = {"s": F.coalesce("x", F.lit(0.0)), "k": F.col("x").isNotNull().cast("int"), "sz": F.col("z")}
    got = series.merged_sums(df, n, sums, {"xx": ("x", "x"), "yy": ("y", "y"), "xy": ("x", "y")}).orderBy("code", "d").collect()
    assert len(got) == len(rows) and got[0].__fields__ == [*df.columns, *sums, "xx", "yy", "xy"]
    for r in got:
        own = [q for q in rows if q[0] == r.code and r.d - dt.timedelta(n) < q[1] <= r.d]
        x = [q[2] for q in own if q[2] is not None]
        assert r.k == len(x) and r.s == pytest.approx(sum(x)) and r.sz == pytest.approx(sum(q[4] for q in own))
        for value, i, j in ((r.xx, 2, 2), (r.yy, 3, 3), (r.xy, 2, 3)):
            pairs = [(q[i], q[j]) for q in own if q[i] is not None and q[j] is not None]
            if len(pairs) < n:
                assert value is None
            else:
                a, b = (sum(p) / n for p in zip(*pairs))
                want = sum((p - a) * (q - b) for p, q in pairs)
                assert value == 0 if len({q[3] for q in own}) == 1 and j == 3 else value == pytest.approx(want, abs=1e-12)


def test_index_bars_take_one_shuffle_and_no_join(spark):
    rows = [("a", "20240103", 7, "3"), ("a", "20240102", 1, "1"), ("a", "x", 5, "2"), ("a", "20240102", 3, "1.5"), ("b", "20240102", 9, "4"), (None, "20240102", 4, "5")]
    out = clean.clean_index_bars(spark.createDataFrame(rows, "code string, d string, seq long, c string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and plan.count("gettimestamp") == 1
    got = {(r.code, r.d.day): (r.c, r.pre_close, r.change) for r in out.collect()}
    assert got == {("a", 2): (1.5, 1.0, 0.5), ("a", 3): (3.0, 2.0, 1.0), ("b", 2): (4.0, None, None)}


@pytest.mark.parametrize("size", [1, 60, 10_000])
def test_previous_row_whatever_the_order_is_worth(spark, size):
    """Orders far apart, below zero and missing; a code with few rows, one with many, rows without code, and copies of rows."""
    rng = random.Random(3)
    orders = rng.sample(range(-10**14, 10**14), 500)
    rows = [("few" if i % 50 == 0 else None if i % 50 == 1 else "many", x, float(i) if i % 9 else None) for i, x in enumerate(orders)]
    df = spark.createDataFrame([*rows, *rows[::3], ("many", None, -1.0)], "code string, seq long, c double").repartition(5)
    want, last = {}, {}
    for code, seq, c in [*sorted((r for r in rows if r[0]), key=lambda r: r[1]), ("many", None, -1.0)]:
        want[code, seq], last[code] = last.get(code), c
    got = previous(df, "code", "seq", "c", size, ["c"])
    assert got.columns == [*df.columns, "_previous"] and got.count() == df.where("code IS NOT NULL").count()
    assert all(r._previous == want[r.code, r.seq] for r in got.collect())
