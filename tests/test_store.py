"""Stored tables: commits are seen whole or not at all, and only touched partitions are written."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barscope.session import scratch_path
from barscope.sources import store

SCHEMA = "code string, d date, c double, v double, ym int"


def row(code, d, c, v):
    d = dt.date.fromisoformat(d)
    return code, d, c, v, d.year * 100 + d.month


def rows(df):
    return sorted((r.code, str(r.d), r.c, r.v) for r in df.collect())


@pytest.fixture
def table(spark):
    root = scratch_path(spark, "stored")
    first = [row("a", "2024-01-02", 1.0, 10.0), row("b", "2024-01-02", 2.0, 20.0), row("a", "2024-02-01", 3.0, 30.0)]
    store.create(spark.createDataFrame(first, SCHEMA), root, ["code", "d"], "ym")
    return root


def test_upsert_updates_given_columns_and_inserts(spark, table):
    new = spark.createDataFrame([("a", dt.date(2024, 1, 2), None, 202401), ("c", dt.date(2024, 3, 1), 5.0, 202403)], "code string, d date, v double, ym int")
    before = store.current(spark, table)
    after = store.upsert(new, table)
    assert rows(store.read(spark, table)) == [
        ("a", "2024-01-02", 1.0, None), ("a", "2024-02-01", 3.0, 30.0), ("b", "2024-01-02", 2.0, 20.0), ("c", "2024-03-01", None, 5.0)]
    assert after.version == before.version + 1
    assert after.folders["202402"] == before.folders["202402"] and after.folders["202401"] != before.folders["202401"]
    # A reader that holds the older state still sees it.
    assert len(rows(store.read(spark, table, before))) == 3


def test_keys_only_and_unknown_columns(spark, table):
    new = spark.createDataFrame([row("a", "2024-01-02", 0.0, 0.0), row("z", "2024-01-03", 0.0, 0.0)], SCHEMA).select("code", "d", "ym", F.lit(1).alias("other"))
    store.upsert(new, table)
    assert rows(store.read(spark, table)) == [
        ("a", "2024-01-02", 1.0, 10.0), ("a", "2024-02-01", 3.0, 30.0), ("b", "2024-01-02", 2.0, 20.0), ("z", "2024-01-03", None, None)]


def test_a_broken_write_leaves_the_old_state(spark, table):
    before, want = store.current(spark, table), rows(store.read(spark, table))
    new = spark.createDataFrame([row("a", "2024-01-02", 9.0, 9.0), row("b", "2024-02-02", 9.0, 9.0)], SCHEMA)

    def broken(old, updates):
        fail = F.when(F.col("code") == "b", F.raise_error(F.lit("lost"))).otherwise(F.lit(0.0))
        return updates.withColumn("c", F.col("c") + fail.cast("double"))

    with pytest.raises(Exception, match="lost"):
        store.change(new, table, broken)
    assert store.current(spark, table) == before and rows(store.read(spark, table)) == want
    store.upsert(new, table)
    assert ("a", "2024-01-02", 9.0, 9.0) in rows(store.read(spark, table))


def test_a_write_that_ends_before_its_manifest_is_not_seen(spark, table, monkeypatch):
    want = rows(store.read(spark, table))
    new = spark.createDataFrame([row("a", "2024-01-02", 9.0, 9.0)], SCHEMA)

    def gone(self, name, text):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(store.Files, "put_once", gone)
        with pytest.raises(RuntimeError, match="driver lost"):
            store.upsert(new, table)
    assert rows(store.read(spark, table)) == want
    assert len(store.leftovers(spark, table)) == 1


def test_an_overtaken_writer_starts_again(spark, table):
    other = spark.createDataFrame([row("b", "2024-01-02", 7.0, 7.0)], SCHEMA)
    mine = spark.createDataFrame([row("a", "2024-01-02", 9.0, 9.0)], SCHEMA)
    calls = []

    def merge(old, new):
        if not calls:
            store.upsert(other, table)
        calls.append(1)
        return store.tables.upsert(old, new, ["code", "d"])

    state = store.change(mine, table, merge)
    assert len(calls) == 2 and state.version == 3
    assert rows(store.read(spark, table))[::2] == [("a", "2024-01-02", 9.0, 9.0), ("b", "2024-01-02", 7.0, 7.0)]
    with pytest.raises(store.Conflict):
        store.create(other, table, ["code", "d"], "ym")


def test_append_and_replace_days(spark, table):
    more = spark.createDataFrame([row("a", "2024-01-02", 9.0, 9.0), row("c", "2024-01-02", 4.0, 4.0)], SCHEMA)
    for _ in range(2):
        store.append(more, table)
    assert rows(store.read(spark, table)) == [
        ("a", "2024-01-02", 1.0, 10.0), ("a", "2024-02-01", 3.0, 30.0), ("b", "2024-01-02", 2.0, 20.0), ("c", "2024-01-02", 4.0, 4.0)]
    store.replace_days(more.where("code = 'c'"), table)
    assert rows(store.read(spark, table)) == [("a", "2024-02-01", 3.0, 30.0), ("c", "2024-01-02", 4.0, 4.0)]


def test_odd_updates(spark, table):
    before = store.current(spark, table)
    none = spark.createDataFrame([], SCHEMA)
    assert store.upsert(none, table).folders == before.folders
    twice = spark.createDataFrame([row("a", "2024-01-02", 1.0, 1.0), row("a", "2024-01-02", 2.0, 2.0)], SCHEMA)
    with pytest.raises(ValueError, match="twice"):
        store.upsert(twice, table)
    store.upsert(twice.withColumn("seq", F.col("c")), table, order="seq")
    assert rows(store.read(spark, table))[0] == ("a", "2024-01-02", 2.0, 2.0)
    with pytest.raises(ValueError, match="null"):
        store.upsert(spark.createDataFrame([("a", None, 1.0, 1.0, None)], SCHEMA), table)
    with pytest.raises(FileNotFoundError):
        store.read(spark, table + "-none")


def test_an_empty_table_and_pruning(spark):
    root = scratch_path(spark, "stored")
    store.create(spark.createDataFrame([], SCHEMA), root, ["code", "d"], "ym")
    assert rows(store.read(spark, root)) == []
    store.upsert(spark.createDataFrame([row("a", "2024-01-02", 1.0, 1.0), row("a", "2024-02-02", 2.0, 2.0)], SCHEMA), root, {"batch": 4})
    assert store.current(spark, root).notes == {"batch": 4}
    january = store.read(spark, root).where("ym = 202401")
    assert rows(january) == [("a", "2024-01-02", 1.0, 1.0)]
    plan = january._jdf.queryExecution().explainString(january._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(ym" in plan
