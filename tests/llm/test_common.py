"""Helpers shared by the operators."""

from pyspark.sql import functions as F

from barscope.llm import common


def test_sifted_keeps_all_that_are_there(spark, monkeypatch):
    rows = spark.range(-500, 2000).withColumn("word", F.lit("x")).withColumnRenamed("id", "doc_id")
    ids = spark.createDataFrame([(i,) for i in range(-400, 1900, 37)] * 2, "doc_id long")
    for bits in (1 << 23, 64):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        got = common.sifted(rows, "doc_id", ids)
        kept = {r.doc_id for r in got.collect()}
        assert got.columns == rows.columns and set(range(-400, 1900, 37)) <= kept and got.count() == len(kept)
    assert common.sifted(rows, "doc_id", ids.limit(0)).count() == 0


def test_lower_case_of_ascii_only(spark):
    df = spark.createDataFrame([("AbZ",), ("ÉAbΣ",), ("",), (None,)], "x string").coalesce(1)
    assert [r.y for r in df.select(common.lower_ascii(F.col("x")).alias("y")).collect()] == ["abz", "ÉabΣ", "", None]


def test_written_rows_are_the_same(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    assert sorted(map(tuple, common.written(df, "w").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
