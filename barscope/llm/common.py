"""Helpers shared by the text operators: column expressions, the shared folder, the query registry.

Every operator first selects the columns it reads (``doc_id`` and ``text``), so further columns of any name
don't matter. A null text counts as empty. Rows keep their number: lookups by ``doc_id`` hold one row per id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barscope.plans.registry import Query
from barscope.session import scratch_path

QUERIES: dict[str, Query] = {}

# White space and words as the result contracts define them.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = Query(run, sql)
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(x: Column) -> Column:
    """A-Z lower-cased and nothing else; the quick ``lower`` says the same for texts that are all ASCII."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once per row.

    A lambda over a one-element array binds it. The optimizer would otherwise copy the expression into each use,
    above all into further lambdas, where it would run once per element; and a long chain of projections would
    make one generated method too large to be compiled.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fields(**cols: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in cols.items()])


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows from Parquet files in the shared folder, for results that several jobs read; in folders of their own by the columns ``by``."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FILTER_BITS = 1 << 23


def sifted(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be among the first column of ``ids``: all that are, and a few others.

    One bit of a filter of fixed size stands for each id, so at most ``FILTER_BITS / 64`` rows are broadcast
    whatever the number of ids. An exact join follows; what the filter holds back is not shuffled for it.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(FILTER_BITS))
    bits = ids.select(place(ids.columns[0]).alias("__p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("__p") % 64).cast("int"))
    bits = bits.groupBy(F.floor(F.col("__p") / 64).alias("__word")).agg(F.bit_or(one).alias("__bits"))
    rows = df.withColumn("__p", place(column)).join(F.broadcast(bits), F.floor(F.col("__p") / 64) == F.col("__word"))
    return rows.where(F.call_function("getbit", F.col("__bits"), (F.col("__p") % 64).cast("int")) == 1).select(*df.columns)


def crc_mod(n: int) -> Column:
    """Remainder of the CRC-32 of the id's decimal text."""
    return F.crc32(F.col("doc_id").cast("string")) % n
