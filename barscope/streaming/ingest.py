"""Increments of whole trading days, taken up as files arrive.

Each micro-batch is deduplicated and written to a partition of its own, so a batch that is retried
after a failure replaces what it wrote before.  Where batches overlap, the later one counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from barscope.operators.clean import keep_last
from barscope.operators.state import advance, bucket, late, rebuild
from barscope.session import passing, written_once
from barscope.sources import store


def stream_days(spark: SparkSession, landing: str, schema, table: str, checkpoint: str) -> StreamingQuery:
    """Take up all files waiting in ``landing`` and stop."""

    def take(batch: DataFrame, number: int) -> None:
        rows = keep_last(batch, ["code", "d"], "seq").drop("seq")
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        spark.readStream.schema(schema)
        .parquet(landing)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_days(spark: SparkSession, table: str) -> DataFrame:
    """The ingested bars, one row per code and date."""
    rows = spark.read.parquet(table)
    return keep_last(rows, ["code", "d"], "batch").drop("batch")


def take_batch(batch: DataFrame, number: int, root: str, names: Sequence[str]) -> None:
    """Put a batch of bars, unique by code and date, into the stored bars, indicator values and states below ``root``.

    What it writes for itself is gone afterwards.

    New bars go on from the state of their codes, no history is read. A code with a bar that the state has already passed is
    computed anew from its stored bars. The state is committed last and notes the batch's number: a batch that is
    retried is skipped if that was done, and otherwise does the same again.
    """
    spark = batch.sparkSession
    bars, values, states = (f"{root.rstrip('/')}/{n}" for n in ("bars", "values", "states"))
    known = store.current(spark, states)
    if known.notes.get("batch", -1) >= number:
        return
    with passing(spark):
        _take(batch, number, (bars, values, states), known, names)


def _take(batch: DataFrame, number: int, roots: tuple[str, str, str], known: store.State, names: Sequence[str]) -> None:
    spark = batch.sparkSession
    bars, values, states = roots
    rows = written_once(batch.withColumn("ym", store.month()))
    store.put_stable(rows, bars, ["code", "d"], "ym")
    if not known.version:
        out, new = advance(None, rows, names)
    else:
        old = store.read(spark, states, known).drop("bucket")
        again = written_once(late(old, rows))
        out, new = advance(old, rows.join(again, "code", "left_anti").select(*rows.columns), names)
        if not again.isEmpty():
            redone, fresh = rebuild(store.read(spark, bars), again, names)
            out, new = out.unionByName(redone), new.unionByName(fresh)
    store.put_stable(out, values, ["code", "d"], "ym")  # read from the rows that ``advance`` has written
    store.put(new.withColumn("bucket", bucket()), states, ["code"], "bucket", {"batch": number})


def stream_indicators(spark: SparkSession, landing: str, schema, root: str, names: Sequence[str], checkpoint: str,
                      files: int | None = None) -> StreamingQuery:
    """Take up all files waiting in ``landing``, ``files`` at a time, and carry the indicators on."""

    def take(batch: DataFrame, number: int) -> None:
        take_batch(keep_last(batch, ["code", "d"], "seq").drop("seq"), number, root, names)

    source = spark.readStream.schema(schema)
    if files:
        source = source.option("maxFilesPerTrigger", files)
    return (
        source.parquet(landing)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_values(spark: SparkSession, root: str) -> DataFrame:
    """The stored bars' indicators."""
    return store.read(spark, f"{root.rstrip('/')}/values").drop("ym")
