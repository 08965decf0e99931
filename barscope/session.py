"""Session helpers: local sessions for tests and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def local_session(cpus: str = "8", app: str = "barscope") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        # A rule set compiles to more classes than the default cache holds.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # Plans have thousands of columns built from Python; call sites are not recorded for each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        # One partition per core: window work is CPU-bound long before a partition is large.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only where the cluster names none (a local test session) is a temporary folder taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="barscope-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder, for results that several steps read.

    Unlike a cache this survives the loss of executors. Files are columnar and compressed, so readers take what they select.
    """
    path = scratch_path(df.sparkSession, "rows")
    if _passing.get() is not None:
        _passing.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``written_once`` writes inside is deleted at the end, and shuffle files as soon as the query that wrote them has ended.

    For steps that store what they make: nothing that reads those files may be used afterwards.
    """
    paths, before = [], spark.conf.get(SHUFFLES, None)
    token = _passing.set(paths)
    spark.conf.set(SHUFFLES, "true")
    try:
        yield
    finally:
        _passing.reset(token)
        if before is None:
            spark.conf.unset(SHUFFLES)
        else:
            spark.conf.set(SHUFFLES, before)
        for path in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
