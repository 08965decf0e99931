"""Line deduplication with levelled sorted runs of line hashes.

A run holds the keys of lines seen so far, each with the first document that has it, sorted by key. A batch
of documents takes these steps: its own keys are reduced to one row each, those that some run already holds
are removed by a merge anti-join, the rest becomes a new run of level 0. When a level has ``fanout`` runs
they are merged into one of the next level, so there are logarithmically few, and adding n batches rewrites
each key a logarithmic number of times. Runs are Parquet folders under the store's folder; one that is listed
is complete, and a lost executor costs a task, not a run.

Batches come in ascending order of doc_id, so the first holder of a key is the smallest doc_id that has it.
A line whose key an earlier document holds is dropped; the first document keeps all its lines with that key.

A key is the line without white space at both ends and with A-Z in lower case; shorter keys than
``MIN_KEY`` code points are never dropped. Keys are compared by 128 bits of hash. Null or empty text is one empty
line. Rows that share a doc_id are one document; rows with a null doc_id keep all lines. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barscope.llm.common import SPACE_CHARS, let, lower_ascii, text_of
from barscope.session import scratch_path

MIN_KEY = 10
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE_CHARS)))


def _hash(line: Column) -> Column:
    """128 bits of a key; null for keys too short to count."""
    both = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))
    return let(line_key(line), lambda k: F.when(F.length(k) >= MIN_KEY, both(k)))


def line_keys(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, h1, h2) of the lines that count."""
    keys = F.array_distinct(F.array_compact(F.transform(F.split(text_of(), "\n"), _hash)))
    return docs.where("doc_id IS NOT NULL").select("doc_id", F.inline(keys))


class LineRuns:
    """The runs in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 4):
        self.spark, self.folder, self.fanout = spark, folder or scratch_path(spark, "line-runs"), fanout
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def _write(self, level: int, rows: DataFrame) -> None:
        self.made += 1
        path = f"{self.folder}/level{level}-{self.made}"
        rows.sortWithinPartitions(*KEY).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def runs(self) -> DataFrame:
        paths = [p for level in self.levels for p in level]
        schema = "h1 bigint, h2 bigint, first bigint"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _compact(self) -> None:
        for level, paths in enumerate(self.levels):
            if len(paths) >= self.fanout:
                merged = self.spark.read.schema("h1 bigint, h2 bigint, first bigint").parquet(*paths)
                self.levels[level] = []
                self._write(level + 1, merged.repartitionByRange(*KEY))

    def add(self, keys: DataFrame) -> None:
        """Take up a batch's keys; its doc_ids lie above all earlier ones."""
        own = keys.groupBy(*KEY).agg(F.min("doc_id").alias("first"))
        self._write(0, own.join(self.runs().hint("merge"), KEY, "left_anti"))
        self._compact()

    def repeated(self, keys: DataFrame) -> DataFrame:
        """Per doc_id the hashes of lines that an earlier document holds."""
        known = self.runs()
        late = keys.join(known.hint("merge"), KEY).where("doc_id <> first")
        return late.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("__late"))


def _batches(docs: DataFrame, n: int) -> list[Column]:
    """Conditions that cut the ids at their quantiles, so that an outlying id takes no batch for itself."""
    shares = F.array(*[F.lit(k / n) for k in range(1, n)])
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] or [])) if n > 1 else []
    above = [F.lit(True), *[F.col("doc_id") > c for c in cuts]]
    upto = [*[F.col("doc_id") <= c for c in cuts], F.col("doc_id").isNotNull()]
    return [a & b for a, b in zip(above, upto)]


def dedup_lines(docs: DataFrame, batches: int = 4) -> DataFrame:
    """All columns of ``docs``, ``text`` without its late lines, plus ``__n_lines`` and ``__n_dropped``."""
    runs = LineRuns(docs.sparkSession)
    late = None
    for part in _batches(docs, batches):
        path = scratch_path(docs.sparkSession, "line-keys")
        line_keys(docs.where(part)).write.parquet(path)
        keys = docs.sparkSession.read.schema("doc_id bigint, h1 bigint, h2 bigint").parquet(path)
        runs.add(keys)
        late = keys if late is None else late.unionByName(keys)
    late = runs.repeated(late).withColumnRenamed("doc_id", "__id")
    lines = F.split(text_of(), "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("__late", _hash(x)), F.lit(False)))
    d = docs.join(late, F.col("doc_id") == F.col("__id"), "left")
    d = d.withColumns({"__n_lines": F.size(lines).cast("long"), "__kept": F.when(F.col("__late").isNotNull(), kept)})
    dropped = F.coalesce(F.when(F.col("__kept").isNotNull(), F.col("__n_lines") - F.size("__kept")), F.lit(0))
    text = F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col("text"))
    d = d.withColumns({"__n_dropped": dropped.cast("long"), "text": text})
    return d.select(*docs.columns, "__n_lines", "__n_dropped")
