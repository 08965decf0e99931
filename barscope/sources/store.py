"""Stored tables with atomic commits: copy-on-write of the touched partitions and a manifest of current folders.

Every commit writes a folder of its own, ``root/commit=<id>/<part>=<value>``, and then one manifest that names, for each
partition, the folder holding it now. Readers take the newest manifest and the folders it names, so they see a commit
whole or not at all; what a lost job has written is named by nobody. Manifests are numbered, and one is put in place by a
rename that fails if its number is taken: of two writers that started from the same state, the second one is refused and
may try again. Untouched partitions are neither read nor written.

A manifest has one entry per partition value, so partition by something bounded, as months or buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barscope.operators.clean import pick
from barscope.session import written_once
from barscope.sources import tables


class Conflict(RuntimeError):
    """Another writer has committed since this one read the table."""


@dataclass(frozen=True)
class State:
    """What a manifest says: the folders by partition value, the columns, and notes such as the last batch."""

    version: int = 0
    schema: str = ""
    part: str = ""
    keys: tuple[str, ...] = ()
    folders: dict[str, str] = field(default_factory=dict)
    notes: dict[str, int] = field(default_factory=dict)


class Files:
    """The few file operations needed, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(self.path("")).toUri(), conf)
        self.once = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_once(self, name: str, text: str) -> bool:
        """Write a file whole, or not at all if there is one of this name."""
        draft = f"_drafts/{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        try:
            self.context.rename(self.fs.makeQualified(self.path(draft)), self.fs.makeQualified(self.path(name)), self.once)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True


def _manifest(version: int) -> str:
    return f"_manifests/{version:010d}.json"


def current(spark: SparkSession, root: str) -> State:
    """The newest state of a table; version 0 where there is none yet."""
    files = Files(spark, root)
    names = files.names("_manifests")
    return _load(files, max(names)) if names else State()


def _load(files: Files, name: str) -> State:
    got = json.loads(files.read(f"_manifests/{name}"))
    return State(**{**got, "keys": tuple(got["keys"])})


def _rows(spark: SparkSession, root: str, state: State, values: Sequence[str] | None = None) -> DataFrame:
    """Rows of a state, of some partitions only if ``values`` are given."""
    chosen = state.folders if values is None else {v: state.folders[v] for v in values if v in state.folders}
    schema = StructType.fromJson(json.loads(state.schema))
    if not chosen:
        return spark.createDataFrame([], schema).where(F.lit(False))  # seen by the optimizer, so nothing is joined to it
    base = root.rstrip("/")
    # The partition column comes from the folders' names.
    stored = spark.read.option("basePath", base).schema(schema).parquet(*[f"{base}/{f}" for f in sorted(chosen.values())])
    return stored.select(*schema.names)


def read(spark: SparkSession, root: str, state: State | None = None) -> DataFrame:
    """The table as of its newest commit, or of a ``state`` read before; filters on the partition column prune folders."""
    state = state or current(spark, root)
    if not state.version:
        raise FileNotFoundError(f"no table at {root}")
    return _rows(spark, root, state)


def stage(rows: DataFrame, root: str, old: State, touched: Sequence[str], notes: dict[str, int] | None = None) -> State:
    """Write the rows of the touched partitions to a folder of their own; nobody sees them before ``publish``."""
    spark = rows.sparkSession
    files, folder = Files(spark, root), f"commit={uuid.uuid4().hex}"
    rows.hint("rebalance", old.part).write.partitionBy(old.part).parquet(f"{root.rstrip('/')}/{folder}")
    written = [n for n in files.names(folder) if n.startswith(f"{old.part}=")]
    folders = {k: v for k, v in old.folders.items() if k not in set(touched)}
    folders |= {n.split("=", 1)[1]: f"{folder}/{n}" for n in written}
    return State(old.version + 1, old.schema, old.part, old.keys, folders, {**old.notes, **(notes or {})})


def publish(spark: SparkSession, root: str, state: State) -> State:
    """Make a staged state the newest one, unless another writer has taken its number."""
    if not Files(spark, root).put_once(_manifest(state.version), json.dumps(state.__dict__)):
        raise Conflict(f"version {state.version} of {root} was committed by another writer")
    return state


def _by_part(df: DataFrame, part: str) -> DataFrame:
    if "commit" in df.columns or part not in df.columns:
        raise ValueError(f"a stored table needs its partition column {part!r} and no column 'commit'")
    return df


def create(df: DataFrame, root: str, keys: Sequence[str], part: str, notes: dict[str, int] | None = None) -> State:
    """A new table of unique ``keys``, partitioned by the integer or text column ``part``, a function of the keys without nulls."""
    _by_part(df, part)
    if current(df.sparkSession, root).version:
        raise Conflict(f"there is a table at {root}")
    empty = State(0, df.schema.json(), part, tuple(keys))
    return publish(df.sparkSession, root, stage(df, root, empty, [], notes))


def change(updates: DataFrame, root: str, make: Callable[[DataFrame, DataFrame], DataFrame], notes: dict[str, int] | None = None,
           tries: int = 3, stable: bool = False, apart: bool = False) -> State:
    """Replace the partitions that ``updates`` touch by ``make(old rows of these partitions, updates)``.

    The updates are written once, so what is read, merged and named is the same also if their source changes; ``stable`` ones
    come from files that nobody changes and are not written again. With ``apart`` a partition's rows depend on its own updates alone, and those of
    partitions that the table doesn't have yet are made without a look at the others. A writer that was overtaken starts again from the newer state; after ``tries`` it gives up, with the table as the others left it.
    """
    spark = updates.sparkSession
    state = current(spark, root)
    if not state.version:
        raise FileNotFoundError(f"no table at {root}")
    fixed = _by_part(updates, state.part)
    fixed = fixed if stable else written_once(fixed)
    # One value per touched partition; as many as the manifest may name.
    touched = [r[0] for r in fixed.select(F.col(state.part).cast("string")).distinct().collect()]
    if None in touched:
        raise ValueError(f"null in the partition column {state.part!r}")
    for _ in range(tries):
        state = current(spark, root)
        names, held = StructType.fromJson(json.loads(state.schema)).names, [v for v in touched if v in state.folders]
        if apart and 0 < len(held) < len(touched):
            known = F.col(state.part).cast("string").isin(held)
            out = make(_rows(spark, root, state, held), fixed.where(known)).select(*names)
            out = out.unionByName(make(_rows(spark, root, state, []), fixed.where(~known)).select(*names))
        else:
            out = make(_rows(spark, root, state, touched), fixed).select(*names)
        try:
            return publish(spark, root, stage(out, root, state, touched, notes))
        except Conflict as e:
            lost = e
    raise lost


def upsert(updates: DataFrame, root: str, notes: dict[str, int] | None = None, order: str | None = None, stable: bool = False) -> State:
    """Update the supplied columns of rows with a stored key (a supplied null counts), insert the others.

    Columns the table doesn't have are left out; with key columns only, stored rows stay as they are. A key that comes twice
    is refused, unless ``order`` names the column whose largest value tells which of its rows counts.
    """
    keys = list(current(updates.sparkSession, root).keys)
    if order is not None:
        updates = pick(updates, keys, order).drop(order)

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        if order is None and not new.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"updates of {root} hold a key twice")
        return tables.upsert(old, new, keys)

    return change(updates, root, merge, notes, stable=stable, apart=True)


def put(updates: DataFrame, root: str, keys: Sequence[str], part: str, notes: dict[str, int] | None = None) -> State:
    """Upsert, into a table that is created first if there is none."""
    if current(updates.sparkSession, root).version:
        return upsert(updates, root, notes)
    return create(updates, root, keys, part, notes)


def put_stable(updates: DataFrame, root: str, keys: Sequence[str], part: str) -> State:
    """The same for rows that come from files which nobody changes, so they are not written once more."""
    if current(updates.sparkSession, root).version:
        return upsert(updates, root, stable=True)
    return create(updates, root, keys, part)


def replace_days(rows: DataFrame, root: str, by: str = "d", notes: dict[str, int] | None = None) -> State:
    """Rows of some dates replace all stored rows of these dates; other dates stay."""

    def put(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select(by).distinct(), by, "left_anti").unionByName(new.select(*old.columns))

    return change(rows, root, put, notes)


def append(rows: DataFrame, root: str, notes: dict[str, int] | None = None) -> State:
    """Insert rows with new keys; rows with a stored key are left out, so a repeated append changes nothing."""
    keys = list(current(rows.sparkSession, root).keys)

    def add(old: DataFrame, new: DataFrame) -> DataFrame:
        fresh = new.join(old.select(*keys), keys, "left_anti")
        return old.unionByName(fresh, allowMissingColumns=True).select(*old.columns)

    return change(rows, root, add, notes)


def leftovers(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Commit folders that none of the newest ``keep`` manifests names: replaced partitions and lost jobs.

    A job that is still running has such a folder too, so remove them only while nobody writes.
    """
    files = Files(spark, root)
    newest = sorted(files.names("_manifests"))[-keep:]
    named = {f.split("/")[0] for n in newest for f in _load(files, n).folders.values()}
    return sorted(n for n in files.names("") if n.startswith("commit=") and n not in named)


def month(d: str = "d") -> Column:
    """The usual partition column of bars and ranks."""
    return tables.month_of(F.col(d))
