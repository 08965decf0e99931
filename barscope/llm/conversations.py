"""Repair of the turn structure of conversations by branch and bound.

A conversation is well formed if its roles are ``(system? (user assistant)+)?``. Rows can be kept, given another role, or deleted, and empty rows
can be inserted, each at a cost; the cheapest edits are asked for, of equally cheap ones those whose letters (``D I K R``) come first.

The search is depth first with an explicit stack over nodes (row, state), where the state is what the last role left open. A node is
left if its cost and the lower bound of the rows behind it exceed the incumbents (cost, letters) of all ways out, or if
the node's dominance table knows a better prefix: a prefix that costs more, or as much with later letters, can't win, as any ending fits
both (two equally cheap prefixes over the same rows are never one the beginning of the other). When the stack is empty the
incumbents are optimal.

Rows are sorted by range of (conversation, place), so one long conversation is spread over many tasks. Each task cuts its rows into segments of
at most ``SEGMENT`` and searches each from every state it may begin in to every state it may end in. A conversation's segments, some
hundred times fewer than its rows, are then joined in order with the same dominance rule. What all surviving prefixes have in
common is settled as it goes, so what a task holds is one batch. The digest of the repaired text has to pass over the text in order by
its nature; it does so row by row, without holding them.

Rows of the same turn are taken in order of role and of their text's MD5, copies adjacent. Null conversation ids form one conversation; a null turn comes
first; a null role or text is one space. Extra columns don't matter; an empty table gives an empty result; repeated rows are duplicates like any
others; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscope.llm.common import written

SEGMENT = 64
# Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# What the last role left open: nothing yet, a system row, a user row, a whole pair.
START, SYSTEM, USER, PAIR = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (PAIR, "u"): USER, (USER, "a"): PAIR}
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), PAIR: ("u", USER), USER: ("a", PAIR)}
WHOLE = (START, PAIR)
INF = 1 << 60
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after seeded damage, with their place; dropped rows stay, marked ``gone``.

    ``fate`` is the remainder of the CRC-32 of ``conv_id:turn``: a row is dropped, emptied, stripped of its sentence ends, doubled, or
    made the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    text = F.when(F.col("_fate") == 1, F.lit("")).when(F.col("_fate") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    out = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("_role"), space("text").alias("_text"), fate.alias("_fate"))
    return out.select(
        "conv", "turn", F.concat_ws(":", "_role", F.md5("_text")).alias("tie"),
        F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        F.when(F.col("_fate") == 4, F.lit("user")).otherwise(F.col("_role")).alias("role"),
        text.alias("text"), (F.col("_fate") == 0).alias("gone"),
    )


def _outline(rows: DataFrame) -> DataFrame:
    """Rows without their text: identity, blank, and whether the last sign ends a sentence."""
    visible = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    return rows.select(
        "conv", "turn", "tie", "copy", F.substring("role", 1, 1).alias("initial"),
        F.unhex(F.md5(F.concat_ws("\x00", "role", "text"))).alias("same"), "gone",
        (visible == "").alias("blank"), (~F.substring(visible, -1, 1).isin(".", "!", "?")).alias("open"),
    )


def _with_duplicates(outline: DataFrame) -> DataFrame:
    """Marks rows whose role and text an earlier row of the conversation has."""
    place = F.struct("turn", "tie", "copy")
    often = outline.where("NOT gone").groupBy("conv", "same").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    often = often.where("_n > 1").select(F.col("conv").alias("_c"), F.col("same").alias("_s"), "_first")
    both = outline.join(often, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("same") == F.col("_s")), "left")
    late = F.coalesce(~place.eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.lit(False))
    return both.withColumn("dup", late).drop("_c", "_s", "_first")


def search(rows, starts=(START,), ends=WHOLE):
    """Cheapest edits of ``rows`` (initial, must be deleted, truncated) from each start to each end: {(start, end): (cost, letters)}."""
    n = len(rows)
    bound = [0] * (n + 1)  # the least that the rows from here on cost, each on its own
    for i in range(n - 1, -1, -1):
        initial, must, cut = rows[i]
        bound[i] = bound[i + 1] + (DELETE if must or cut else 0 if initial in ("s", "u", "a") else REROLE)
    out = {}
    for start in starts:
        best = {e: (INF, "") for e in ends}
        seen: dict[tuple[int, int], tuple[int, str]] = {}
        stack = [(0, start, 0, "")]
        while stack:
            i, state, cost, letters = stack.pop()
            known = seen.get((i, state))
            if known is not None and known <= (cost, letters):
                continue
            if cost + bound[i] > max(b[0] for b in best.values()):
                continue
            seen[i, state] = (cost, letters)
            if i == n and state in best and (cost, letters) < best[state]:
                best[state] = (cost, letters)
            # Pushed last is tried first: keeping, then a new role, deletion, insertion.
            role, to = NEXT[state]
            stack.append((i, to, cost + INSERT, letters + "I"))
            if i < n:
                initial, must, cut = rows[i]
                stack.append((i + 1, state, cost + DELETE, letters + "D"))
                if not must:
                    more = TRUNCATED if cut else 0
                    stack.append((i + 1, to, cost + REROLE + more, letters + "R"))
                    kept = STEP.get((state, initial))
                    if kept is not None:
                        stack.append((i + 1, kept, cost + more, letters + "K"))
        out |= {(start, e): b for e, b in best.items() if b[0] < INF}
    return out


SEGMENTS = (
    "conv {conv}, part int, seq long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, ways array<struct<start: int, end: int, cost: long, letters: string>>"
)


def _segment(conv, part, seq, rows, starts, ends):
    """One segment's counts and searched ways; a row is (turn, initial, gone, blank, dup, open)."""
    live = [r for r in rows if not r[2]]
    turns = [r[0] for r in live if r[0] is not None]
    initials = [r[1] for r in live]
    blank = sum(r[3] for r in live)
    dup = sum(r[4] and not r[3] for r in live)
    cut = [r[5] and not (r[3] or r[4]) for r in live]
    found = search([(r[1], r[3] or r[4], c) for r, c in zip(live, cut)], starts, ends)
    return {
        "conv": conv, "part": part, "seq": seq, "n": len(live), "blank": blank, "duplicate": dup, "truncated": sum(cut),
        "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
        "first": initials[0] if live else None, "last": initials[-1] if live else None,
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
        "ways": [{"start": s, "end": e, "cost": c, "letters": a} for (s, e), (c, a) in sorted(found.items())],
    }


def _segments(schema):
    def run(batches):
        from pyspark import TaskContext

        part, seq, conv, rows, alone, whole, before = TaskContext.get().partitionId(), 0, None, None, False, True, None
        everything = range(4)
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv", "tie", "copy", "turn", "initial", "gone", "blank", "dup", "open")]
            for c, tie, copy, *row in zip(*columns):
                # Rows alike in all of these lie side by side; those after the first are duplicates.
                place = (c, row[0], tie, copy)
                row[4] |= place == before
                before = place
                if rows is not None and c != conv:
                    # The conversation ends here; it began here too unless it is the first of the task.
                    out.append(_segment(conv, part, seq, rows, (START,) if alone and whole else everything, WHOLE if alone else everything))
                    seq, rows, alone, whole = seq + 1, None, True, True
                elif rows is not None and len(rows) >= SEGMENT:
                    out.append(_segment(conv, part, seq, rows, (START,) if alone and whole else everything, everything))
                    seq, rows, whole = seq + 1, [], False
                if rows is None:
                    conv, rows = c, []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if rows is not None:
            yield pa.RecordBatch.from_pylist([_segment(conv, part, seq, rows, (START,) if alone and whole else everything, everything)], schema)

    return run


class Repair:
    """A conversation's segments joined so far."""

    def __init__(self, conv):
        self.conv = conv
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.cost = 0
        self.last = self.low = self.high = None
        self.settled, self.open = [], {START: (0, "")}

    def add(self, s):
        if s["n"] and self.n:
            self.illegal += self.last + s["first"] not in ("su", "ua", "au")
        if s["n"]:
            self.last = s["last"]
        for c in ("n", "blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, c, getattr(self, c) + s[c])
        if s["low"] is not None:
            self.turns -= self.high == s["low"]
            self.low, self.high = s["low"] if self.low is None else self.low, s["high"]
        best = {}
        for w in s["ways"]:
            if w["start"] in self.open:
                cost, letters = self.open[w["start"]]
                way = (cost + w["cost"], letters + w["letters"])
                if way < best.get(w["end"], (INF, "")):
                    best[w["end"]] = way
        # What all ways have in common is settled.
        words = [a for _, a in best.values()]
        low, high = min(words), max(words)
        same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        self.settled.append(low[:same])
        self.open = {e: (c, a[same:]) for e, (c, a) in best.items()}

    def result(self):
        cost, letters = min(self.open[e] for e in WHOLE if e in self.open)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {
            "conv": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "cost": cost, "audit": "".join(self.settled) + letters,
        }


REPAIRS = "conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _joined(schema):
    def run(batches):
        now = None
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                if now is None or s["conv"] != now.conv:
                    if now is not None:
                        out.append(now.result())
                    now = Repair(s["conv"])
                now.add(s)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.result()], schema)

    return run


def _digests(schema):
    """Rows of a conversation follow the row with its edits; one batch is held at a time."""

    def run(batches):
        edits = None
        for batch in batches:
            out = []
            for conv, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text"))):
                if kind == 0:
                    if edits is not None:
                        out.append(edits.done())
                    edits = _Edits(conv, text)
                else:
                    edits.row(role, text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if edits is not None:
            yield pa.RecordBatch.from_pylist([edits.done()], schema)

    return run


class _Edits:
    """Edits applied to rows as they come, and the digest of what comes out."""

    def __init__(self, conv, letters):
        self.conv, self.letters, self.at, self.state, self.hash, self.sep = conv, letters, 0, START, hashlib.sha256(), b""

    def _put(self, role, text):
        self.hash.update(self.sep + f"{role}:{text}".encode())
        self.sep = b"\n"

    def _inserts(self):
        while self.letters[self.at : self.at + 1] == "I":
            initial, self.state = NEXT[self.state]
            self._put(NAMES[initial], "")
            self.at += 1

    def row(self, role, text):
        self._inserts()
        x = self.letters[self.at]
        self.at += 1
        if x == "K":
            self.state = STEP[self.state, role[:1]]
            self._put(role, text)
        elif x == "R":
            initial, self.state = NEXT[self.state]
            self._put(NAMES[initial], text)

    def done(self):
        self._inserts()
        return {"conv": self.conv, "repaired_sha256": self.hash.hexdigest()}


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def repairs(rows: DataFrame) -> DataFrame:
    """Faults, cost and edits of every conversation of damaged ``rows``."""
    spark, kind = rows.sparkSession, rows.schema["conv"].dataType.simpleString()
    place = ["conv", F.col("turn").asc_nulls_first(), "tie", "copy"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = _with_duplicates(_outline(rows)).select("conv", "turn", "tie", "copy", "initial", "gone", "blank", "dup", "open")
    lines = lines.repartitionByRange(parts, *place).sortWithinPartitions(*place)
    ddl = SEGMENTS.format(conv=kind)
    segments = lines.mapInArrow(_segments(_arrow(ddl)), ddl)
    segments = segments.repartition(parts, "conv").sortWithinPartitions("conv", "part", "seq")
    ddl = REPAIRS.format(conv=kind)
    return segments.mapInArrow(_joined(_arrow(ddl)), ddl)


def repair(conversations: DataFrame, damage=damaged) -> DataFrame:
    """Per conversation: faults of its rows after damage, cost and letters of the cheapest edits, digest of the repaired text."""
    rows = damage(conversations)
    kind = rows.schema["conv"].dataType.simpleString()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(repairs(rows), "repairs")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("tie", "string"), ("copy", "int"), ("role", "string"))]
    heads = found.select("conv", F.lit(0).alias("kind"), *none, F.col("audit").alias("text"))
    lines = rows.where("NOT gone").select("conv", F.lit(1).alias("kind"), "turn", "tie", "copy", "role", "text")
    order = ["conv", "kind", F.col("turn").asc_nulls_first(), "tie", "copy"]
    lines = heads.unionByName(lines).repartition(parts, "conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text")
    ddl = f"conv {kind}, repaired_sha256 string"
    digests = lines.mapInArrow(_digests(_arrow(ddl)), ddl).withColumnRenamed("conv", "_c")
    return found.join(digests, F.col("conv").eqNullSafe(F.col("_c"))).select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
