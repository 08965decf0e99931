"""Concept membership of codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscope.functions.values import filter_concepts
from barscope.operators.clean import join_map


def concept_rollup(members: DataFrame) -> DataFrame:
    """Per code the sorted distinct concept codes and names, and the first stock name by ``seq``.

    Sets combine map-side and are bounded by the number of concepts.
    """
    def joined(name):
        return F.array_join(F.array_sort(F.collect_set(name)), ",")

    return members.groupBy("code").agg(
        joined("concept_code").alias("concepts_code"),
        joined("concept_name").alias("concepts_name"),
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("stock_name"),
    )


def concept_map(manual: DataFrame, a: DataFrame, b: DataFrame, blacklist: Sequence[str] = (),
                mode: str = "mix", manual_wins: bool = False) -> DataFrame:
    """Code to filtered concept text.

    Provider ``a`` overwrites manual entries (unless ``manual_wins``); in mix mode provider ``b``
    fills codes still without text.  Within manual entries and the first source the row with the largest ``seq`` wins,
    within the second the one with the smallest.
    """
    first, second = (2, 1) if manual_wins else (1, 2)
    sources = [(manual, first), (a if mode != "b" else b, second)]
    if mode == "mix":
        sources.append((b, 0))
    rows = None
    for df, prio in sources:
        text = filter_concepts("concepts", blacklist)
        seq = F.col("seq").cast("long") if "seq" in df.columns else F.lit(0).cast("long")
        part = df.select("code", text.alias("concepts"), F.lit(prio).alias("prio"), (seq if prio else -seq).alias("seq"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where(F.col("concepts").isNotNull() & (F.col("code") != ""))
    return rows.groupBy("code").agg(F.max_by("concepts", F.struct("prio", "seq", "concepts")).alias("concepts"))


def dedupe_concepts(df: DataFrame) -> DataFrame:
    """One row per code: non-empty concepts first, then the earliest ``seq``."""
    text = F.coalesce("concepts_name", F.lit(""))
    rest = [c for c in df.columns if c != "code"]
    first = F.min_by(F.struct(*rest), F.struct((F.trim(text) == "").alias("e"), F.col("seq")))
    out = df.withColumn("concepts_name", text).groupBy("code").agg(first.alias("_r"))
    return out.select("code", "_r.*").select(*df.columns)


def add_concepts(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Concept text of each row's code, empty where there is none."""
    return join_map(df, mapping, "code", "concepts")
