"""Query of near-duplicate classes; tests compare with all pairs."""

from __future__ import annotations

from barscope.llm.common import query, table
from barscope.llm.minhash import near_duplicates


@query("op1_minhash")
def op1(spark, sf):
    return near_duplicates(table(spark, sf, "documents"))
