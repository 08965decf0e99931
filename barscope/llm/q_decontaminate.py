"""Query of benchmark decontamination; tests compare with all windows."""

from __future__ import annotations

from barscope.llm.common import query, table
from barscope.llm.decontaminate import contaminated


@query("op3_decontaminate")
def op3(spark, sf):
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
