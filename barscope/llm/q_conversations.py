"""Query of conversation repair; the search has no SQL form, tests compare with all edits tried."""

from __future__ import annotations

from barscope.llm.common import query, table
from barscope.llm.conversations import repair


@query("op12_conversations")
def op12(spark, sf):
    return repair(table(spark, sf, "conversations"))
