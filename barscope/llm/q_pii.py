"""Query of surrogates for personal data; tests compare with a plain program."""

from __future__ import annotations

from pyspark.sql import functions as F

from barscope.llm.common import query, table
from barscope.llm.pii import replaced


@query("op9_pii")
def op9(spark, sf):
    d = replaced(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("__n_entities").alias("n_entities"), "text")
