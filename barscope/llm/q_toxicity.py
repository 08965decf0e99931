"""Query of toxicity scores; held-out accuracy is tested."""

from __future__ import annotations

from pyspark.sql import functions as F

from barscope.llm.common import crc_mod, query, table
from barscope.llm.toxicity import fit, score


@query("op4_toxicity")
def op4(spark, sf):
    docs = table(spark, sf, "documents")
    out = score(docs, fit(docs, table(spark, sf, "labels"), crc_mod(5) != 0))
    return out.select(
        "doc_id", (crc_mod(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence", "similarities",
    )
