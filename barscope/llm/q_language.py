"""Query of language identification; held-out accuracy is tested."""

from __future__ import annotations

from pyspark.sql import functions as F

from barscope.llm.common import crc_mod, query, table
from barscope.llm.language import fit, predict


@query("op5_language")
def op5(spark, sf):
    docs = table(spark, sf, "documents")
    out = predict(docs, fit(docs, crc_mod(4) != 2))
    return out.withColumn("held_out", crc_mod(4) == 2).select("doc_id", "held_out", "lang_pred", "score")
