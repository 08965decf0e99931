"""Query of language-model scoring; a sampler has no SQL form, tests check its base columns, that probabilities sum to one, and perplexity."""

from __future__ import annotations

from barscope.llm.common import crc_mod, query, table
from barscope.llm.lm import fit_and_score


@query("op13_lm_score")
def op13(spark, sf):
    return fit_and_score(table(spark, sf, "documents"), crc_mod(7) != 2)
