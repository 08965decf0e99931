"""Query of cross-tokenizer alignment; SQL cannot encode texts, tests compare with a plain program."""

from __future__ import annotations

from barscope.llm.alignment import align
from barscope.llm.common import query, table
from barscope.llm.q_bpe import vocabulary


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op11_alignment")
def op11(spark, sf):
    return align(table(spark, sf, "documents"), vocabulary(), piece_model())
