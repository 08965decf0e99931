"""Query of BPE encoding and decoding; SQL cannot express it, tests compare with the tokenizers library."""

from __future__ import annotations

from barscope.llm.bpe import digests, encoded
from barscope.llm.common import query, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op8_bpe")
def op8(spark, sf):
    return digests(encoded(table(spark, sf, "documents"), vocabulary()))
