"""All queries of the subpackage."""

from __future__ import annotations

from barscope.llm import q_alignment, q_bpe, q_conversations, q_decontaminate, q_language, q_licences, q_linededup, q_lm, q_minhash, q_pii, q_quality, q_toxicity, q_warc  # noqa: F401
from barscope.llm.common import QUERIES

__all__ = ["QUERIES"]
