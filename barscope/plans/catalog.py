"""All registered queries."""

from __future__ import annotations

from barscope.plans.registry import QUERIES
from barscope.plans import (  # noqa: F401
    q_calendar, q_quality, q_ranks, q_research, q_rules, q_series, q_simulate, q_sources, q_values,
)
from barscope.plans.q_rules import flagship

__all__ = ["QUERIES", "flagship"]
