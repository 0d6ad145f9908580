"""All registered queries."""

from tidemark.plans import q_audit, q_coverage, q_crosswalk, q_graph, q_panel, q_rank, q_vintage  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
