"""All registered queries of the engine, and the flagship among them."""

from __future__ import annotations

from siftstone.plans import casework, hits, judged, relational, retrieval, stores, texts, verification, workflows  # noqa: F401
from siftstone.plans.base import ORACLES, QUERIES

FLAGSHIP = "a4_rrf"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
