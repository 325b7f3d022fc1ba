"""Every query of the library with its DuckDB text; the groups live in tessera.plans."""

from __future__ import annotations

from .plans import annotations, answers, concentration, corpus, mixing, prompts, quality, selection, verify
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "annotations", "answers", "concentration", "corpus", "mixing", "prompts", "quality", "selection", "verify"]
