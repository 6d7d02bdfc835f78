"""Registered queries of the corpus operators and their SQL twins."""

from gridhour.llm import collocations, decontaminate, hard_negatives, knn_quality, language, licenses, lines, mixing, pii, quality, simhash, spots, suffixes  # noqa: F401
from gridhour.llm.common import REGISTRY

__all__ = ["REGISTRY"]
