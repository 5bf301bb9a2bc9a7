"""Collects the query modules; importing it fills the registry."""

from __future__ import annotations

from tessella.plans import cases, curation, dialogues, documents, language, relational, retrieval, search, texts
from tessella.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cases", "curation", "dialogues", "documents", "language", "relational", "retrieval", "search", "texts"]
