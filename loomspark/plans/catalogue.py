"""All registered queries of the engine."""

from __future__ import annotations

from . import flows, guards, pages, records, research, texts, web  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
