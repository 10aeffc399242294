"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from . import lifecycle, retrieval, shapes, upkeep

QUERIES: dict = {**retrieval.QUERIES, **upkeep.QUERIES, **shapes.QUERIES, **lifecycle.QUERIES}
SQL: dict = {**retrieval.SQL, **upkeep.SQL, **shapes.SQL, **lifecycle.SQL}
