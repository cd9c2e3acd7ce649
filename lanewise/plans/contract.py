"""Queries over the driver's tables, one per operator family, with their SQL."""

from __future__ import annotations

from . import domain_plans, events_plans, keyed_plans, layout_plans, match_plans, outline_plans, rescue_plans, review_plans, revision_plans, sealed_plans

_MODULES = (keyed_plans, match_plans, events_plans, review_plans, domain_plans, layout_plans, revision_plans, outline_plans, sealed_plans, rescue_plans)

QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
