"""All queries outside the llm subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from plinth.plans import basics, composites, further, network, relational, roundtrips, spatialplans, temporal, textual, training, wording

MODULES = (training, basics, relational, temporal, textual, spatialplans, network, further, wording, composites, roundtrips)


def queries() -> dict[str, Callable]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
