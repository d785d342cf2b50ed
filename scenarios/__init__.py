"""The registered queries: each pairs a Spark job with SQL that gives the same rows."""

from __future__ import annotations

from scenarios import catalog, checks, reports, sandboxes, statements, transforms
from scenarios.base import Scenario

ALL: dict[str, Scenario] = {
    **catalog.SCENARIOS,
    **sandboxes.SCENARIOS,
    **transforms.SCENARIOS,
    **statements.SCENARIOS,
    **checks.SCENARIOS,
    **reports.SCENARIOS,
}
