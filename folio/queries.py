"""All queries of the library: name -> callable, name -> SQL."""

from __future__ import annotations

from folio.plans import archive, catalogue, curation, desk, rulebook, synthesis, worklog  # noqa: F401  registers them
from folio.plans.base import ORACLE, QUERIES  # noqa: F401
