"""All registered queries but those of the subpackage ``llm``: name -> query, and name -> equal SQL."""

from __future__ import annotations

from .plans import registered

QUERIES, ORACLE_SQL = registered()
FLAGSHIP = "activity_matrix"
