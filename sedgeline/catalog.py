"""All queries of the library and the SQL that says what each must return."""

from __future__ import annotations

from .plans import attributions, curation, hosts, ledgers, localities, more, predictions, summaries, trees  # noqa: F401  register their queries
from .plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "named_by_decade"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
