"""The queries of the engine over the driver's tables, and their SQL."""

from __future__ import annotations

from watchgrid.plans import accounts, behaviour, ensemble, language, logs, pressure

_PARTS = (behaviour, accounts, ensemble, language, logs, pressure)

QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
