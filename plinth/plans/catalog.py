"""All queries over the driver tables, with the DuckDB SQL that says the same."""

from __future__ import annotations

from plinth.plans import archive, events, fields, parties, records, registers, texts  # noqa: F401  registration
from plinth.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
