"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from gneiss.plans import basics, hits


def queries() -> dict:
    return hits.registered() | basics.registered()


def oracle_sql() -> dict[str, str]:
    return hits.registered_sql() | basics.registered_sql()
